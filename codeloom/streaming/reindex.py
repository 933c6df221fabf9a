"""Incremental re-indexing: a file stream of C++ and CUDA sources keeps the bindings table current.

Each micro-batch is extracted like a whole tree and written under its batch number, so a batch that is repeated after a failure replaces
itself. ``current`` shows, of every file, the rows of the last batch that saw it; a file that no longer holds bindings shows none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.predicates import excluded
from codeloom.functions.text import newlines
from codeloom.schemas import SCHEMAS
from codeloom.sources import cxx
from codeloom.sources.files import CXX_SUFFIXES


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Starts the stream. once: what is there now, in as many batches as it takes; else every interval, until it is stopped."""
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{" + ",".join(CXX_SUFFIXES) + "}").option("recursiveFileLookup", True).load(root)
    rows = rows.select(path.alias("path"), F.element_at(F.split(path, "\\."), -1).alias("ext"), newlines(F.col("value")).alias("content"))
    rows = rows.where(~excluded(F.substring("path", len(base) + 1, 1 << 30)))

    def write(batch: DataFrame, number: int) -> None:
        kernels = cxx.kernels(batch)
        for name, df in (("files", batch.select(F.col("path").alias("file_path"))), ("cuda_kernels", kernels), ("bindings", cxx.bindings(batch, kernels))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, out: str, name: str = "bindings") -> DataFrame:
    """The bindings (or cuda_kernels) as of the last batch of each file."""
    last = spark.read.schema("file_path string, batch long").parquet(f"{out}/files").groupBy("file_path").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(SCHEMAS[name] + ", batch long").parquet(f"{out}/{name}")
    return rows.join(last, ["file_path", "batch"], "left_semi").drop("batch")
