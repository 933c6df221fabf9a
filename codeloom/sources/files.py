"""Scans of a source tree: directories and suffixes are pruned before a file is opened.

Contents are read by Spark. Its readers pass over names that begin with an underscore or a dot, which source trees are full of
(``__init__.py``, ``_internal/``), so those files are listed through the same file system and read by tasks of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.predicates import excluded, has_bindings, has_tests, in_main_tests, skipped_python
from codeloom.functions.text import newlines
from codeloom.schemas import SCHEMAS

CXX_SUFFIXES = ["cpp", "cc", "cxx", "cu", "cuh"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path exists in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, dirs: list[str] | None, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """source_files below root/dirs (those that exist; None: root itself), each file once. path is relative to root's place, content has line feeds."""
    root = root.rstrip("/")
    paths = [f"{root}/{d}" for d in dirs] if dirs is not None else [root]
    paths = sorted({p for p in paths if exists(spark, p)})
    paths = [p for p in paths if not (recursive and any(p.startswith(q + "/") for q in paths))]  # nested directories are scanned once
    if not paths:
        return spark.createDataFrame([], SCHEMAS["source_files"])
    glob = "*." + suffixes[0] if len(suffixes) == 1 else "*.{" + ",".join(suffixes) + "}"
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
    rows = rows.unionByName(_read(spark, _passed_over(spark, paths, suffixes, recursive)))
    plain = F.regexp_replace("uri", "^file:(//)?", "")
    base = root.removeprefix("file://").removeprefix("file:")
    rel = F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(plain)
    return rows.select(plain.alias("path"), rel.alias("rel_path"), F.element_at(F.split(plain, "\\."), -1).alias("ext"), "size", "mtime", newlines(F.col("content")).alias("content"))


def _passed_over(spark: SparkSession, paths: list[str], suffixes: list[str], recursive: bool) -> list[tuple]:
    """(uri, size, mtime) of files below paths that Spark's readers would not list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        top = fs.makeQualified(p).toString().rstrip("/")
        found = fs.listFiles(p, recursive)
        while found.hasNext():
            f = found.next()
            uri = f.getPath().toString()
            below = uri[len(top) :].split("/")
            if any(x.startswith(("_", ".")) and "=" not in x for x in below) and uri.rpartition(".")[2] in suffixes:
                out[uri] = (uri, f.getLen(), datetime.fromtimestamp(f.getModificationTime() / 1000, timezone.utc))
    return sorted(out.values())


def _read(spark: SparkSession, listed: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i, uri in enumerate(batch.column(0).to_pylist()):
                store, path = fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                with store.open_input_stream(path, compression=None) as f:
                    text = f.read().decode("utf-8", errors="ignore")
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([text])], names=["uri", "size", "mtime", "content"])

    rows = spark.createDataFrame(listed, "uri string, size long, mtime timestamp")
    return rows.repartition(max(1, len(listed) // 200 + 1)).mapInArrow(run, "uri string, size long, mtime timestamp, content string") if listed else rows.withColumn("content", F.lit(None).cast("string"))


def _rooted(rel_path: str = "rel_path"):
    return F.concat(F.lit("/"), F.col(rel_path))


def cxx_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the whole tree that may hold bindings."""
    rows = scan(spark, root, None, CXX_SUFFIXES)
    return rows.where(~excluded(_rooted()) & has_bindings(F.col("content")))


def implementation_files(spark: SparkSession, root: str, dirs: list[str]) -> DataFrame:
    return scan(spark, root, dirs, ["cpp"]).where(~excluded(_rooted()))


def python_files(spark: SparkSession, root: str, dirs: list[str], skip_tests: bool = True) -> DataFrame:
    """Files of the package directories. Tests are skipped by their path below the directory that was scanned."""
    rows = scan(spark, root, dirs, ["py"])
    any_dir = "|".join(re.escape(d) for d in sorted(dirs, key=len, reverse=True))
    below = F.regexp_replace("rel_path", f"^(?:{any_dir})/", "")
    return rows.where(~skipped_python(below)) if skip_tests else rows.where(~F.contains("rel_path", F.lit("__pycache__")))


def test_files(spark: SparkSession, root: str, dirs: list[str]) -> DataFrame:
    """Test sources: all of the main test directory, elsewhere those that speak of tests."""
    rows = scan(spark, root, dirs, ["py"]).where(~F.contains("rel_path", F.lit("__pycache__")))
    return rows.where(in_main_tests(_rooted()) | has_tests(F.col("content")))
