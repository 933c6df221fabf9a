"""Tables in the shared folder: materialised steps, and the catalog of fact tables on disk."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import SCHEMAS


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine may do without: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def save(tables: dict[str, DataFrame], root: str) -> None:
    """Every table as Parquet below root; index_meta last, so a catalog that was cut short is not valid."""
    for name in sorted(tables, key=lambda n: n == "index_meta"):
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of the catalog; one that is missing is empty."""
    out = {}
    for name, schema in SCHEMAS.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{root}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = empty(spark, name)
    return out


def is_valid(spark: SparkSession, root: str, source_path: str, fingerprint: str) -> bool:
    """Whether the catalog at root was built from this state of the source. Anything unreadable is not valid."""
    try:
        rows = spark.read.schema(SCHEMAS["index_meta"]).parquet(f"{root}/index_meta").collect()
    except Exception:  # noqa: BLE001
        return False
    return [(r.source_path, r.source_fingerprint) for r in rows] == [(source_path, fingerprint)]


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


class _Json:
    """A JSON document that is written row by row to whatever file system path names: no more than a row is held."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        self.out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        self.waiting: list[str] = []
        self.size = 0

    def put(self, text: str) -> None:
        self.waiting.append(text)
        self.size += len(text)
        if self.size > 1 << 20:
            self.flush()

    def flush(self) -> None:
        self.out.write(bytearray("".join(self.waiting).encode()))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()

    def members(self, rows: DataFrame, begin: str, end: str) -> None:
        """rows (text): written between begin and end, with commas."""
        self.put(begin)
        for i, row in enumerate(rows.toLocalIterator()):
            self.put(("," if i else "") + row.text)
        self.put(end)

    def lists(self, rows: DataFrame) -> None:
        """rows (key, text), sorted by key: an object of lists."""
        last = None
        for row in rows.toLocalIterator():
            self.put("," if row.key == last else ("" if last is None else "],") + json.dumps(row.key) + ":[")
            self.put(row.text)
            last = row.key
        self.put("]" if last is not None else "")


def export_json(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Bindings, kernels, operators, derivatives and definitions as one JSON document, with where and from what state they were taken."""
    doc = _Json(spark, path)
    whole = lambda df, *drop: F.to_json(F.struct(*[c for c in df.columns if c not in drop]))
    keyed = lambda key, text: F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), text)
    meta = tables["index_meta"].first()
    doc.put('{"metadata":' + json.dumps({"source": meta.source_path, "fingerprint": meta.source_fingerprint} if meta else {}))
    for name in ("bindings", "cuda_kernels"):
        t = tables[name]
        doc.members(t.orderBy("file_path", "ord").select(whole(t, "ord").alias("text")), f',"{name}":[', "]")
    t = tables["native_functions"]
    doc.members(t.orderBy("ord", "lookup_name").select(keyed(F.col("lookup_name"), whole(t, "lookup_name", "is_alias", "ord")).alias("text")), ',"native_functions":{', "}")
    t = tables["derivatives"]
    doc.members(t.orderBy("name").select(keyed(F.col("name"), whole(t)).alias("text")), ',"derivatives":{', "}")
    t = tables["native_implementations"]
    doc.put(',"native_implementations":{')
    doc.lists(t.orderBy("function_name", "file_path", "ord").select(F.col("function_name").alias("key"), whole(t, "ord").alias("text")))
    doc.put("}}")
    doc.close()


def export_call_graph(spark: SparkSession, edges: DataFrame, locations: DataFrame, path: str) -> None:
    """A call graph as one JSON document: callees and callers of each function, and where functions are."""
    doc = _Json(spark, path)
    name = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    for i, (part, key, value) in enumerate((("callees", "caller", "callee"), ("callers", "callee", "caller"))):
        doc.put(("," if i else "{") + f'"{part}":{{')
        doc.lists(edges.orderBy(key, value).select(F.col(key).alias("key"), name(value).alias("text")))
        doc.put("}")
    places = locations.orderBy("name").select(F.concat(name("name"), F.lit(":["), name("file"), F.lit(","), name("cast(line as string)"), F.lit("]")).alias("text"))
    doc.members(places, ',"function_locations":{', "}}")
    doc.close()


def try_call_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """import_call_graph, or None where there is no such document or it is not one."""
    try:
        spark.read.option("mode", "FAILFAST").json(path, multiLine=True).select("callees", "callers", "function_locations").limit(1).collect()
    except Exception:  # noqa: BLE001
        return None
    return import_call_graph(spark, path)


def import_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an index kept as one JSON document: bindings, cuda_kernels, native_functions, derivatives, native_implementations."""
    binding = "python_name string, cpp_name string, type string, file_path string, line int, dispatch_key string, namespace string, cuda_kernel string, signature string"
    struct = lambda s: "struct<" + ",".join(":".join(f.strip().split(" ", 1)) for f in s.split(", ")) + ">"
    native = "name string, base_name string, signature string, dispatch map<string,string>, variants string, structured boolean, structured_delegate string, tags array<string>"
    kernel = "name string, file_path string, line_number int, template_params string, parameters string, called_by array<string>"
    impl = "function_name string, file_path string, line_number int, signature string"
    deriv = "name string, signature string, gradients map<string,string>"
    schema = f"bindings array<{struct(binding)}>, cuda_kernels array<{struct(kernel)}>, native_functions map<string,{struct(native)}>, derivatives map<string,{struct(deriv)}>, native_implementations map<string,array<{struct(impl)}>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    out = {name: empty(spark, name) for name in SCHEMAS}
    for name in ("bindings", "cuda_kernels"):
        out[name] = doc.select(F.posexplode(name).alias("ord", "x")).select("x.*", F.col("ord").cast("long").alias("ord"))
    rows = doc.select(F.posexplode("native_functions").alias("ord", "k", "x"))
    out["native_functions"] = rows.select(F.col("k").alias("lookup_name"), "x.*", (F.col("k") != F.col("x.name")).alias("is_alias"), F.col("ord").cast("long").alias("ord"))
    out["derivatives"] = doc.select(F.explode("derivatives").alias("k", "x")).select("x.*")
    rows = doc.select(F.posexplode("native_implementations").alias("n", "k", "xs")).select("n", F.posexplode("xs").alias("i", "x"))
    out["native_implementations"] = rows.select("x.*", (F.col("n").cast("long") * 1_000_000 + F.col("i")).alias("ord"))
    return out


def import_call_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """call_edges and function_locations of a call graph kept as one JSON document (callees, callers, function_locations)."""
    schema = "callees map<string,array<string>>, callers map<string,array<string>>, function_locations map<string,array<string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    out = doc.select(F.explode("callees").alias("caller", "x")).select("caller", F.explode("x").alias("callee"))
    back = doc.select(F.explode("callers").alias("callee", "x")).select(F.explode("x").alias("caller"), "callee")
    locations = doc.select(F.explode("function_locations").alias("name", "x"))
    locations = locations.select("name", F.get("x", F.lit(0)).alias("file"), F.get("x", F.lit(1)).cast("int").alias("line"))
    return out.unionByName(back).where("caller <> callee").distinct(), locations
