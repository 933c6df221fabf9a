"""From a source tree to fact tables, and from there to a catalog on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import config, constants as C
from codeloom.schemas import SCHEMAS
from codeloom.sources import callgraph, cxx, files, python_src, store, yaml_ops


def build_tables(
    spark: SparkSession,
    root: str,
    cpp_dirs: list[str] | None = None,
    python_dirs: list[str] | None = None,
    test_dirs: list[str] | None = None,
    opinfo_dirs: list[str] | None = None,
    utility_files: list[str] | None = None,
    operators_yaml: str = C.OPERATORS_YAML,
    derivatives_yaml: str = C.DERIVATIVES_YAML,
    skip_keywords: bool = True,
) -> dict[str, DataFrame]:
    """All tables, as plans: nothing is read until a table is used. Lists default to those of ``constants``."""
    root = root.rstrip("/")
    cpp_dirs = C.CPP_DIRS if cpp_dirs is None else cpp_dirs
    native = yaml_ops.native_functions(spark, f"{root}/{operators_yaml}")
    marked = files.cxx_files(spark, root)
    kernels = cxx.kernels(marked, skip_keywords)
    bodies = files.implementation_files(spark, root, cpp_dirs)
    edges, locations = callgraph.call_graph(spark, root, bodies, cpp_dirs)
    out = {
        "native_functions": native,
        "derivatives": yaml_ops.derivatives(spark, f"{root}/{derivatives_yaml}"),
        "cuda_kernels": kernels,
        "bindings": cxx.bindings(marked, kernels, skip_keywords),
        "native_implementations": cxx.implementations(bodies, yaml_ops.targets(native)),
        "call_edges": edges,
        "function_locations": locations,
        **python_src.python_tables(files.python_files(spark, root, C.PYTHON_DIRS if python_dirs is None else python_dirs)),
        **python_src.test_tables(files.test_files(spark, root, C.TEST_DIRS if test_dirs is None else test_dirs)),
        "opinfo_registry": python_src.opinfo(files.scan(spark, root, C.OPINFO_DIRS if opinfo_dirs is None else opinfo_dirs, ["py"], recursive=False)),
    }
    tools = [(u, f"{root}/{u}", True) for u in (C.UTILITY_FILES if utility_files is None else utility_files) if files.exists(spark, f"{root}/{u}")]
    out["test_utilities"] = spark.createDataFrame(tools, SCHEMAS["test_utilities"])
    out["source_files"] = files.scan(spark, root, None, [*files.CXX_SUFFIXES, "py"])
    out["index_meta"] = spark.createDataFrame([(root, config.fingerprint(root))], SCHEMAS["index_meta"])
    return {name: _cast(df, SCHEMAS[name]) for name, df in out.items()}


def _cast(df: DataFrame, schema: str) -> DataFrame:
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def open_catalog(spark: SparkSession, root: str, cache: str | None = None, rebuild: bool = False, **settings) -> dict[str, DataFrame]:
    """Tables of the catalog on disk, which is built first unless it was built from this state of the source."""
    path = config.catalog_path(root, cache)
    if rebuild or not store.is_valid(spark, path, root.rstrip("/"), config.fingerprint(root)):
        tables = build_tables(spark, root, **settings)
        store.save({n: t for n, t in tables.items() if n != "source_files"}, path)
    return store.load(spark, path)
