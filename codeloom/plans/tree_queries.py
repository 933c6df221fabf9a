"""Registered queries that run the scans, extractors, catalog and tools themselves, over a small source tree of our own text.

The tree (tree.py) is written to the shared folder once for each application, read by the scans and extractors, and kept as a catalog of
Parquet tables there; every query starts from those. What they must give was worked out by hand from the rules and is written down as
VALUES beside each query.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import config
from codeloom.functions import text as X
from codeloom.operators import match as M
from codeloom.plans import render, tree
from codeloom.plans.build import build_tables, open_catalog
from codeloom.plans.tools import Catalog, NotLoaded
from codeloom.sources import callgraph, cxx, files, python_src, store, yaml_ops

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PLUS, REG, CU = "aten/src/ATen/native/Plus.cpp", "aten/src/ATen/native/reg.cpp", "aten/src/ATen/cuda/k.cu"
LINEAR, MORE = "torch/nn/linear.py", "torch/testing/_internal/opinfo/definitions/more.py"
CORE, COMMON = "torch/testing/_internal/opinfo/core.py", "torch/testing/_internal/common_utils.py"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value).upper()
    return "'" + str(value).replace("'", "''") + "'"


def _expect(columns: str, *rows: tuple):
    """The decorated query must give these rows. columns: "name type, ..." in DuckDB's words."""
    names, types = zip(*(c.split() for c in columns.split(", ")), strict=True)
    shown = ", ".join(f"c{i}::{t} AS {n}" for i, (n, t) in enumerate(zip(names, types, strict=True)))
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    sql = f"SELECT {shown} FROM (VALUES {values}) AS t({', '.join(f'c{i}' for i in range(len(names)))})"

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        _SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- the tree and its catalog

_PLACES: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """Where the tree lies; it is written once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _PLACES:
        root = f"{store.shared_base(spark).removeprefix('file://')}/tree-{uuid.uuid4().hex}"
        tree.write(spark, f"{root}/src")
        _PLACES[app] = root
    return f"{_PLACES[app]}/src"


def _catalog(spark: SparkSession) -> Catalog:
    root = _root(spark)
    return Catalog(spark, open_catalog(spark, root, root.removesuffix("/src")), root)


def _below(spark: SparkSession, column: str | Column) -> Column:
    """A path below the tree's root."""
    return X.relative_path(F.col(column) if isinstance(column, str) else column, _root(spark))


def _joined(column: str) -> Column:
    return F.array_join(column, ",")


def _pairs(column: str) -> Column:
    """A map as k=v;k=v, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


# ---------------------------------------------------------------- scans


@_expect(
    "scan VARCHAR, path VARCHAR",
    ("marked", PLUS), ("marked", REG), ("marked", CU),
    ("bodies", PLUS), ("bodies", REG),
    ("python", LINEAR), ("python", "torch/nn/__init__.py"), ("python", "torch/nn/broken.py"), ("python", "torch/nn/tests/no.py"), ("python", "torch/optim/sgd.py"),
    ("tests", "test/test_plus.py"), ("tests", COMMON), ("tests", CORE), ("tests", MORE), ("tests", "torch/testing/_internal/opinfo/definitions/deep/no.py"),
    ("opinfo", CORE), ("opinfo", MORE),
)
def tree_scans(spark: SparkSession) -> DataFrame:
    """Which files each scan reads: directories, suffixes, exclusions, marks in the content."""
    from codeloom import constants as C

    root = _root(spark)
    scans = {
        "marked": files.cxx_files(spark, root), "bodies": files.implementation_files(spark, root, C.CPP_DIRS), "python": files.python_files(spark, root, C.PYTHON_DIRS),
        "tests": files.test_files(spark, root, C.TEST_DIRS), "opinfo": files.scan(spark, root, C.OPINFO_DIRS, ["py"], recursive=False),
    }
    parts = [df.select(F.lit(name).alias("scan"), F.col("rel_path").alias("path")) for name, df in scans.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- extractors


@_expect(
    "lookup_name VARCHAR, name VARCHAR, base_name VARCHAR, signature VARCHAR, dispatch VARCHAR, variants VARCHAR, structured BOOLEAN, structured_delegate VARCHAR, tags VARCHAR, is_alias BOOLEAN",
    ("plus", "plus", "plus", "plus(Tensor self) -> Tensor", "CPU=plus_kernel;CUDA=plus_kernel;MPS=plus_mps", "function, method", False, None, "pointwise", False),
    ("minus.Tensor", "minus.Tensor", "minus", "minus.Tensor(Tensor self) -> Tensor", "", "", True, None, "core,pointwise", False),
    ("minus.Scalar", "minus.Scalar", "minus", "minus.Scalar(Tensor self) -> Tensor", "", "", False, "minus.out", "", False),
    ("minus", "minus.Tensor", "minus", "minus.Tensor(Tensor self) -> Tensor", "", "", True, None, "core,pointwise", True),
    ("times.out", "times.out", "times", "times.out(Tensor self) -> Tensor", "", "", False, None, "", False),
    ("times", "times", "times", "times(Tensor self) -> Tensor", "", "", False, None, "", False),
)
def tree_native_functions(spark: SparkSession) -> DataFrame:
    rows = _catalog(spark)["native_functions"]
    return rows.select("lookup_name", "name", "base_name", "signature", _pairs("dispatch").alias("dispatch"), "variants", "structured", "structured_delegate", _joined("tags").alias("tags"), "is_alias")


@_expect(
    "name VARCHAR, signature VARCHAR, gradients VARCHAR",
    ("plus", "plus(Tensor self) -> Tensor", f"other={tree.LONG_FORMULA};self=grad"),
    ("minus.Tensor", "minus.Tensor(Tensor self)", "self=last"),
)
def tree_derivatives(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["derivatives"].select("name", "signature", _pairs("gradients").alias("gradients"))


@_expect("name VARCHAR", ("plus",), ("minus",), ("times",), ("plus_kernel",), ("plus_mps",))
def tree_targets(spark: SparkSession) -> DataFrame:
    """Names whose definitions count: every base name and every dispatch target."""
    return yaml_ops.targets(_catalog(spark)["native_functions"])


_BINDINGS = [
    ("pybind_function", "run", "do_run", None, "_ext", None, REG, 15),
    ("pybind_class", "Engine", "Engine", None, "_ext", None, REG, 18),
    ("pybind_method", "Engine.start", "Engine::start", None, "_ext", None, REG, 19),
    ("pybind_method", "Engine.make", "Engine::make", None, "_ext", None, REG, 20),
    ("pybind_method", "Engine.speed", "Engine::speed", None, "_ext", None, REG, 21),
    ("pybind_class", "Engine", "Engine", None, None, None, REG, 18),
    ("pybind_method", "Engine.start", "Engine::start", None, None, None, REG, 19),
    ("pybind_method", "Engine.make", "Engine::make", None, None, None, REG, 20),
    ("pybind_method", "Engine.speed", "Engine::speed", None, None, None, REG, 21),
    ("pybind_class", "Other", "Other", None, None, None, REG, 24),
    ("pybind_method", "Other.go", "Other::go", None, None, None, REG, 24),
    ("pybind_method", "Other.late", "Other::late", None, None, None, REG, 24),
    ("torch_op", "mine.plus", "plus", None, "mine", "plus(Tensor a) -> Tensor", REG, 3),
    ("torch_op", "mine.minus", "minus", None, "mine", "mine::minus(Tensor a) -> Tensor", REG, 4),
    ("torch_library_impl", "mine.plus", "plus_impl", None, "mine", None, REG, 5),
    ("torch_op", "frag.solo", "solo", None, "frag", "solo(int a) -> int", REG, 9),
    ("torch_library_impl", "_.plus", "TORCH_FN(plus_cuda", "CUDA", "_", None, REG, 11),
]
_OF_KERNELS = [
    ("cuda_kernel", "fill_kernel", "fill_kernel", "CUDA", None, "T* out, int n", CU, 2),
    ("cuda_kernel", "add_kernel", "add_kernel", "CUDA", None, "float* a,\n                           float* b", CU, 3),
]
_OF_MACROS = [("at_dispatch", "plus_inner", "plus", None, None, "AT_DISPATCH_ALL_TYPES(self.type())", PLUS, 4)]
_BINDING = "type VARCHAR, python_name VARCHAR, cpp_name VARCHAR, dispatch_key VARCHAR, namespace VARCHAR, signature VARCHAR, file_path VARCHAR, line INTEGER"


def _shown_bindings(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.select("type", "python_name", "cpp_name", "dispatch_key", "namespace", "signature", _below(spark, "file_path").alias("file_path"), "line")


@_expect(_BINDING, *_BINDINGS, *_OF_KERNELS, *_OF_MACROS)
def tree_bindings(spark: SparkSession) -> DataFrame:
    """Modules, classes, methods, libraries, kernels and dispatch macros, in files that are scanned for them."""
    return _shown_bindings(spark, _catalog(spark)["bindings"])


@_expect(_BINDING, *[(*b[:6], "one.cpp", b[7]) for b in _BINDINGS])
def tree_bindings_of_one_file(spark: SparkSession) -> DataFrame:
    """The entry for a single text: a path and a content, no tree."""
    return _shown_bindings(spark, cxx.detect_bindings(spark, "one.cpp", tree.FILES[REG]))


@_expect(
    "python_name VARCHAR, cpp_name VARCHAR, type VARCHAR, line INTEGER",
    ("a.b", "b", "torch_op", 1), ("a.c", "fn", "torch_library_impl", 2),
)
def tree_block_function(spark: SparkSession) -> DataFrame:
    """The table function, from SQL."""
    cxx.register_table_function(spark)
    return spark.sql("""SELECT python_name, cpp_name, type, line FROM block_bindings('TORCH_LIBRARY(a, m) { m.def("b()");\n m.impl("c", fn); }')""")


@_expect(
    "name VARCHAR, file_path VARCHAR, line_number INTEGER, template_params VARCHAR, parameters VARCHAR, called_by VARCHAR",
    ("fill_kernel", CU, 2, None, "T* out, int n", "launch_a,launch_b"), ("add_kernel", CU, 3, None, "float* a,\n                           float* b", "launch_b"),
)
def tree_kernels(spark: SparkSession) -> DataFrame:
    """Kernels and the functions around their launches."""
    return _catalog(spark)["cuda_kernels"].select("name", _below(spark, "file_path").alias("file_path"), "line_number", "template_params", "parameters", _joined("called_by").alias("called_by"))


@_expect("enclosing VARCHAR, with_keywords VARCHAR, node VARCHAR", ("launch_a", "if", "fill_kernel<<<1, 2>>>"))
def tree_enclosing(spark: SparkSession) -> DataFrame:
    """The function around a place: keywords are passed over, or not; and the text of the place itself after characters of two bytes."""
    rows = spark.createDataFrame([("é ü " + tree.FILES[CU],)], "t string")
    at = F.instr("t", "fill_kernel<<<") - 1
    return rows.select(X.enclosing(F.col("t"), at).alias("enclosing"), X.enclosing(F.col("t"), at, skip_keywords=False).alias("with_keywords"), F.substring("t", at + 1, F.lit(21)).alias("node"))


@_expect(
    "function_name VARCHAR, file_path VARCHAR, line_number INTEGER, signature VARCHAR",
    ("plus", PLUS, 2, "Tensor plus(const Tensor& self) {"), ("plus_kernel", PLUS, 8, "static inline void plus_kernel("), ("minus", PLUS, 12, "Tensor& at::native::minus(Tensor self) {"),
)
def tree_implementations(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["native_implementations"].select("function_name", _below(spark, "file_path").alias("file_path"), "line_number", "signature")


_EDGES = [("at::native::minus", "other::helper"), ("other::helper", "plus_kernel"), ("plus", "other::helper"), ("plus", "plus_kernel"), ("plus_kernel", "other::helper")]
_PLACED = [("at::native::minus", PLUS, 12), ("other::helper", PLUS, 18), ("plus", PLUS, 16), ("plus_kernel", PLUS, 8), ("unrelated", PLUS, 15), ("outside", REG, 23)]


@_expect("caller VARCHAR, callee VARCHAR", *_EDGES)
def tree_call_edges(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["call_edges"]


@_expect("name VARCHAR, file VARCHAR, line INTEGER", *_PLACED)
def tree_function_locations(spark: SparkSession) -> DataFrame:
    """Where each function is defined; of two definitions the last counts."""
    return _catalog(spark)["function_locations"].select("name", _below(spark, "file").alias("file"), "line")


@_expect(
    "file VARCHAR, directory VARCHAR, arguments VARCHAR",
    ("/src/aten/src/ATen/native/Plus.cpp", "/src", "-Iinc -Idir -DX=1 -std=c++17"), ("/src/c10/b.cpp", "/src", "-DY"),
)
def tree_compile_commands(spark: SparkSession) -> DataFrame:
    """Entries of a compile database (in the build directory): which files count, and their kept arguments."""
    return callgraph.compile_commands(spark, f"{_root(spark)}/db").select("file", "directory", F.array_join("arguments", " ").alias("arguments"))


@_expect(
    "name VARCHAR, file_path VARCHAR, exports VARCHAR",
    ("torch.nn", "torch/nn/__init__.py", "Linear"), ("torch.nn.linear", LINEAR, "Linear,Lazy"), ("torch.nn.tests.no", "torch/nn/tests/no.py", ""), ("torch.optim.sgd", "torch/optim/sgd.py", ""),
)
def tree_py_modules(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["py_modules"].select("name", _below(spark, "file_path").alias("file_path"), _joined("exports").alias("exports"))


@_expect(
    "qualified_name VARCHAR, module VARCHAR, line_number INTEGER, bases VARCHAR, decorators VARCHAR, docstring VARCHAR, is_module BOOLEAN, methods VARCHAR",
    ("torch.nn.linear.Linear", "torch.nn.linear", 14, "Module", "final", "A layer.", True, "__init__,shape,wait"),
    ("torch.nn.linear.Indirect", "torch.nn.linear", 23, "Linear", "", None, False, ""),
    ("torch.nn.linear.Stack", "torch.nn.linear", 24, "nn.Module,Generic", "", None, True, ""),
    ("torch.nn.linear.MSELoss", "torch.nn.linear", 25, "torch.nn.Module", "", None, True, ""),
    ("torch.nn.linear.Sequential", "torch.nn.linear", 26, "Module", "", None, True, ""),
    ("torch.optim.sgd.SGD", "torch.optim.sgd", 1, "Optimizer", "", None, False, ""),
    ("torch.optim.sgd._Base", "torch.optim.sgd", 2, "", "", None, False, ""),
    ("torch.nn.tests.no.No2", "torch.nn.tests.no", 1, "", "", None, False, ""),
)
def tree_py_classes(spark: SparkSession) -> DataFrame:
    rows = _catalog(spark)["py_classes"]
    return rows.select("qualified_name", "module", "line_number", _joined("bases").alias("bases"), _joined("decorators").alias("decorators"), "docstring", "is_module", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"))


@_expect(
    "qualified_name VARCHAR, class_name VARCHAR, line_number INTEGER, is_method BOOLEAN, is_async BOOLEAN, decorators VARCHAR, signature VARCHAR, cpp_binding VARCHAR",
    ("torch.nn.linear.guarded", None, 9, False, False, "", "()", None),
    ("torch.nn.linear.later", None, 27, False, True, "", "(x: Tensor)", None),
    ("torch.nn.linear.outer", None, 28, False, False, "", "()", "_C.call"),
    ("torch.nn.linear.Linear.__init__", "Linear", 16, True, False, "", "(self, n: int, *args, **kw) -> None", None),
    ("torch.nn.linear.Linear.shape", "Linear", 19, True, False, "property", "(self)", "torch._C._shape"),
    ("torch.nn.linear.Linear.wait", "Linear", 20, True, True, "", "(self)", None),
)
def tree_py_functions(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["py_functions"].select("qualified_name", "class_name", "line_number", "is_method", "is_async", _joined("decorators").alias("decorators"), "signature", "cpp_binding")


@_expect(
    "module VARCHAR, name VARCHAR, alias VARCHAR, file_path VARCHAR, line_number INTEGER",
    ("os", "os", None, LINEAR, 2), ("torch", "torch", "t", LINEAR, 2), ("module", "Module", None, LINEAR, 3), ("x", "a", None, LINEAR, 4), ("x", "b", "c", LINEAR, 4), ("fast", "fast", None, LINEAR, 8),
    ("linear", "*", None, "torch/nn/__init__.py", 1),
)
def tree_py_imports(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["py_imports"].select("module", "name", "alias", _below(spark, "file_path").alias("file_path"), "line_number")


@_expect("export VARCHAR, module VARCHAR", ("Linear", "torch.nn.linear"), ("Lazy", "torch.nn.linear"))
def tree_exports(spark: SparkSession) -> DataFrame:
    return python_src.exports_index(_catalog(spark)["py_modules"])


@_expect(
    "file VARCHAR, module VARCHAR, n_classes INTEGER, n_functions INTEGER",
    (LINEAR, "torch.nn.linear", 5, 3), ("torch/nn/broken.py", None, None, None), (PLUS, None, None, None), ("torch/nn/missing.py", None, None, None),
)
def tree_single_python_files(spark: SparkSession) -> DataFrame:
    """The entry for a single file: no module for what is no Python file, is missing or does not parse."""
    rows = []
    for name in (LINEAR, "torch/nn/broken.py", PLUS, "torch/nn/missing.py"):
        m = python_src.analyze_file(spark, f"{_root(spark)}/{name}")
        rows.append((name, m["name"], len(m["classes"]), len(m["functions"])) if m else (name, None, None, None))
    return spark.createDataFrame(rows, "file string, module string, n_classes int, n_functions int")


@_expect(
    "path VARCHAR, n_classes BIGINT, n_functions BIGINT",
    ("test/test_plus.py", 3, 4), (COMMON, 0, 1), (CORE, 0, 0), (MORE, 0, 0), ("torch/testing/_internal/opinfo/definitions/deep/no.py", 0, 0),
)
def tree_test_files(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["test_files"].select("path", "n_classes", "n_functions")


@_expect(
    "name VARCHAR, file VARCHAR, line INTEGER, bases VARCHAR, is_test_class BOOLEAN",
    ("TestPlus", "test/test_plus.py", 1, "TestCase", True), ("NotATest", "test/test_plus.py", 5, "", False), ("Inner", "test/test_plus.py", 11, "MyTestBase", True),
)
def tree_test_classes(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["test_classes"].select("name", "file", "line", _joined("bases").alias("bases"), "is_test_class")


_TEST_FUNCTIONS = [("test_plus", "TestPlus", "test/test_plus.py", 2), ("test_plus_too", "NotATest", "test/test_plus.py", 6), ("test_top", None, "test/test_plus.py", 7), ("test_in", "Inner", "test/test_plus.py", 12), ("test_common", None, COMMON, 2)]


@_expect("name VARCHAR, class VARCHAR, file VARCHAR, line INTEGER", *_TEST_FUNCTIONS)
def tree_test_functions(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["test_functions"].select("name", "class", "file", "line")


@_expect("name VARCHAR, class VARCHAR, file VARCHAR, line INTEGER", *_TEST_FUNCTIONS, ("test_async", "TestPlus", "test/test_plus.py", 3))
def tree_test_functions_with_async(spark: SparkSession) -> DataFrame:
    from codeloom import constants as C

    return python_src.test_tables(files.test_files(spark, _root(spark), C.TEST_DIRS), with_async=True)["test_functions"].select("name", "class", "file", "line")


@_expect("name VARCHAR, file VARCHAR, line INTEGER", ("minus", CORE, 2), ("plus", MORE, 1))
def tree_opinfo(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["opinfo_registry"]


@_expect("path VARCHAR, exists BOOLEAN", (COMMON, True), (CORE, True))
def tree_test_utilities(spark: SparkSession) -> DataFrame:
    return _catalog(spark)["test_utilities"].select("path", "exists")


# ---------------------------------------------------------------- catalog, exchange formats, settings


@_expect(
    "name VARCHAR, value VARCHAR",
    ("fingerprint", "16"), ("fingerprint of nothing", "d41d8cd98f00b204"), ("source hash", "12"), ("valid", "true"), ("valid for another state", "false"), ("valid where there is none", "false"),
    ("rows of a missing table", "0"), ("rows of another root", "0"), ("source", "true"), ("no directory", "false"), ("no source", "false"), ("flag wins", "given"), ("first variable hides the second", "None"), ("second variable", "here"), ("settings file", "here"),
    ("settings kept", "1 2"), ("unreadable settings", "{}"),
)
def tree_settings(spark: SparkSession) -> DataFrame:
    """Fingerprint, validity and names of caches; where the source is taken from; the settings file (the driver's own)."""
    root = _root(spark)
    place, catalog = config.catalog_path(root, root.removesuffix("/src")), _catalog(spark)
    mark = config.fingerprint(root)
    with tempfile.TemporaryDirectory() as own:
        path = Path(own) / "c" / "settings.toml"
        config.save_config({"source": {"pytorch_source": own}, "other": {"a": 1}}, path)
        config.save_config({"other": {"b": 2}}, path)
        kept = config.load_config(path)["other"]
        resolve = lambda flag, environ: str(config.resolve_source(flag, environ, path)).replace(own, "here")
        found = [resolve("given", {}), resolve(None, {"PYTORCH_SOURCE": "/nowhere/at/all", "PYTORCH_PATH": own}), resolve(None, {"PYTORCH_PATH": own}), resolve(None, {})]
        found[1] = "None" if found[1] == "here" and config.load_config(Path(own) / "no") == {} and config.resolve_source(None, {"PYTORCH_SOURCE": "/nowhere/at/all", "PYTORCH_PATH": own}, Path(own) / "no") is None else found[1]
        path.write_text("not [ toml")
        broken = str(config.load_config(path))
        empty = [str(config.validate_source(own)[0]).lower(), config.fingerprint(own)]
    local = os.path.exists(root)  # a tree in a remote folder is no place for the settings' checks
    rows = [
        ("fingerprint", str(len(mark))), ("fingerprint of nothing", empty[1]), ("source hash", str(len(config.source_hash(root)))),
        ("valid", str(store.is_valid(spark, place, root, mark)).lower()), ("valid for another state", str(store.is_valid(spark, place, root, "other")).lower()),
        ("valid where there is none", str(store.is_valid(spark, f"{place}/none", root, mark)).lower()), ("rows of a missing table", str(store.load(spark, f"{place}/none")["bindings"].count())),
        ("rows of another root", str(build_tables(spark, f"{place}/none")["bindings"].count())), ("source", str(config.validate_source(root)[0] if local else bool(catalog)).lower()),
        ("no directory", str(config.validate_source("/nowhere/at/all")[0]).lower()), ("no source", empty[0]), ("flag wins", found[0]), ("first variable hides the second", found[1]), ("second variable", found[2]),
        ("settings file", found[3]), ("settings kept", f"{kept['a']} {kept['b']}"), ("unreadable settings", broken),
    ]
    return spark.createDataFrame(rows, "name string, value string")


@_expect(_BINDING, *_BINDINGS, *_OF_KERNELS, *_OF_MACROS)
def tree_json_bindings(spark: SparkSession) -> DataFrame:
    """The index written as one JSON document and read back."""
    path = f"{_PLACES[spark.sparkContext.applicationId] if _root(spark) else ''}/index-{uuid.uuid4().hex}.json"
    store.export_json(spark, _catalog(spark).tables, path)
    return _shown_bindings(spark, store.import_json(spark, path)["bindings"])


@_expect(
    "item VARCHAR, detail VARCHAR",
    ("kernel fill_kernel", "launch_a,launch_b"), ("kernel add_kernel", "launch_b"),
    ("function plus", "CPU=plus_kernel;CUDA=plus_kernel;MPS=plus_mps"), ("function minus.Tensor", ""), ("function minus.Scalar", ""), ("function minus", ""), ("function times.out", ""), ("function times", ""),
    ("derivative plus", f"other={tree.LONG_FORMULA};self=grad"), ("derivative minus.Tensor", "self=last"),
    ("definition plus", "2"), ("definition plus_kernel", "8"), ("definition minus", "12"),
)
def tree_json_others(spark: SparkSession) -> DataFrame:
    """The document's other tables."""
    path = f"{_PLACES[spark.sparkContext.applicationId] if _root(spark) else ''}/index-{uuid.uuid4().hex}.json"
    store.export_json(spark, _catalog(spark).tables, path)
    t = store.import_json(spark, path)
    tell = lambda kind, df, name, detail: df.select(F.concat_ws(" ", F.lit(kind), name).alias("item"), detail.cast("string").alias("detail"))
    out = tell("kernel", t["cuda_kernels"], "name", _joined("called_by")).unionByName(tell("function", t["native_functions"], "lookup_name", _pairs("dispatch")))
    return out.unionByName(tell("derivative", t["derivatives"], "name", _pairs("gradients"))).unionByName(tell("definition", t["native_implementations"], "function_name", F.col("line_number")))


@_expect(
    "item VARCHAR, first VARCHAR, second VARCHAR",
    *[("edge", a, b) for a, b in _EDGES], *[("place", n, f"{f}:{k}") for n, f, k in _PLACED], ("state", "read", "true"), ("state", "corrupt", "false"), ("state", "missing", "false"),
)
def tree_json_call_graph(spark: SparkSession) -> DataFrame:
    """The call graph written as one JSON document and read back; a corrupt or missing one is told from it."""
    root = _root(spark)
    folder, c = root.removesuffix("/src"), _catalog(spark)
    path = f"{folder}/graph-{uuid.uuid4().hex}.json"
    store.export_call_graph(spark, c["call_edges"], c["function_locations"], path)
    edges, places = store.try_call_graph(spark, path)
    state = [("state", "read", "true"), ("state", "corrupt", str(store.try_call_graph(spark, f"{root}/{REG}") is not None).lower()), ("state", "missing", str(store.try_call_graph(spark, f"{folder}/none.json") is not None).lower())]
    out = edges.select(F.lit("edge").alias("item"), F.col("caller").alias("first"), F.col("callee").alias("second"))
    out = out.unionByName(places.select(F.lit("place").alias("item"), F.col("name").alias("first"), X.location(_below(spark, "file"), F.col("line")).alias("second")))
    return out.unionByName(spark.createDataFrame(state, "item string, first string, second string"))


# ---------------------------------------------------------------- tools


@_expect(
    "component VARCHAR, item VARCHAR, n BIGINT",
    ("bindings", "bindings", 20), ("bindings", "cuda_kernels", 2), ("bindings", "dispatch_keys", 1), ("dispatch", "CUDA", 3), ("operators", "native_functions", 6), ("operators", "derivatives", 2),
    ("operators", "implementations", 3), ("call_graph", "functions", 6), ("call_graph", "edges", 5), ("call_graph", "files", 2), ("python", "modules", 4), ("python", "classes", 8), ("python", "nn_modules", 4),
    ("tests", "files", 5), ("tests", "classes", 3), ("tests", "functions", 5), ("tests", "opinfo", 2),
)
def tool_status(spark: SparkSession) -> DataFrame:
    return _catalog(spark).status()


_CUT = tree.LONG_FORMULA[:57] + "..."


@_expect(
    "query VARCHAR, name VARCHAR, signature VARCHAR, dispatch VARCHAR, tags VARCHAR, gradients VARCHAR",
    ("plus", "plus", "plus(Tensor self) -> Tensor", "CPU=plus_kernel;CUDA=plus_kernel;MPS=plus_mps", "pointwise", f"other={_CUT};self=grad"),
    ("minus.Tensor", "minus.Tensor", "minus.Tensor(Tensor self) -> Tensor", "", "core,pointwise", "self=last"),
    ("MINUS", "minus.Tensor", "minus.Tensor(Tensor self) -> Tensor", "", "core,pointwise", None),
    ("tim", "times", "times(Tensor self) -> Tensor", "", "", None),
)
def tool_trace_definition(spark: SparkSession) -> DataFrame:
    """An operator's row and formulas: by its name, in another case, by a part; none for a name that nothing is like."""
    c, out = _catalog(spark), None
    for q in ("plus", "minus.Tensor", "MINUS", "tim", "zzzz"):
        rows = c.trace(q, "yaml")["definition"].select(F.lit(q).alias("query"), "name", "signature", _pairs("dispatch").alias("dispatch"), _joined("tags").alias("tags"), _pairs("gradients").alias("gradients"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_expect(
    "query VARCHAR, dispatch_key VARCHAR, cpp_name VARCHAR, file_path VARCHAR, line INTEGER, rank BIGINT, total BIGINT",
    ("plus", None, "plus", PLUS, 4, 1, 2), ("plus", None, "plus", REG, 3, 2, 2),
    ("mine.plus", None, "plus", REG, 3, 1, 2), ("mine.plus", None, "plus_impl", REG, 5, 2, 2),
    ("frag.solp", None, "solo", REG, 9, 1, 1),
)
def tool_trace_registrations(spark: SparkSession) -> DataFrame:
    """By the C++ name, by the Python name, and by the nearest one."""
    c, out = _catalog(spark), None
    for q in ("plus", "mine.plus", "frag.solp"):
        rows = c.trace(q, "dispatch")["registrations"].select(F.lit(q).alias("query"), "dispatch_key", "cpp_name", _below(spark, "file_path").alias("file_path"), "line", "rank", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@_expect(
    "query VARCHAR, function_name VARCHAR, line_number INTEGER, signature VARCHAR, rank BIGINT, total BIGINT",
    ("plus", "plus", 2, "Tensor plus(const Tensor& self) {", 1, 2), ("plus", "plus_kernel", 8, "static inline void plus_kernel(", 2, 2),
    ("minus.Scalar", "minus", 12, "Tensor& at::native::minus(Tensor self) {", 1, 1),
)
def tool_trace_implementations(spark: SparkSession) -> DataFrame:
    """Definitions of the operator's base and of its dispatch targets."""
    c, out = _catalog(spark), None
    for q in ("plus", "minus.Scalar"):
        rows = c.trace(q)["implementations"].select(F.lit(q).alias("query"), "function_name", "line_number", "signature", "rank", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@_expect(
    "tool VARCHAR, focus VARCHAR, told VARCHAR",
    ("trace", "full", "definition,implementations,registrations"), ("trace", "yaml", "definition"), ("trace", "dispatch", "registrations"),
    ("tests", "all", "files,functions,opinfo"), ("tests", "functions", "functions,opinfo"), ("tests", "classes", ""), ("tests", "files", "files"),
    ("ready", "bindings", "yes"), ("ready", "nothing", "no"), ("options", "wrong", "refused"),
)
def tool_focus(spark: SparkSession) -> DataFrame:
    """Which parts a tool tells for each focus; a tool on empty tables and an unknown option are refused."""
    c = _catalog(spark)
    rows = [("trace", f, ",".join(sorted(c.trace("plus", f)))) for f in ("full", "yaml", "dispatch")]
    rows += [("tests", f, ",".join(sorted(r.section for r in c.tests("plus", focus=f).select("section").distinct().collect()))) for f in ("all", "functions", "classes", "files")]

    def refused(call, kind) -> bool:
        try:
            call()
        except kind:
            return True
        return False

    empty = Catalog(spark, {n: store.empty(spark, n) for n in c.tables})
    rows += [("ready", "bindings", "no" if refused(lambda: c.need("bindings"), NotLoaded) else "yes"), ("ready", "nothing", "no" if refused(lambda: empty.trace("plus"), NotLoaded) else "yes")]
    rows.append(("options", "wrong", "refused" if refused(lambda: c.search("plus", "wrong"), ValueError) else "taken"))
    return spark.createDataFrame(rows, "tool string, focus string, told string")


@_expect("name VARCHAR, score INTEGER, rank BIGINT", ("plus", 1, 1))
def tool_suggestions(spark: SparkSession) -> DataFrame:
    return _catalog(spark).suggestions("pluz").select("name", "score", "rank")


@_expect(
    "python_name VARCHAR, cpp_name VARCHAR, dispatch_key VARCHAR, file_path VARCHAR, line INTEGER, rank BIGINT, total BIGINT",
    ("plus_inner", "plus", None, PLUS, 4, 1, 4), ("mine.plus", "plus", None, REG, 3, 2, 4), ("mine.plus", "plus_impl", None, REG, 5, 3, 4),
)
def tool_search(spark: SparkSession) -> DataFrame:
    """The first three of the bindings that hold a name in any case, each (names, key) once."""
    return _catalog(spark).search("PLUS", limit=3).withColumn("file_path", _below(spark, "file_path")).select("python_name", "cpp_name", "dispatch_key", "file_path", "line", "rank", "total")


@_expect("python_name VARCHAR, cpp_name VARCHAR, dispatch_key VARCHAR, rank BIGINT, total BIGINT", ("_.plus", "TORCH_FN(plus_cuda", "CUDA", 1, 1))
def tool_search_backend(spark: SparkSession) -> DataFrame:
    return _catalog(spark).search("plus", backend="cud").select("python_name", "cpp_name", "dispatch_key", "rank", "total")


@_expect("name VARCHAR, line_number INTEGER, callers VARCHAR, rank BIGINT, total BIGINT", ("fill_kernel", 2, "launch_a,launch_b", 1, 2), ("add_kernel", 3, "launch_b", 2, 2))
def tool_search_kernels(spark: SparkSession) -> DataFrame:
    return _catalog(spark).search("kernel", "kernels").select("name", "line_number", _joined("callers").alias("callers"), "rank", "total")


@_expect(
    "query VARCHAR, name VARCHAR, file VARCHAR, line INTEGER, rank BIGINT, total BIGINT",
    ("calls plus", "other::helper", PLUS, 18, 1, 2), ("calls plus", "plus_kernel", PLUS, 8, 2, 2),
    ("callers plus_kernel", "other::helper", PLUS, 18, 1, 2), ("callers plus_kernel", "plus", PLUS, 16, 2, 2),
    ("callers helper", "at::native::minus", PLUS, 12, 1, 3), ("callers helper", "plus", PLUS, 16, 2, 3), ("callers helper", "plus_kernel", PLUS, 8, 3, 3),
)
def tool_graph_neighbours(spark: SparkSession) -> DataFrame:
    """Callees and callers, by the exact name and by the last part of a qualified one."""
    c, out = _catalog(spark), None
    for mode, q in (("calls", "plus"), ("callers", "plus_kernel"), ("callers", "helper")):
        rows = c.graph(q, mode).select(F.lit(f"{mode} {q}").alias("query"), "name", _below(spark, "file").alias("file"), "line", "rank", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@_expect(
    "asked INTEGER, name VARCHAR, depth BIGINT, line INTEGER, rank BIGINT, total BIGINT",
    (0, "other::helper", 1, 18, 1, 2), (0, "plus", 1, 16, 2, 2),
    (99, "other::helper", 1, 18, 1, 2), (99, "plus", 1, 16, 2, 2), (99, "at::native::minus", 2, 12, 1, 1),
)
def tool_graph_impact(spark: SparkSession) -> DataFrame:
    """Everything that calls a function, through a cycle; depths beyond one to five are taken as the nearest of them."""
    c, out = _catalog(spark), None
    for depth in (0, 99):
        rows = c.graph("plus_kernel", "impact", depth).select(F.lit(depth).alias("asked"), "name", "depth", "line", "rank", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@_expect("python_name VARCHAR, cpp_name VARCHAR, dispatch_key VARCHAR, rank BIGINT, total BIGINT", ("plus_inner", "plus", None, 1, 1))
def tool_graph_entry_points(spark: SparkSession) -> DataFrame:
    return _catalog(spark).graph("plus_kernel", "impact", 2, "full").select("python_name", "cpp_name", "dispatch_key", "rank", "total")


@_expect(
    "name VARCHAR, qualified_name VARCHAR, line_number INTEGER, bases VARCHAR, is_module BOOLEAN, docstring VARCHAR, methods VARCHAR, n_methods INTEGER, rank BIGINT, total BIGINT",
    ("Linear", "torch.nn.linear.Linear", 14, "Module", True, "A layer.", "__init__(self, n: int, *args, **kw) -> None;shape(self);wait(self)", 3, 1, 1),
)
def tool_modules_trace(spark: SparkSession) -> DataFrame:
    rows = _catalog(spark).modules("nn.linear", focus="full")
    return rows.select("name", "qualified_name", "line_number", _joined("bases").alias("bases"), "is_module", "docstring", F.array_join("methods", ";").alias("methods"), "n_methods", "rank", "total")


@_expect(
    "asked VARCHAR, place VARCHAR, name VARCHAR, rank BIGINT, total BIGINT",
    ("nn", "layers", "Linear", 1, 2), ("nn", "layers", "Stack", 2, 2), ("nn", "losses", "MSELoss", 1, 1), ("nn", "containers", "Sequential", 1, 1),
    ("optim", "", "SGD", 1, 1), ("lin", "", "Linear", 1, 1),
    ("all", "", "Indirect", 1, 8), ("all", "", "Linear", 2, 8), ("all", "", "MSELoss", 3, 8), ("all", "", "No2", 4, 8), ("all", "", "SGD", 5, 8), ("all", "", "Sequential", 6, 8), ("all", "", "Stack", 7, 8), ("all", "", "_Base", 8, 8),
)
def tool_modules_list(spark: SparkSession) -> DataFrame:
    """Groups of neural-network classes, optimizers, classes that hold a name, all."""
    c, out = _catalog(spark), None
    for q in ("nn", "optim", "lin", "all"):
        rows = c.modules(q, "list")
        rows = rows.select(F.lit(q).alias("asked"), (F.col("group") if q == "nn" else F.lit("")).alias("place"), "name", "rank", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@_expect("name VARCHAR, priority INTEGER, rank BIGINT", ("Linear", 3, 1))
def tool_similar_classes(spark: SparkSession) -> DataFrame:
    return _catalog(spark).similar_classes("nn.Lineer").select("name", "priority", "rank")


@_expect(
    "section VARCHAR, name VARCHAR, file VARCHAR, line INTEGER, extra VARCHAR, rank BIGINT, total BIGINT",
    ("opinfo", "plus", MORE, 1, None, 1, 1), ("functions", "test_plus", "test/test_plus.py", 2, "TestPlus", 1, 2), ("functions", "test_plus_too", "test/test_plus.py", 6, "NotATest", 2, 2),
    ("files", "test/test_plus.py", "test/test_plus.py", None, "3 classes, 4 tests", 1, 1),
)
def tool_tests_find(spark: SparkSession) -> DataFrame:
    return _catalog(spark).tests("plus").select("section", "name", "file", "line", "extra", "rank", "total")


@_expect(
    "section VARCHAR, name VARCHAR, line INTEGER, bases VARCHAR, file_rank BIGINT, n_files BIGINT, rank BIGINT, total BIGINT",
    ("class", "TestPlus", 1, "TestCase", 1, 1, 1, 3), ("class", "NotATest", 5, "", 1, 1, 2, 3), ("class", "Inner", 11, "MyTestBase", 1, 1, 3, 3),
    ("function", "TestPlus.test_plus", 2, None, 1, 1, 1, 4), ("function", "NotATest.test_plus_too", 6, None, 1, 1, 2, 4), ("function", "test_top", 7, None, 1, 1, 3, 4), ("function", "Inner.test_in", 12, None, 1, 1, 4, 4),
)
def tool_tests_of_file(spark: SparkSession) -> DataFrame:
    rows = _catalog(spark).tests("test_plus", "file_info")
    return rows.select("section", "name", "line", _joined("bases").alias("bases"), "file_rank", "n_files", "rank", "total")


@_expect("path VARCHAR", (COMMON,), (CORE,))
def tool_test_utilities(spark: SparkSession) -> DataFrame:
    return _catalog(spark).tests("", "utils").select("path")


@_expect("query VARCHAR, name VARCHAR, tier INTEGER", ("plus", "plus", 0), ("minus", "at::native::minus", 1), ("KERNEL", "plus_kernel", 2), ("helpr", "other::helper", 3))
def tool_vertices(spark: SparkSession) -> DataFrame:
    """Functions of the graph by name: exact, last part, part in any case, nearest."""
    from codeloom.operators import graph as G

    c = _catalog(spark)
    queries = spark.createDataFrame([("plus",), ("minus",), ("KERNEL",), ("helpr",)], "query string")
    return M.qualified_match(queries, G.vertices(c["call_edges"], c["function_locations"])).select("query", "name", "tier")


@_expect(
    "mode VARCHAR, shown VARCHAR",
    ("compact", "[Kernels]\nadd_kernel  aten/src/ATen/cuda/k.cu:3  ['launch_b']"),
    ("markdown", "## Kernels\n\n| name | file_path | callers |\n| ---- | --------- | ------- |\n| add_kernel | aten/src/ATen/cuda/k.cu:3 | ['launch_b'] |"),
)
def tool_rendered(spark: SparkSession) -> DataFrame:
    """A tool's rows as text, in both formats."""
    c, rows = _catalog(spark), []
    for mode in ("compact", "markdown"):
        render.set_mode(mode)
        try:
            rows.append((mode, c.render("Kernels", c.search("add_k", "kernels"))))
        finally:
            render.set_mode("compact")
    return spark.createDataFrame(rows, "mode string, shown string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
