"""Facts from Python sources: one pass of the parser for each file, as nested rows; the tables are exploded from them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.text import matches
from codeloom.sources.files import exists

_FUNCTION = pa.struct([("name", pa.string()), ("qualified_name", pa.string()), ("file_path", pa.string()), ("line_number", pa.int32()), ("is_method", pa.bool_()), ("is_async", pa.bool_()), ("decorators", pa.list_(pa.string())), ("docstring", pa.string()), ("signature", pa.string()), ("class_name", pa.string()), ("cpp_binding", pa.string())])
_CLASS = pa.struct([("module", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("file_path", pa.string()), ("line_number", pa.int32()), ("bases", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())), ("docstring", pa.string()), ("is_module", pa.bool_()), ("methods", pa.list_(_FUNCTION))])
_IMPORT = pa.struct([("module", pa.string()), ("name", pa.string()), ("alias", pa.string()), ("line_number", pa.int32())])
_MODULE = [("name", pa.string()), ("file_path", pa.string()), ("exports", pa.list_(pa.string())), ("classes", pa.list_(_CLASS)), ("functions", pa.list_(_FUNCTION)), ("imports", pa.list_(_IMPORT))]


def dotted(node: ast.AST | None) -> str:
    """Dotted name of an expression; of a call or subscript, that of what is called or indexed; else empty."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=value, attr=attr):
            return f"{dotted(value)}.{attr}"
        case ast.Call(func=inner) | ast.Subscript(value=inner):
            return dotted(inner)
        case ast.Constant(value=value):
            return str(value)
    return ""


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    first = next((i for i, p in enumerate(parts) if p in C.PACKAGE_ROOTS), None)
    if first is None:
        return parts[-1]
    return ".".join(parts[first : -1 if parts[-1] == "__init__" else None])


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    args = [a.arg + (f": {dotted(a.annotation)}" if a.annotation else "") for a in node.args.args]
    args += [f"*{node.args.vararg.arg}"] if node.args.vararg else []
    args += [f"**{node.args.kwarg.arg}"] if node.args.kwarg else []
    text = f"({', '.join(args)})" + (f" -> {dotted(node.returns)}" if node.returns else "")
    return text if len(text) <= C.SIGNATURE_WIDTH else text[: C.SIGNATURE_WIDTH - 3] + "..."


def native_call(node: ast.AST) -> str | None:
    calls = (dotted(n.func) for n in ast.walk(node) if isinstance(n, ast.Call))
    return next((c for c in calls if any(m in c for m in C.NATIVE_CALL_MARKS)), None)


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _outer(node: ast.AST) -> Iterator[ast.AST]:
    """Statements outside of any function or class, also those below if, try and with."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, (*_DEFS, ast.ClassDef, ast.Lambda)):
            yield from _outer(child)


def parse_module(path: str, text: str) -> dict | None:
    """Nested row of one file; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    module = module_name(path)

    def function(node, owner: dict | None) -> dict:
        scope = owner["qualified_name"] if owner else module
        return {
            "name": node.name, "qualified_name": f"{scope}.{node.name}", "file_path": path, "line_number": node.lineno, "is_method": owner is not None,
            "is_async": isinstance(node, ast.AsyncFunctionDef), "decorators": [dotted(d) for d in node.decorator_list], "docstring": ast.get_docstring(node),
            "signature": signature(node), "class_name": owner and owner["name"], "cpp_binding": native_call(node),
        }

    out = {"name": module, "file_path": path, "exports": [], "classes": [], "functions": [], "imports": []}
    for node in _outer(tree):
        if isinstance(node, ast.ClassDef):
            bases = [dotted(b) for b in node.bases]
            row = {"module": module, "name": node.name, "qualified_name": f"{module}.{node.name}", "file_path": path, "line_number": node.lineno, "bases": bases, "decorators": [dotted(d) for d in node.decorator_list], "docstring": ast.get_docstring(node), "is_module": any(b in C.MODULE_BASES for b in bases)}
            row["methods"] = [function(n, row) for n in node.body if isinstance(n, _DEFS)]
            out["classes"].append(row)
        elif isinstance(node, _DEFS):
            out["functions"].append(function(node, None))
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "name": a.name, "alias": a.asname, "line_number": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"] += [{"module": node.module or "", "name": a.name, "alias": a.asname, "line_number": node.lineno} for a in node.names]
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.List) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            out["exports"] += [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return out


def analyze_file(spark: SparkSession, path: str) -> dict | None:
    """The nested row of one file; None if it is no Python file, missing or does not parse."""
    if not path.endswith(".py") or not exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8", errors="ignore")
    finally:
        stream.close()
    return parse_module(path, text)


def _parsed(files: DataFrame, parse, fields: list[tuple], ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, q, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if (r := parse(p, q, t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    return files.select("path", "rel_path", "content").mapInArrow(run, ddl)


_F = "struct<name:string,qualified_name:string,file_path:string,line_number:int,is_method:boolean,is_async:boolean,decorators:array<string>,docstring:string,signature:string,class_name:string,cpp_binding:string>"


def python_tables(files: DataFrame) -> dict[str, DataFrame]:
    """py_modules, py_classes, py_functions, py_imports. Of two files with one module name the later path counts."""
    ddl = f"name string, file_path string, exports array<string>, classes array<struct<module:string,name:string,qualified_name:string,file_path:string,line_number:int,bases:array<string>,decorators:array<string>,docstring:string,is_module:boolean,methods:array<{_F}>>>, functions array<{_F}>, imports array<struct<module:string,name:string,alias:string,line_number:int>>"
    rows = _parsed(files, lambda path, rel, text: parse_module(path, text), _MODULE, ddl)
    rows = rows.groupBy("name").agg(F.max_by(F.struct("file_path", "exports", "classes", "functions", "imports"), "file_path").alias("m")).select("name", "m.*")
    tell = lambda c: rows.select(F.posexplode(c).alias("ord", "x"))
    methods = rows.select(F.posexplode("classes").alias("i", "c")).select("i", F.posexplode("c.methods").alias("j", "x"))
    return {
        "py_modules": rows.select("name", "file_path", "exports"),
        "py_classes": tell("classes").select("x.*", F.col("ord").cast("long").alias("ord")),
        "py_functions": tell("functions").select("x.*", F.col("ord").cast("long").alias("ord")).unionByName(methods.select("x.*", ((F.col("i") + 1) * F.lit(1 << 20) + F.col("j")).cast("long").alias("ord"))),
        "py_imports": rows.select("file_path", F.explode("imports").alias("x")).select("x.module", "x.name", "x.alias", "file_path", "x.line_number"),
    }


def exports_index(modules: DataFrame) -> DataFrame:
    """export, module: the last module, by path, that exports a name."""
    rows = modules.select("name", "file_path", F.explode("exports").alias("export"))
    return rows.groupBy("export").agg(F.max_by("name", "file_path").alias("module"))


_TEST_CLASS = pa.struct([("name", pa.string()), ("line", pa.int32()), ("bases", pa.list_(pa.string())), ("is_test_class", pa.bool_())])
_TEST_FUNCTION = pa.struct([("name", pa.string()), ("class", pa.string()), ("line", pa.int32())])


def parse_tests(path: str, rel_path: str, text: str, with_async: bool = False) -> dict | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    kinds = _DEFS if with_async else (ast.FunctionDef,)
    classes, functions = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            bases = [dotted(b) for b in node.bases]
            classes.append({"name": node.name, "line": node.lineno, "bases": bases, "is_test_class": any("TestCase" in b or "TestBase" in b for b in bases)})
            functions += [{"name": n.name, "class": node.name, "line": n.lineno} for n in node.body if isinstance(n, kinds) and n.name.startswith("test_")]
        elif isinstance(node, kinds) and node.name.startswith("test_") and node.col_offset == 0:
            functions.append({"name": node.name, "class": None, "line": node.lineno})
    return {"path": rel_path, "full_path": path, "classes": classes, "functions": functions}


def test_tables(files: DataFrame, with_async: bool = False) -> dict[str, DataFrame]:
    """test_files, test_classes, test_functions. with_async: async tests count too."""
    fields = [("path", pa.string()), ("full_path", pa.string()), ("classes", pa.list_(_TEST_CLASS)), ("functions", pa.list_(_TEST_FUNCTION))]
    ddl = "path string, full_path string, classes array<struct<name:string,line:int,bases:array<string>,is_test_class:boolean>>, functions array<struct<name:string,class:string,line:int>>"
    rows = _parsed(files, lambda path, rel, text: parse_tests(path, rel, text, with_async), fields, ddl)
    return {
        "test_files": rows.select("path", "full_path", F.size("classes").cast("long").alias("n_classes"), F.size("functions").cast("long").alias("n_functions")),
        "test_classes": rows.select("path", F.posexplode("classes").alias("ord", "x")).select("x.name", F.col("path").alias("file"), "x.line", "x.bases", "x.is_test_class", F.col("ord").cast("long").alias("ord")),
        "test_functions": rows.select("path", F.posexplode("functions").alias("ord", "x")).select("x.name", "x.class", F.col("path").alias("file"), "x.line", F.col("ord").cast("long").alias("ord")),
    }


def opinfo(files: DataFrame) -> DataFrame:
    """opinfo_registry: of a name defined twice, the last by path and place."""
    rows = files.select("rel_path", F.posexplode(matches(F.col("content"), C.RE_OPINFO)).alias("i", "x"))
    rows = rows.select(F.regexp_extract("x.m", f"(?U){C.RE_OPINFO}", 1).alias("name"), F.col("rel_path").alias("file"), F.col("x.line").alias("line"), "i")
    return rows.groupBy("name").agg(F.max_by(F.struct("file", "line"), F.struct("file", "i")).alias("x")).select("name", "x.*")
