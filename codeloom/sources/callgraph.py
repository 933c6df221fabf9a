"""Call edges of C++ sources listed in a compile database.

With libclang importable, each listed file is parsed with its own arguments. Without it a lexical reading stands in: definitions
by pattern with brace scopes, calls by pattern, resolved against the known definitions by their last name. That reading is approximate:
it does not resolve overloads, macros or templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.constants import CPP_DIRS, KEYWORDS
from codeloom.functions.predicates import excluded, in_dirs
from codeloom.functions.text import scope_base
from codeloom.schemas import SCHEMAS
from codeloom.sources.cxx import closing_brace
from codeloom.sources.files import exists

_DEFINITION = re.compile(r"(?<![\w:.>])((?:\w+::)*~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{")
_MACRO = re.compile(r"[A-Z][A-Z0-9_]+")
_CALL = re.compile(r"((?:\w+::)*\w+)\s*\(")
_SCOPE = re.compile(r"\b(?:namespace|class|struct)\s+((?:\w+::)*\w+)[^;{}()]*\{")


def compile_commands(spark: SparkSession, root: str, include_dirs: list[str] | None = None) -> DataFrame:
    """Entries of the compile database that are to be parsed: file (absolute), directory, arguments (kept ones)."""
    root = root.rstrip("/")
    path = next((p for p in (f"{root}/compile_commands.json", f"{root}/build/compile_commands.json") if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no compile_commands.json in {root} or its build directory")
    return entries(spark.read.schema(SCHEMAS["compile_commands"]).json(path, multiLine=True), root, include_dirs)


def entries(rows: DataFrame, root: str, include_dirs: list[str] | None = None) -> DataFrame:
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    rel = F.when(full.startswith(base + "/"), F.substring(full, len(base) + 1, 1 << 30)).otherwise(full)
    rows = rows.select(full.alias("file"), "directory", F.coalesce("arguments", F.split(F.trim("command"), " +")).alias("args"), rel.alias("rel"))
    rows = rows.where(F.col("file").endswith(".cpp") & in_dirs(F.col("file"), CPP_DIRS if include_dirs is None else include_dirs) & ~excluded(F.col("rel")))
    args = F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0)))
    joined = F.transform(args, lambda x, i: F.when((i > 0) & F.get(args, i - 1).isin("-I", "-D"), F.concat(F.get(args, i - 1), x)).otherwise(x))  # "-I dir" is one argument
    keep = F.filter(joined, lambda x: x.rlike("^-(I|D|std).+"))
    return rows.select("file", "directory", keep.alias("arguments"))


def lexical_facts(text: str) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """(definition, line) and (caller, name called) of one file."""
    scopes = [(m.start(), closing_brace(text, m.end() - 1), m[1]) for m in _SCOPE.finditer(text)]
    defs, calls = [], []
    for m in _DEFINITION.finditer(text):
        if scope_last(m[1]) in KEYWORDS or _MACRO.fullmatch(m[1]):
            continue
        inside = "::".join(s for a, b, s in scopes if a < m.start() < b)
        name = f"{inside}::{m[1]}" if inside else m[1]
        defs.append((name, text.count("\n", 0, m.start()) + 1))
        end = closing_brace(text, m.end() - 1)
        calls += [(name, c[1]) for c in _CALL.finditer(text, m.end(), end) if scope_last(c[1]) not in KEYWORDS]
    return defs, calls


def scope_last(name: str) -> str:
    return name.rpartition("::")[2]


def lexical_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, content) -> call_edges, function_locations.

    A call resolves to the definitions whose qualified name ends in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                defs, calls = lexical_facts(text or "")
                rows += [(path, name, line, None) for name, line in defs] + [(path, caller, None, callee) for caller, callee in calls]
            types = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "name", "line", "calls"])

    facts = files.select("path", "content").mapInArrow(run, "path string, name string, line int, calls string")
    defs = facts.where("calls is null")
    locations = defs.groupBy("name").agg(F.max_by(F.struct(F.col("path").alias("file"), "line"), F.struct("path", "line")).alias("x")).select("name", "x.*")
    known = locations.select(F.col("name").alias("callee"), scope_base(F.col("name")).alias("base"))
    calls = facts.where("calls is not null").select(F.col("name").alias("caller"), "calls", scope_base(F.col("calls")).alias("base")).distinct()
    hit = (F.col("callee") == F.col("calls")) | F.col("callee").endswith(F.concat(F.lit("::"), F.col("calls")))
    edges = calls.join(known, "base").where(hit & (F.col("caller") != F.col("callee"))).select("caller", "callee").distinct()
    return edges, locations


def clang_graph(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by libclang, one translation unit at a time on the executors. Needs the clang package there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from clang.cindex import CursorKind, Index

        defining = (CursorKind.FUNCTION_DECL, CursorKind.CXX_METHOD)

        def full(c) -> str:
            names = []
            while c is not None and c.kind != CursorKind.TRANSLATION_UNIT:
                names += [c.spelling] if c.spelling else []
                c = c.semantic_parent
            return "::".join(reversed(names))

        for batch in batches:
            rows = []
            for path, args in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                todo = [(Index.create().parse(path, args=args or []).cursor, None)]
                while todo:
                    c, inside = todo.pop()
                    if c.kind in defining and c.is_definition():
                        inside = full(c)
                        rows.append((path, inside, c.location.line, None))
                    elif c.kind == CursorKind.CALL_EXPR and inside and c.referenced is not None and (to := full(c.referenced)) not in ("", inside):
                        rows.append((path, inside, None, to))
                    todo += [(x, inside) for x in c.get_children()]
            types = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "name", "line", "calls"])

    facts = commands.select("file", "arguments").mapInArrow(run, "path string, name string, line int, calls string")
    edges = facts.where("calls is not null").select(F.col("name").alias("caller"), F.col("calls").alias("callee")).distinct()
    locations = facts.where("calls is null").groupBy("name").agg(F.max_by(F.struct(F.col("path").alias("file"), "line"), F.struct("path", "line")).alias("x")).select("name", "x.*")
    return edges, locations


def call_graph(spark: SparkSession, root: str, files: DataFrame, include_dirs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """By libclang where it and a compile database are there, else the lexical reading of files (of the database's, if there is one)."""
    try:
        commands = compile_commands(spark, root, include_dirs)
    except FileNotFoundError:
        return lexical_graph(files)
    try:
        import clang.cindex  # noqa: F401
    except ImportError:
        return lexical_graph(files.join(commands.select(F.col("file").alias("path")), "path", "left_semi"))
    return clang_graph(commands)
