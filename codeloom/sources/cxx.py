"""Facts from C++ and CUDA sources.

What a pattern finds anywhere in a file (implementations, kernels, launches, dispatch macros) is extracted by built-in functions with
line numbers. What depends on a block's scope (module and library blocks, classes and their methods) needs brace matching and
comes from ``block_bindings``, run over Arrow batches and available as a table function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.text import enclosing, matches, newlines, truncate

#: Phases of a file's bindings, in the order in which they are told.
MODULE, STANDALONE, LIBRARY, IMPL, KERNEL, DISPATCH = range(6)
_PHASE = 1 << 40
BINDING = "python_name string, cpp_name string, type string, file_path string, line int, dispatch_key string, namespace string, cuda_kernel string, signature string, ord long"


def closing_brace(text: str, start: int) -> int:
    """Just past the brace that closes the one at start, or the end. Strings and comments are not told apart."""
    depth = 0
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _block(text: str, after: int) -> tuple[int, int] | None:
    start = text.find("{", after)
    return None if start < 0 else (start, closing_brace(text, start))


def _until(text: str, start: int, end: int, *marks: str) -> int:
    return min([end, *[at for m in marks if (at := text.find(m, start, end)) >= 0]])


def block_bindings(text: str) -> list[tuple]:
    """(python_name, cpp_name, type, line, dispatch_key, namespace, signature, ord) of modules, classes and libraries."""
    out: list[tuple] = []
    line = lambda at: text.count("\n", 0, at) + 1

    def tell(phase: int, python: str, cpp: str, kind: str, at: int, line_no: int | None = None, key=None, namespace=None, signature=None) -> None:
        out.append((python, cpp, kind, line(at) if line_no is None else line_no, key, namespace, signature, phase * _PHASE + len(out)))

    for head in re.finditer(C.RE_MODULE_BLOCK, text):
        if not (block := _block(text, head.end())):
            continue
        start, end = block
        for m in re.compile(C.RE_FUNCTION_DEF).finditer(text, start, end):
            tell(MODULE, m[1], m[2], "pybind_function", m.start(), namespace=head[1])
        for m in re.compile(C.RE_MODULE_CLASS).finditer(text, start, end):
            owner = m[1].split(",")[0].strip()
            tell(MODULE, m[2], owner, "pybind_class", m.start(), namespace=head[1])
            stop = _until(text, m.end(), end, ";", "py::class_") if text.find(";", m.end(), end) >= 0 else end
            for x in re.compile(C.RE_METHOD_REF).finditer(text, m.end(), stop):
                tell(MODULE, f"{m[2]}.{x[1]}", x[2], "pybind_method", x.start(), namespace=head[1])
    for m in re.finditer(C.RE_ANY_CLASS, text):
        owner = m[1].split(",")[0].strip()
        tell(STANDALONE, m[2], owner, "pybind_class", m.start())
        for x in re.compile(C.RE_METHOD).finditer(text, m.end(), _until(text, m.end(), len(text), "py::class_")):
            tell(STANDALONE, f"{m[2]}.{x[1]}", f"{owner}::{x[1]}", "pybind_method", x.start())
    for phase, pattern in ((LIBRARY, C.RE_LIBRARY), (IMPL, C.RE_LIBRARY_IMPL)):
        for head in re.finditer(pattern, text):
            if not (block := _block(text, head.end())):
                continue
            start, end = block
            key, base = head[2] if phase == IMPL else None, line(head.start())
            at = lambda m, base=base, start=start: base + text.count("\n", start, m.start())  # noqa: E731  lines of a block count from its macro
            for p in C.RE_OP_DEFS:
                for m in re.compile(p).finditer(text, start, end):
                    if name := re.match(C.RE_OP_NAME, m[1]):
                        tell(phase, f"{head[1]}.{name[1]}", name[1], "torch_op", m.start(), at(m), key, head[1], m[1])
            for m in re.compile(C.RE_OP_IMPL).finditer(text, start, end):
                tell(phase, f"{head[1]}.{m[1]}", m[2], "torch_library_impl", m.start(), at(m), key, head[1])
    return out


_BLOCK_TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
_BLOCK_NAMES = ("python_name", "cpp_name", "type", "line", "dispatch_key", "namespace", "signature", "ord")


def _block_rows(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows = [], []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = block_bindings(text or "")
                rows += found
                paths += [path] * len(found)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_BLOCK_TYPES)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *columns], names=["file_path", *_BLOCK_NAMES])

    rows = files.select("path", "content").mapInArrow(run, "file_path string, python_name string, cpp_name string, type string, line int, dispatch_key string, namespace string, signature string, ord long")
    return rows.withColumn("cuda_kernel", F.lit(None).cast("string"))


def register_table_function(spark) -> None:
    """SQL: SELECT * FROM block_bindings(content)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="python_name string, cpp_name string, type string, line int, dispatch_key string, namespace string, signature string, ord long")
    class BlockBindings:
        def eval(self, content: str):
            yield from block_bindings(content or "")

    spark.udtf.register("block_bindings", BlockBindings)


def kernels(files: DataFrame, skip_keywords: bool = True) -> DataFrame:
    """cuda_kernels of .cu and .cuh files; called_by: functions around the launches, each once, in order of place."""
    text = F.col("content")
    rows = files.where(F.col("ext").isin("cu", "cuh")).select("path", "content", matches(text, C.RE_KERNEL).alias("k"), matches(text, C.RE_LAUNCH).alias("l")).where(F.size("k") > 0)
    launch = F.transform("l", lambda x: F.named_struct(F.lit("name"), F.regexp_extract(x["m"], f"(?U){C.RE_LAUNCH}", 1), F.lit("by"), enclosing(text, x["pos"], skip_keywords)))
    rows = rows.select("path", launch.alias("l"), F.posexplode("k").alias("i", "k"))
    part = lambda g: F.nullif(F.regexp_extract("k.m", f"(?U){C.RE_KERNEL}", g), F.lit(""))
    rows = rows.select("path", "i", "l", F.col("k.line").alias("line"), part(1).alias("name"), part(2).alias("template_params"), F.regexp_extract("k.m", f"(?U){C.RE_KERNEL}", 3).alias("parameters"))
    by = F.array_distinct(F.array_compact(F.transform(F.filter("l", lambda x: x["name"].endswith(F.col("name"))), lambda x: x["by"])))
    return rows.select("name", F.col("path").alias("file_path"), F.col("line").alias("line_number"), "template_params", "parameters", by.alias("called_by"), F.col("i").cast("long").alias("ord"))


def dispatches(files: DataFrame, skip_keywords: bool = True) -> DataFrame:
    """Bindings of dispatch macros: the operator's name, and the function around the macro."""
    rows = files.select("path", "content", F.posexplode(matches(F.col("content"), C.RE_DISPATCH)).alias("i", "x"))
    part = lambda g: F.regexp_extract("x.m", f"(?U){C.RE_DISPATCH}", g)
    none = F.lit(None).cast("string")
    return rows.select(
        part(3).alias("python_name"), F.coalesce(enclosing(F.col("content"), F.col("x.pos"), skip_keywords), part(3)).alias("cpp_name"), F.lit("at_dispatch").alias("type"),
        F.col("path").alias("file_path"), F.col("x.line").alias("line"), none.alias("dispatch_key"), none.alias("namespace"), none.alias("cuda_kernel"),
        F.concat(part(1), F.lit("("), part(2), F.lit(")")).alias("signature"), (F.lit(DISPATCH * _PHASE) + F.col("i")).alias("ord"),
    )


def bindings(files: DataFrame, cuda: DataFrame, skip_keywords: bool = True) -> DataFrame:
    """All bindings: blocks, kernels (under the key CUDA) and dispatch macros."""
    none = F.lit(None).cast("string")
    from_kernels = cuda.select(
        F.col("name").alias("python_name"), F.col("name").alias("cpp_name"), F.lit("cuda_kernel").alias("type"), "file_path", F.col("line_number").alias("line"),
        F.lit("CUDA").alias("dispatch_key"), none.alias("namespace"), none.alias("cuda_kernel"), F.col("parameters").alias("signature"), (F.lit(KERNEL * _PHASE) + F.col("ord")).alias("ord"),
    )
    return _block_rows(files).unionByName(from_kernels).unionByName(dispatches(files, skip_keywords))


def detect_bindings(spark, path: str, content: str) -> DataFrame:
    """Bindings of one file's content, which need not lie anywhere."""
    one = spark.createDataFrame([(path, path.rpartition(".")[2], content)], "path string, ext string, content string").withColumn("content", newlines(F.col("content")))
    return bindings(one, kernels(one))


def implementations(files: DataFrame, targets: DataFrame) -> DataFrame:
    """native_implementations: definitions at line starts whose name is in targets (name)."""
    parts = []
    for phase, pattern in enumerate((C.RE_IMPLEMENTATION, C.RE_QUALIFIED_IMPLEMENTATION)):
        rows = files.select("path", "content", F.posexplode(matches(F.col("content"), f"(?md){pattern}")).alias("i", "x"))
        rest = F.substring("content", F.col("x.pos") + 1, F.length("content"))
        head = F.when(F.instr(rest, "\n") > 0, F.trim(F.substring_index(rest, "\n", 1))).otherwise(F.lit(""))
        name = F.regexp_extract("x.m", f"(?Umd){pattern}", 1)
        parts.append(rows.select(name.alias("function_name"), F.col("path").alias("file_path"), F.col("x.line").alias("line_number"), truncate(head, C.SIGNATURE_WIDTH).alias("signature"), (F.lit(phase * _PHASE) + F.col("i")).alias("ord")))
    rows = parts[0].unionByName(parts[1])
    return rows.join(targets.select(F.col("name").alias("function_name")), "function_name", "left_semi").select("function_name", "file_path", "line_number", "signature", "ord")
