"""Scalar functions on columns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.constants import EXCERPT_WIDTH, KEYWORDS, PATH_PREFIXES, RE_ENCLOSING


def truncate(text: Column, width: int = 80) -> Column:
    """Null gives an empty string; longer texts end in three dots and have exactly width characters."""
    return F.when(F.length(text) <= width, text).when(text.isNotNull(), F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(F.lit(""))


def excerpt(text: Column, width: int = EXCERPT_WIDTH) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def relative_path(path: Column, base: str | None = None, prefixes: list[str] | None = None) -> Column:
    """The path without the first prefix it starts with; null gives an empty string."""
    out = F.coalesce(path, F.lit(""))
    chain = None
    for p in ([base.rstrip("/") + "/"] if base else []) + (PATH_PREFIXES if prefixes is None else prefixes):
        cut = F.substring(out, len(p) + 1, 1 << 30)
        chain = F.when(out.startswith(p), cut) if chain is None else chain.when(out.startswith(p), cut)
    return out if chain is None else chain.otherwise(out)


def scope_base(name: Column) -> Column:
    """What follows the last ``::``."""
    return F.element_at(F.split(name, "::"), -1)


def dotted_base(name: Column) -> Column:
    return F.element_at(F.split(name, "\\."), -1)


def overload_base(name: Column) -> Column:
    """What precedes the first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def qualified(parent: Column, name: Column, separator: str = "::") -> Column:
    return F.concat_ws(separator, F.when(parent != "", parent), name)


def md5_prefix(text: Column, n: int) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, n)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def megabytes(n: Column) -> Column:
    return F.format_number(n / (1 << 20), 1)


def minute(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def location(path: Column, line: Column) -> Column:
    """path:line, the path alone without a line, null without a path."""
    return F.when(path != "", F.concat_ws(":", path, line.cast("string")))


def nulls_last(column: Column) -> list[Column]:
    return [column.asc_nulls_last()]


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def newlines(text: Column) -> Column:
    """Line ends of any system as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


MATCH = "array<struct<m:string,pos:int,line:int>>"
#: Matches that are folded at once: work grows with the matches and not with their square.
PART = 256


def _let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Every match from left to right: its text, the characters before it and its line. Pieces and matches are folded in parts."""
    whole = f"(?U)({pattern})"
    found, gaps = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.split(text, whole, -1)
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("gap")), lambda x: x["m"].isNotNull())
    steps = F.transform(pairs, lambda x: F.struct(x["m"].alias("m"), F.length(x["gap"]).alias("before"), F.length(x["m"]).alias("size"), lines(x["gap"]).alias("above"), lines(x["m"]).alias("within")))
    total = lambda p, a, b: F.aggregate(p, F.lit(0), lambda n, x: n + x[a] + x[b])
    kind = f"struct<pos:int,line:int,all:{MATCH}>"

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["m"].alias("m"), (acc["pos"] + x["before"]).alias("pos"), (acc["line"] + x["above"]).alias("line"))
        return F.struct((acc["pos"] + x["before"] + x["size"]).alias("pos"), (acc["line"] + x["above"] + x["within"]).alias("line"), F.concat(acc["all"], F.array(here)).alias("all"))

    def running(parts: Column, a: str, b: str, first: int) -> Column:
        """What lies before each part."""
        return F.aggregate(F.transform(parts, lambda p: total(p, a, b)), F.array(F.lit(first)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def fold(parts: Column) -> Column:
        begin = lambda s, i: F.struct(F.get(s["pos"], i).alias("pos"), F.get(s["line"], i).alias("line"), F.array().cast(MATCH).alias("all")).cast(kind)
        starts = F.struct(running(parts, "before", "size", 0).alias("pos"), running(parts, "above", "within", 1).alias("line"))
        return _let(starts, lambda s: F.flatten(F.transform(parts, lambda p, i: F.aggregate(p, begin(s, i), step)["all"])))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / PART).cast("int"), F.lit(0))), lambda c: F.slice(x, c * PART + 1, F.lit(PART)))
    return F.when(text.rlike(whole), _let(_let(steps, cut), fold)).otherwise(F.array().cast(MATCH))


def enclosing(text: Column, pos: Column, skip_keywords: bool = True) -> Column:
    """Name of the last function-like head in the first pos characters; null without one.

    skip_keywords: heads such as ``if (x) {`` are passed over.
    """
    names = F.regexp_extract_all(F.substring(text, F.lit(1), pos), F.lit(f"(?U){RE_ENCLOSING}"), F.lit(1))
    if skip_keywords:
        names = F.filter(names, lambda x: ~x.isin(KEYWORDS))
    return F.try_element_at(names, F.lit(-1))
