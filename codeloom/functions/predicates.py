"""Predicates on paths, contents and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.constants import BINDING_MARKS, EXCLUDED, TEST_MARKS


def holds_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def excluded(path: Column, parts: list[str] | None = None) -> Column:
    """path: relative to the root, with a leading slash, so where a checkout lies does not matter."""
    return holds_any(F.lower(path), EXCLUDED if parts is None else parts)


def in_dirs(path: Column, dirs: list[str]) -> Column:
    return holds_any(path, dirs)


def has_bindings(content: Column) -> Column:
    return holds_any(content, BINDING_MARKS)


def has_tests(content: Column) -> Column:
    return holds_any(content, TEST_MARKS)


def in_main_tests(path: Column) -> Column:
    return F.contains(path, F.lit("/test/")) & ~F.contains(path, F.lit("/testing/"))


def skipped_python(rel_path: Column) -> Column:
    """rel_path: below the scanned directory."""
    name = F.element_at(F.split(rel_path, "/"), -1)
    return F.contains(rel_path, F.lit("/test")) | F.contains(name, F.lit("test_")) | F.contains(rel_path, F.lit("__pycache__"))


def holds(text: Column, part: Column | str) -> Column:
    """Whether text holds part, in any case; a null text is empty."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(part))


def word_match(query: Column, name: Column) -> Column:
    """Whether the first place of query in name, in any case, has no letter on either side. Later places do not count."""
    q, n = F.lower(query), F.lower(name)
    at = F.instr(n, q)
    before, after = F.substring(n, at - 1, F.lit(1)), F.substring(n, at + F.length(q), F.lit(1))
    return (at > 0) & ~F.when(at > 1, before.rlike("^\\p{L}")).otherwise(F.lit(False)) & ~after.rlike("^\\p{L}")


def module_groups(name: Column) -> Column:
    """Groups of a neural-network class by its name; a class may be in two."""
    layer = ~holds_any(name, ["Loss", "Container", "Sequential"])
    box = holds_any(name, ["Container", "Sequential", "ModuleList", "ModuleDict"])
    return F.array_compact(F.array(F.when(layer, F.lit("layers")), F.when(F.contains(name, F.lit("Loss")), F.lit("losses")), F.when(box, F.lit("containers"))))


def is_optimizer(qualified_name: Column, name: Column) -> Column:
    return F.contains(F.lower(qualified_name), F.lit("optim")) & ~name.startswith("_")
