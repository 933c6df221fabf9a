"""Call graph operators: neighbours, bounded impact, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.constants import MAX_DEPTH
from codeloom.functions.text import clamp
from codeloom.operators.match import qualified_match
from codeloom.operators.ranking import dedupe_first, top_k_with_total
from codeloom.sources.store import materialize


def _named_in(edges: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """name, with repeats."""
    out = edges.select(F.col("caller").alias("name")).union(edges.select(F.col("callee").alias("name")))
    if locations is not None:
        out = out.union(locations.select("name"))
    return out.where("name is not null")


def vertices(edges: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """name: every caller, callee and located function, once."""
    return _named_in(edges, locations).distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """Distinct calls between different functions. Partial distincts of each task come before the shuffle."""
    return edges.where("caller <> callee").select("caller", "callee").distinct()


def _named(spark, name: str, column: str = "query") -> DataFrame:
    return spark.range(1).select(F.lit(name).alias(column))


def neighbours(edges: DataFrame, locations: DataFrame, queries: DataFrame, outgoing: bool, fuzzy: bool = True) -> DataFrame:
    """query, matched, name, file, line: callees (outgoing) or callers of every function that matches a query."""
    near, far = ("caller", "callee") if outgoing else ("callee", "caller")
    found = qualified_match(queries, _named_in(edges, locations), fuzzy).select("query", F.col("name").alias("matched"))
    steps = found.join(edges.select(F.col(near).alias("matched"), F.col(far).alias("name")), "matched")
    return steps.join(locations.select("name", "file", "line"), "name", "left").select("query", "matched", "name", "file", "line")


def listed(edges: DataFrame, locations: DataFrame, name: str, outgoing: bool, k: int = 15) -> DataFrame:
    """name, file, line, rank, total: neighbours of one function, each once, the first k and how many there are."""
    rows = neighbours(edges, locations, _named(edges.sparkSession, name), outgoing)
    rows = dedupe_first(rows.drop("query"), ["name"], ["matched"]).drop("matched")
    return top_k_with_total(rows, k, [F.col("name")])


#: Names of this many bytes together are sent to every task; more are joined by a shuffle.
SMALL = 32 << 20


def _sized(names: DataFrame) -> tuple[int, int]:
    """Rows and bytes of the names of a level that lies in the shared folder."""
    n, size = names.agg(F.count(F.lit(1)), F.sum(F.octet_length("name"))).first()
    return n, size or 0


def impact(edges: DataFrame, name: str, depth: int = 2, fuzzy: bool = True, limit_depth: int = MAX_DEPTH) -> DataFrame:
    """name, depth: everything that calls the function, over at most depth steps (1 to limit_depth), at its least depth.

    The first step starts from all functions that match the name; only the literal name is never reported. Each level is one semi join of the
    edges with the frontier and one anti join with what was seen, written to the shared folder: no level is computed twice, and a
    lost executor costs one level at most. Every level is measured, and sent to all tasks if it is small: then the edges are scanned where they lie,
    however many of them one callee has. A large frontier is joined by a shuffle, in which the edges' side may be split.
    """
    depth = clamp(depth, 1, limit_depth)
    spark = edges.sparkSession
    if edges.where((F.col("caller") == name) | (F.col("callee") == name)).isEmpty():  # an exact name needs no look at all others
        start = qualified_match(_named(spark, name), _named_in(edges), fuzzy).select("name")
        start = materialize(start, "impact-0")
        size = _sized(start)[1]
    else:
        start, size = _named(spark, name, "name"), len(name)
    sent = lambda df, size: F.broadcast(df) if size <= SMALL else df
    frontier, seen, total = start, None, 0
    for level in range(1, depth + 1):
        step = edges.join(sent(frontier.withColumnRenamed("name", "callee"), size), "callee", "left_semi").select(F.col("caller").alias("name")).where(F.col("name") != name).distinct()
        if seen is not None:
            step = step.join(sent(seen.select("name"), total), "name", "left_anti")
        step = materialize(step.withColumn("depth", F.lit(level).cast("long")), f"impact-{level}")
        n, size = _sized(step)
        seen, total = step if seen is None else seen.unionByName(step), total + size
        if not n:
            break
        frontier = step.select("name")
    return seen


def impact_totals(levels: DataFrame) -> DataFrame:
    """depth (null: all), n."""
    return levels.rollup("depth").agg(F.count(F.lit(1)).alias("n"))


def entry_points(levels: DataFrame, bindings: DataFrame, k: int = 10) -> DataFrame:
    """python_name, cpp_name, dispatch_key, rank, total: the first binding of each impacted function."""
    keys = levels.select(F.col("name").alias("cpp_name")).distinct()
    first = dedupe_first(bindings.join(keys, "cpp_name", "left_semi").select("cpp_name", "python_name", "dispatch_key", "file_path", "ord"), ["cpp_name"], ["file_path", "ord"])
    return top_k_with_total(first.select("python_name", "cpp_name", "dispatch_key"), k, [F.col("cpp_name")])
