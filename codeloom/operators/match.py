"""Fuzzy lookup: sets of queries against sets of names.

A query list is the small side: it is counted, and sent to every task if it has at most ``MAX_QUERIES`` queries. Names are
scanned once, whatever their number: length bands come first, then the three-argument levenshtein, which gives up at the bound. The best
name of each query is a min_by, so only one row for each query and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import scope_base
from codeloom.operators.ranking import best_tier, top_k
from codeloom.sources.store import materialize

MAX_QUERIES = 10_000


def _listed(queries: DataFrame) -> tuple[DataFrame, bool]:
    """The queries, each once, and whether they are few enough to be sent to every task."""
    queries = queries.select("query").where("query is not null").distinct()
    return queries, queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES


def _pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Every name beside every query of the list. A long list is not sent whole: Spark pairs partitions of it with partitions of the names."""
    queries, few = _listed(queries)
    return names.crossJoin(F.broadcast(queries) if few else queries)


def _low(c: str) -> Column:
    return F.lower(F.col(c))


def _distance(name: Column, bound: Column, band: int) -> Column:
    """Edit distance to the query, or null beyond bound or off the length band."""
    near = F.abs(F.length(name) - F.length("query")) <= band
    d = F.levenshtein(_low("query"), F.lower(name))
    return F.when(near, F.when(d <= bound, d))


def _bound(least: int, part: int) -> Column:
    return F.greatest(F.lit(least), F.floor(F.length("query") / part)).cast("int")


def fuzzy_find(queries: DataFrame, names: DataFrame) -> DataFrame:
    """names (name, ord) -> query, name, tier: 0 exact, 1 the first that ends in it, 2 the shortest that holds it, 3 the nearest."""
    d = F.when(F.length("query") >= 3, _distance(F.col("name"), _bound(2, 3), 3))
    tier = F.when(F.col("name") == F.col("query"), 0).when(_low("name").endswith(_low("query")), 1).when(_low("name").contains(_low("query")), 2).when(d.isNotNull(), 3)
    rows = _pairs(queries, names).withColumn("tier", tier).where("tier is not null")
    by = F.when(F.col("tier") == 2, F.length("name")).when(F.col("tier") == 3, d).otherwise(0)
    best = rows.groupBy("query").agg(F.min(F.struct("tier", by.alias("by"), "ord", "name")).alias("x"))
    return best.select("query", F.col("x.name").alias("name"), F.col("x.tier").alias("tier"))


def native_lookup(queries: DataFrame, functions: DataFrame) -> DataFrame:
    """functions (lookup_name, base_name, ord) -> query, lookup_name, tier: 0 exact, 1 equal in any case (or its base), 2 shortest holding it."""
    same = (_low("lookup_name") == _low("query")) | (F.lower(F.coalesce("base_name", F.lit(""))) == _low("query"))
    tier = F.when(F.col("lookup_name") == F.col("query"), 0).when(same, 1).when(_low("lookup_name").contains(_low("query")), 2)
    rows = _pairs(queries, functions.select("lookup_name", "base_name", "ord")).withColumn("tier", tier).where("tier is not null")
    by = F.when(F.col("tier") == 2, F.length("lookup_name")).otherwise(0)
    best = rows.groupBy("query").agg(F.min(F.struct("tier", by.alias("by"), "ord", "lookup_name")).alias("x"))
    return best.select("query", F.col("x.lookup_name").alias("lookup_name"), F.col("x.tier").alias("tier"))


def similar_names(queries: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """names (name distinct, ord) -> query, name, score, rank: those that hold the query (score 0) and near ones (their distance)."""
    d = F.when(F.length("name") < 50, _distance(F.col("name"), _bound(3, 2), 5))
    score = F.when(_low("name").contains(_low("query")), 0).when(d > 0, d)
    rows = _pairs(queries, names).withColumn("score", score).where("score is not null")
    return top_k(rows.select("query", "name", "score", "ord"), limit, [F.col("score"), F.length("name"), F.col("ord"), F.col("name")], ["query"]).drop("ord")


def fuzzy_match(queries: DataFrame, names: DataFrame, max_results: int = 10) -> DataFrame:
    """names (name) -> query, name, priority, rank: equal in any case 0, holding it 1, near ones 2 and their distance."""
    d = F.when(F.length("query") >= 3, _distance(F.col("name"), _bound(3, 2), 5))
    priority = F.when(_low("name") == _low("query"), 0).when(_low("name").contains(_low("query")), 1).otherwise(2 + d)
    rows = _pairs(queries, names.select("name").distinct()).withColumn("priority", priority).where("priority is not null")
    return top_k(rows, max_results, [F.col("priority"), F.length("name"), F.col("name")], ["query"])


def _last(name: str) -> Column:
    """What follows the last colon: equal for a name and for every query that it equals or ends in at a scope mark."""
    return F.substring_index(F.col(name), ":", -1)


def qualified_match(queries: DataFrame, vertices: DataFrame, fuzzy: bool = True, limit: int = 20, nearest: int = 10) -> DataFrame:
    """vertices (name, repeats allowed) -> query, name, tier: 0 exact; 1 all that end in ::query; 2 holding it; 3 nearest by base name. Lowest tier only.

    Tiers 0 and 1 are unbounded and come by one equality join on what follows the last colon, so each name is read once and no list of its
    suffixes is made. Only for the queries that these leave are all names looked at, once; of those tiers the limit shortest (the nearest) stay, so a rank limit sits below the shuffle.
    """
    wanted, few = _listed(queries)
    names, sent = vertices.select("name"), F.broadcast(wanted) if few else wanted
    if not fuzzy:
        return names.join(sent, F.col("name") == F.col("query")).distinct().select("query", "name", F.lit(0).alias("tier"))
    same = F.col("name") == F.col("query")
    ends = names.join(sent, (_last("name") == _last("query")) & (same | F.endswith("name", F.concat(F.lit("::"), "query"))))
    ends = ends.select("query", "name", F.when(same, 0).otherwise(1).alias("tier")).distinct()
    ends = materialize(best_tier(ends, ["query"], "tier").select("query", "name", "tier"), "matched")
    rest = wanted.join(ends, "query", "left_anti")
    if rest.isEmpty():
        return ends
    d = F.when(F.length("query") >= 4, _distance(scope_base(F.col("name")), _bound(2, 3), 3))
    tier = F.when(_low("name").contains(_low("query")), 2).when(d.isNotNull(), 3)
    rows = _pairs(rest, names).withColumn("tier", tier).where("tier is not null").withColumn("by", F.when(F.col("tier") == 3, d).otherwise(0))
    rows = rows.select("query", "name", "tier", "by").distinct()
    order = [F.col("tier"), F.col("by"), F.length("name"), F.col("name")]
    top = top_k(rows, max(limit, nearest), order, ["query"])
    least = F.min("tier").over(Window.partitionBy("query"))
    top = top.withColumn("least", least).where("tier = least").where(F.col("rank") <= F.when(F.col("tier") == 2, limit).otherwise(nearest))
    return ends.unionByName(top.select("query", "name", "tier"))
