"""Operator 7: mixing sources to target weights by Poisson replication. DataFrame functions only.

The mean number of copies of a source's documents is lambda = weight share x epoch size / documents of the source. A
document's count is the inverse of the Poisson distribution at a uniform number from md5(seed, doc_id), so a rerun or a lost task
gives the same copies. Each document is exploded by its count, and copies are dealt to range partitions by a hash of (seed, doc_id,
replica) and sorted there: a global shuffle in one exchange, with no sampling pass, and even for any mix of sources.

Edge cases: a null source is a source of its own; a null doc_id draws as the word null; repeated rows draw alike and
stay as many; columns keep their names and values whatever they are called; sources without a weight take ``default_weight``; a source of
weight zero has no copies (no rows are left if all are zero), and negative or endless weights are refused; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import broadcast_if_small, free_names, partitions

#: Rates beyond this are drawn as a sum of parts, since exp(-rate) must not underflow.
PART = 500.0


def _uniform(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epoch: float = 1.0, default_weight: float = 1.0) -> DataFrame:
    """-> source, rate, parts, cdf: the Poisson distribution of rate / parts up to where it is 1 in double precision."""
    if not all(0 <= w < math.inf for w in [epoch, default_weight, *(weights or {}).values()]):
        raise ValueError("weights and epoch must be finite and not negative")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default_weight))
    for name, w in sorted((weights or {}).items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    sums = counts.agg(F.sum("n").alias("total"), F.sum("w").alias("all_w"))
    share = F.coalesce(F.try_divide(F.col("w"), F.col("all_w")), F.lit(0.0))
    rates = counts.join(F.broadcast(sums)).select("source", (share * F.col("total") * epoch / F.col("n")).alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = (F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return rates.select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), last), start, step)["all"].alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", epoch: float = 1.0, default_weight: float = 1.0, max_broadcast: int = 10_000) -> DataFrame:
    """docs with doc_id, source and any other columns -> the same columns, then n_copies, replica (from 0) and shuffle_key.

    weights: target share of each source, in any unit. epoch: expected output rows as a multiple of the input's.
    The table of rates is broadcast only if it is counted to have at most max_broadcast sources. An added column whose name
    docs already has gets underscores before it.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # inside, columns go by their place, so no name can clash
    low = [c.lower() for c in docs.columns]
    doc_id, source = (F.col(own[low.index(c)]) for c in ("doc_id", "source"))
    rates = broadcast_if_small(source_rates(docs, weights, epoch, default_weight).select(F.col("source").alias("key"), "parts", "cdf"), max_broadcast)
    ident = F.coalesce(doc_id.cast("string"), F.lit("null"))
    draw = lambda j: F.size(F.filter("cdf", lambda c: c <= F.col("u")[j]))
    rows = docs.toDF(*own).join(rates, source.eqNullSafe(F.col("key")))
    rows = rows.withColumn("u", F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: _uniform(F.lit(seed), F.lit("copies"), ident, j.cast("string"))))
    rows = rows.withColumn("n_copies", F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda acc, j: acc + draw(j)))
    rows = rows.where("n_copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("replica").cast("string"))))
    n = partitions(docs.sparkSession)
    slot = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")
    out = rows.select(*own, "n_copies", "replica", "shuffle_key").repartitionById(n, slot).sortWithinPartitions("shuffle_key", doc_id)
    return out.toDF(*docs.columns, *free_names(docs.columns, ["n_copies", "replica", "shuffle_key"]))


ORACLE = """
WITH counts AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM counts) * (SELECT sum(n) FROM counts) / n AS mean FROM counts),
terms AS (SELECT source, mean, range(1, (trunc(mean + 12 * sqrt(mean) + 24))::BIGINT + 1) AS ks FROM rates),
steps AS (
  SELECT source, list_reduce(list_prepend({{'k': 0::DOUBLE, 'p': exp(-mean), 'c': exp(-mean), 'cs': [exp(-mean)]}}, list_transform(ks, lambda k: {{'k': k::DOUBLE, 'p': mean, 'c': 0::DOUBLE, 'cs': []::DOUBLE[]}})),
    lambda acc, x: {{'k': x.k, 'p': acc.p * x.p / x.k, 'c': acc.c + acc.p * x.p / x.k, 'cs': list_append(acc.cs, acc.c + acc.p * x.p / x.k)}}).cs AS cdf FROM terms),
drawn AS (
  SELECT d.*, len(list_filter(s.cdf, lambda c: c <= ('0x' || substr(md5(concat_ws(':', 'mix-1', 'copies', coalesce(doc_id::VARCHAR, 'null'), '0')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE))::INTEGER AS n_copies
  FROM {docs} d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
copied AS (SELECT *, unnest(range(0, n_copies))::INTEGER AS replica FROM drawn)
SELECT doc_id, text, lang, source, n_chars, n_copies, replica, md5(concat_ws(':', 'mix-1', 'order', coalesce(doc_id::VARCHAR, 'null'), replica::VARCHAR)) AS shuffle_key FROM copied
"""
