"""Operator 9: quality rules with risk-controlled thresholds. DataFrame functions only.

``measure`` gives each text's base figures. ``calibrate`` then takes the labelled good documents of each stratum (here the language)
as a holdout. The rules' cutoffs form a ladder of levels from lenient to strict, and a level's verdict rejects what any of its rules rejects. A
level is certified if the exact binomial tail P(Binomial(n, alpha) <= rejected good documents) is at most the stratum's part of delta. Levels are tested in
the fixed order of the ladder, up to the first that is not certified, which needs no further correction; strata share delta by the sizes of their
holdouts (weighted Bonferroni). The strictest certified level holds, so with probability 1 - delta the verdict rejects no more than alpha of the
good documents of any stratum, over all rules together and in all strata at once. Where no level is certified (too few labels: with no good document
rejected, (1 - alpha)^n must come down to the stratum's part of delta), the rules reject nothing.

Windows of three words are compared by 64-bit XXH64 of their words, not by the words themselves.

Edge cases: a null or empty text has no words, so it fails the base rule; a null language is a stratum of its own; repeated rows are
judged alike; labels without a document, of null ids or null quality do not count, and a doc_id with several labels
counts once, by its smallest; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import broadcast_if_small, materialize

SPACE = "[\\x20\\x09-\\x0D]"
WHITE = " \t\n\x0b\x0c\r"

#: Rules: name, value (a ratio of base figures), and cutoffs of the levels from strict to lenient; a value above the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "long_words": ("word_chars / greatest(n_words, 1)", [6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 9.5, 10.0, 11.0, 12.0]),
    "short_words": ("n_words / greatest(word_chars, 1)", [0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.32, 0.35, 0.4, 0.5]),
}


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.select(
        "doc_id", "lang", words.alias("w"), lines.alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    windows = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        "doc_id", "lang", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("g"),
    )
    some = F.size(F.array_distinct("g")) < F.size("g")
    ordered = F.when(some, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("s", ordered).drop("g")
    twin = lambda x, i: F.when(i > 0, F.get("s", i - 1)["h"] == x["h"]).otherwise(False) | (F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(F.filter("s", twin), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")))["n"]
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly summed in logarithms; 1 where k is beyond the mean, which certifies nothing."""
    odds = p / (1 - p)
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, step)["sum"])


LEVELS = range(10)


def _over(name: str, cut: Column) -> Column:
    return F.expr(RULES[name][0]) > cut


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """-> lang, level: the strictest certified one, 0 to 9 (null: none)."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    rejects = [reduce(or_, [_over(name, F.lit(cuts[j])) for name, (_, cuts) in RULES.items()]) for j in LEVELS]
    table = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(f"k{j}") for j, x in zip(LEVELS, rejects, strict=True)])
    table = table.join(F.broadcast(table.agg(F.sum("n").alias("total"))))
    # a stricter level rejects no less, so the strictest certified level has only certified ones before it in the order of the tests
    ok = [binomial_tail(F.col(f"k{j}"), F.col("n"), alpha) <= delta * F.col("n") / F.col("total") for j in LEVELS]
    return table.select("lang", F.coalesce(*[F.when(x, F.lit(j)) for j, x in zip(LEVELS, ok, strict=True)]).alias("level"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_broadcast: int = 10_000) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality) -> doc_id, base figures, base_failed, kept, failed_rules.

    alpha: share of a stratum's good documents that the verdict may reject. delta: chance that it rejects more in some stratum.
    """
    measured = materialize(measure(docs), "quality")
    levels = broadcast_if_small(calibrate(measured, labels, alpha, delta).withColumnRenamed("lang", "__lang"), max_broadcast)
    rows = measured.join(levels, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    at = lambda cuts: F.get(F.array(*[F.lit(c) for c in cuts]), "level")
    failed = F.array_compact(F.array(*[F.when(~F.col("base_failed") & _over(name, at(cuts)), F.lit(name)) for name, (_, cuts) in RULES.items()]))
    rows = rows.withColumn("failed", failed)
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("failed", ",").alias("failed_rules"))
