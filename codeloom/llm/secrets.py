"""Operator 10: secret scan with corpus-wide ownership frequency. DataFrame functions only.

Base kinds are found by fixed patterns and always stay. Further candidates are tokens of known issuers, key headers and random-looking
strings. The values of all candidates are hashed and aggregated over the whole corpus by repository and owner: a value that
several owners hold is an example that was copied about; one that a single owner holds looks live. Base spans are told apart
by it, further candidates are added only if they look live. A value that one owner holds in many repositories is an example, too.
Counts are pre-aggregated by
(value, owner, repository), then (value, owner), then value, so a value in a third of all rows costs one row for each task.

Positions are code points: a text is split by a pattern, and the lengths of pieces and matches add up.

Edge cases: a null or empty text has no spans (base_sha256 is that of the empty string); null repositories or owners count as one;
repeated rows are scanned alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

#: Kinds in their order, and patterns. A base match that is too short is dropped after matching.
ASSIGN = "((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]{16,})"
MORE = (
    "(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    "|eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{35}|[A-Za-z0-9+/_-]{28,})"
)
KINDS = ["assign", "access", "hex", "pem", "github", "api", "slack", "jwt", "google", "random"]


#: Matches that are added up at once, so that work grows with the matches and not with their square.
PART = 256
_SPANS = "array<struct<s:int,e:int,m:string>>"


def _let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _parts(x: Column) -> Column:
    """An array in parts of PART elements; at least one part."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / PART).cast("int"), F.lit(0))), lambda c: F.slice(x, c * PART + 1, F.lit(PART)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of leftmost matches that do not overlap; pattern's first group is the whole match."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("m"), F.transform(pieces, lambda x: F.length(x)).alias("gap")), lambda x: x["m"].isNotNull())
    kind = f"struct<at:int,all:{_SPANS}>"
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(_SPANS).alias("all")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["all"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("all")).cast(kind)

    ends = lambda parts: F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["m"])))
    places = lambda sums: F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    spans = _let(_parts_of(pairs), lambda parts: _let(places(ends(parts)), lambda at: F.flatten(F.transform(parts, lambda p, i: F.aggregate(p, begin(F.get(at, i)), step)["all"]))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _parts_of(x: Column) -> Column:
    return _let(x, _parts)


def _apart(spans: Column, others: Column) -> Column:
    """Those of spans (in order) that overlap none of others. Each part of spans looks only at what lies between its ends."""
    over = lambda y, lo, hi: (y["s"] < hi) & (lo < y["e"])

    def free(p: Column, others: Column) -> Column:
        near = F.filter(others, lambda y: over(y, F.get(p, F.lit(0))["s"], F.element_at(p, -1)["e"]))
        return _let(near, lambda n: F.filter(p, lambda x: ~F.exists(n, lambda y: over(y, x["s"], x["e"]))))

    kept = _let(others, lambda o: F.flatten(F.transform(_parts_of(spans), lambda p: free(p, o))))
    return F.when(F.size(spans) == 0, spans).otherwise(kept)


def _as_spans(spans: Column, kind) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (kind(x) if callable(kind) else F.lit(kind)).cast("int").alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def _kind_of(x: Column) -> Column:
    m = x["m"]
    tests = [(m.startswith("-----BEGIN"), 3), (m.rlike("^gh[pousr]_"), 4), (m.startswith("sk-"), 5), (m.rlike("^xox[abprs]-"), 6), (m.rlike("^eyJ[^.]+\\.eyJ"), 7), (m.rlike("^AIza"), 8)]
    out = F.lit(9)
    for test, k in reversed(tests):
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, repository: str = "source", owner: str = "source", max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """docs (doc_id, text, repository, owner) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.

    max_owners, max_repositories: a value held by more owners, or in more repositories of any owners, is an example.
    n_live, n_examples: candidates of the document (base ones, too) of either sort.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(repository).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    rows = rows.select(
        "doc_id", "repo", "owner",
        _as_spans(F.filter(_matches(F.col("text"), ASSIGN), lambda x: F.length(value(x)) >= 12), 0).alias("assign"),
        _as_spans(F.filter(_matches(F.col("text"), ACCESS), lambda x: F.length(x["m"]) >= 18), 1).alias("access"),
        _as_spans(_matches(F.col("text"), HEX), 2).alias("hex"),
        _as_spans(_matches(F.col("text"), MORE), _kind_of).alias("more"),
    )
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]") & ~m.rlike("(?i)example|sample|dummy|xxxx|1234567")
    looks = lambda x: (x["k"] != 9) | mixed(x["m"])
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("more", F.filter("more", looks))
    rows = rows.withColumn("more", _apart(F.col("more"), F.col("base")))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.sha2(F.when(x["k"] == 0, value(x)).otherwise(x["m"]), 256).alias("h")))
    rows = rows.select("doc_id", "repo", "owner", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")], slim("base").alias("base"), slim("more").alias("more"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")

    found = rows.where(F.size("base") + F.size("more") > 0).select("row", "repo", "owner", F.explode(F.concat("base", "more")).alias("x"))
    held = found.select(F.col("x.h").alias("h"), "owner", "repo").groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    held = held.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    judged = found.select("row", "x", F.col("x.h").alias("h")).join(held, "h")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    added = F.collect_list(F.when(live & (F.col("x.k") > 2), F.col("x")))
    judged = judged.groupBy("row").agg(added.alias("live"), F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_examples"))
    rows = rows.drop("more", "repo", "owner").join(judged, "row", "left")
    live = F.coalesce("live", F.expr("filter(base, x -> false)"))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.concat("base", live)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )
