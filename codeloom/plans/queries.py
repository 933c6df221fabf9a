"""Registered queries: every operator over the driver's tables, with DuckDB SQL for each.

The tables stand in for facts of a source tree: parts are bindings, foreign keys are call edges (a layered graph), consecutive
users of the event stream are another, cyclic one, documents and pages are file contents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions import predicates as P
from codeloom.functions import text as X
from codeloom.operators import graph as G
from codeloom.operators import match as M
from codeloom.operators import ranking as R
from codeloom.plans import tree_queries
from codeloom.sources import yaml_ops
from codeloom.sources.store import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- stand-in tables

_BINDINGS = "(SELECT p_name AS python_name, p_brand || '::' || p_name AS cpp_name, p_type AS dispatch_key, 'part' AS file_path, p_partkey AS ord FROM part)"
_EDGES = """(SELECT DISTINCT caller, callee FROM (
  SELECT 'nation::' || n_nationkey AS caller, 'region::' || n_regionkey AS callee FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey FROM supplier
  UNION ALL SELECT 'orders::' || o_orderkey, 'customer::' || o_custkey FROM orders
  UNION ALL SELECT 'lineitem::' || l_orderkey || '.' || l_linenumber, 'orders::' || l_orderkey FROM lineitem))"""
_CYCLIC = """(SELECT DISTINCT caller, callee FROM (SELECT 'u::' || user_id AS caller, 'u::' || lead(user_id) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS callee FROM events) WHERE caller <> callee)"""
_LOCATIONS = """(SELECT 'nation::' || n_nationkey AS name, 'nation.tbl' AS file, n_nationkey::INT AS line FROM nation UNION ALL SELECT 'customer::' || c_custkey, 'customer.tbl', c_custkey::INT FROM customer)"""


def bindings(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    return part.select(F.col("p_name").alias("python_name"), F.concat_ws("::", "p_brand", "p_name").alias("cpp_name"), F.col("p_type").alias("dispatch_key"), F.lit("part").alias("file_path"), F.col("p_partkey").alias("ord"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    def pair(table: str, caller, callee) -> DataFrame:
        return _t(spark, d, table).select(caller.alias("caller"), callee.alias("callee"))

    def node(kind: str, *keys: str):
        return F.concat(F.lit(kind + "::"), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]))

    out = pair("nation", node("nation", "n_nationkey"), node("region", "n_regionkey"))
    out = out.union(pair("customer", node("customer", "c_custkey"), node("nation", "c_nationkey")))
    out = out.union(pair("supplier", node("supplier", "s_suppkey"), node("nation", "s_nationkey")))
    out = out.union(pair("orders", node("orders", "o_orderkey"), node("customer", "o_custkey")))
    return G.merge_edges(out.union(pair("lineitem", node("lineitem", "l_orderkey", "l_linenumber"), node("orders", "l_orderkey"))))


def cyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")  # no window grows with the table
    rows = _t(spark, d, "events").select(F.concat(F.lit("u::"), "user_id").alias("caller"), F.concat(F.lit("u::"), F.lead("user_id").over(w)).alias("callee"))
    return G.merge_edges(rows)


def locations(spark: SparkSession, d: str) -> DataFrame:
    def table(name: str, key: str) -> DataFrame:
        return _t(spark, d, name).select(F.concat(F.lit(name + "::"), F.col(key)).alias("name"), F.lit(name + ".tbl").alias("file"), F.col(key).cast("int").alias("line"))

    return table("nation", "n_nationkey").union(table("customer", "c_custkey"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))


_NAMES = "(SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name)"
_WORDS = ["red widget", "widgt", "Gear", "blue bolt", "blu bolt", "RING", "ld anvil", "small rng", "zzzzzzzz", "x", "gizmo"]
_Q = "(SELECT unnest([" + ", ".join(f"'{w}'" for w in _WORDS) + "]) AS query)"


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _WORDS], "query string")


# ---------------------------------------------------------------- search


def _search_sql(where: str, k: int) -> str:
    return f"""WITH hits AS (SELECT *, row_number() OVER (PARTITION BY python_name, cpp_name, dispatch_key ORDER BY ord) AS n FROM {_BINDINGS} WHERE {where}),
u AS (SELECT * FROM hits WHERE n = 1)
SELECT python_name, cpp_name, dispatch_key, rank, total FROM (SELECT *, row_number() OVER (ORDER BY ord) AS rank, count(*) OVER () AS total FROM u) WHERE rank <= {k}"""


def _search(rows: DataFrame, k: int) -> DataFrame:
    rows = R.dedupe_first(rows.select("python_name", "cpp_name", "dispatch_key", "ord"), ["python_name", "cpp_name", "dispatch_key"], ["ord"])
    return R.top_k_with_total(rows, k, [F.col("ord")]).drop("ord")


@_query(_search_sql("contains(lower(python_name), 'widget') OR contains(lower(cpp_name), 'widget')", 10))
def search_bindings(spark: SparkSession, d: str) -> DataFrame:
    rows = bindings(spark, d)
    return _search(rows.where(P.holds(F.col("python_name"), "Widget") | P.holds(F.col("cpp_name"), "Widget")), 10)


@_query(_search_sql("(contains(lower(python_name), 'brand#1') OR contains(lower(cpp_name), 'brand#1')) AND contains(lower(coalesce(dispatch_key, '')), 'promo')", 25))
def search_bindings_backend(spark: SparkSession, d: str) -> DataFrame:
    rows = bindings(spark, d)
    return _search(rows.where((P.holds(F.col("python_name"), "brand#1") | P.holds(F.col("cpp_name"), "brand#1")) & P.holds(F.col("dispatch_key"), "promo")), 25)


@_query("SELECT name, rank, total FROM (SELECT s_name AS name, row_number() OVER (ORDER BY s_suppkey) AS rank, count(*) OVER () AS total FROM supplier WHERE contains(lower(s_name), '00001')) WHERE rank <= 15")
def search_kernels(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "supplier").where(P.holds(F.col("s_name"), "00001")).select(F.col("s_name").alias("name"), "s_suppkey")
    return R.top_k_with_total(rows, 15, [F.col("s_suppkey")]).drop("s_suppkey")


# ---------------------------------------------------------------- trace


@_query(f"""WITH f AS (SELECT p_name || '.' || p_brand AS lookup_name, p_name AS base_name, min(p_partkey) AS ord FROM part GROUP BY 1, 2),
m AS (SELECT query, lookup_name, base_name, ord, CASE WHEN lookup_name = query THEN 0 WHEN lower(lookup_name) = lower(query) OR lower(base_name) = lower(query) THEN 1 WHEN contains(lower(lookup_name), lower(query)) THEN 2 END AS tier FROM f, {_Q}),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 2 THEN length(lookup_name) ELSE 0 END, ord, lookup_name) AS n FROM m WHERE tier IS NOT NULL),
g AS (SELECT p_name, max(p_retailprice) AS price FROM part GROUP BY p_name)
SELECT query, lookup_name, tier::INT AS tier, price FROM b LEFT JOIN g ON g.p_name = b.base_name WHERE n = 1""")
def trace_definition(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    functions = part.groupBy(F.concat_ws(".", "p_name", "p_brand").alias("lookup_name"), F.col("p_name").alias("base_name")).agg(F.min("p_partkey").alias("ord"))
    found = M.native_lookup(_words(spark), functions)
    prices = part.groupBy(F.col("p_name").alias("base")).agg(F.max("p_retailprice").alias("price"))
    return found.join(prices, X.overload_base(F.col("lookup_name")) == F.col("base"), "left").drop("base")


@_query(f"""WITH m AS (SELECT query, b.*, CASE WHEN python_name = query THEN 0 WHEN cpp_name = query THEN 1 END AS tier FROM {_BINDINGS} b, (SELECT unnest(['red widget', 'Brand#2::small ring', 'none']) AS query)),
l AS (SELECT *, min(tier) OVER (PARTITION BY query) AS least FROM m WHERE tier IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY query, dispatch_key, cpp_name, file_path ORDER BY ord) AS n FROM l WHERE tier = least),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS rank, count(*) OVER (PARTITION BY query) AS total FROM u WHERE n = 1)
SELECT query, dispatch_key, cpp_name, file_path, rank, total FROM r WHERE rank <= 20""")
def trace_registrations(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("red widget",), ("Brand#2::small ring",), ("none",)], "query string")
    rows = bindings(spark, d)
    rows = rows.join(F.broadcast(q), (F.col("python_name") == F.col("query")) | (F.col("cpp_name") == F.col("query")))  # three queries
    rows = R.best_tier(rows.withColumn("tier", F.when(F.col("python_name") == F.col("query"), 0).otherwise(1)), ["query"], "tier")
    rows = R.dedupe_first(rows.select("query", "dispatch_key", "cpp_name", "file_path", "ord"), ["query", "dispatch_key", "cpp_name", "file_path"], ["ord"])
    return R.top_k_with_total(rows, 20, [F.col("ord")], ["query"]).drop("ord")


@_query("""WITH d AS (SELECT DISTINCT l_partkey, l_shipdate::DATE::VARCHAR AS day, l_linenumber AS line FROM lineitem),
r AS (SELECT p_name, l_partkey, day, line, row_number() OVER (PARTITION BY p_name ORDER BY l_partkey, day, line) AS rank, count(*) OVER (PARTITION BY p_name) AS total FROM d JOIN part ON p_partkey = l_partkey WHERE p_name IN ('blue bolt', 'cold gear'))
SELECT p_name, l_partkey, day, line, rank, total FROM r WHERE rank <= 10""")
def trace_implementations(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").where(F.col("p_name").isin("blue bolt", "cold gear")).select("p_name", F.col("p_partkey").alias("l_partkey"))
    rows = _t(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").cast("string").alias("day"), F.col("l_linenumber").alias("line")).join(part, "l_partkey").distinct()
    return R.top_k_with_total(rows, 10, [F.col("l_partkey"), F.col("day"), F.col("line")], ["p_name"])


# ---------------------------------------------------------------- graph


def _neighbour_sql(near: str, far: str, queries: list[str], k: int) -> str:
    q = ", ".join(f"'{x}'" for x in queries)
    return f"""WITH e AS {_EDGES}, l AS {_LOCATIONS}, v AS (SELECT caller AS name FROM e UNION SELECT callee FROM e UNION SELECT name FROM l),
q AS (SELECT unnest([{q}]) AS query),
m AS (SELECT query, name, CASE WHEN name = query THEN 0 WHEN ends_with(name, '::' || query) THEN 1 END AS tier FROM v, q),
s AS (SELECT query, name AS matched FROM (SELECT *, min(tier) OVER (PARTITION BY query) AS least FROM m WHERE tier IS NOT NULL) WHERE tier = least),
n AS (SELECT DISTINCT s.query, e.{far} AS name FROM s JOIN e ON e.{near} = s.matched),
r AS (SELECT n.*, l.file, l.line, row_number() OVER (PARTITION BY query ORDER BY n.name) AS rank, count(*) OVER (PARTITION BY query) AS total FROM n LEFT JOIN l ON l.name = n.name)
SELECT query, name, file, line, rank, total FROM r WHERE rank <= {k}"""


def _neighbour(spark: SparkSession, d: str, queries: list[str], outgoing: bool) -> DataFrame:
    q = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in queries])).alias("query"))
    rows = G.neighbours(materialize(edges(spark, d), "edges"), locations(spark, d), q, outgoing)
    rows = R.dedupe_first(rows, ["query", "name"], ["matched"]).drop("matched")
    return R.top_k_with_total(rows, 15, [F.col("name")], ["query"])


@_query(_neighbour_sql("caller", "callee", ["orders::7", "12", "nation::3"], 15))
def graph_calls(spark: SparkSession, d: str) -> DataFrame:
    return _neighbour(spark, d, ["orders::7", "12", "nation::3"], True)


@_query(_neighbour_sql("callee", "caller", ["nation::3", "5", "region::1"], 15))
def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    return _neighbour(spark, d, ["nation::3", "5", "region::1"], False)


def _impact_sql(edge_sql: str, start: str, depth: int, tail: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED {edge_sql},
r(name, depth) AS (SELECT caller, 1 FROM e WHERE callee = '{start}' UNION SELECT e.caller, r.depth + 1 FROM r JOIN e ON e.callee = r.name WHERE r.depth < {depth}),
levels AS (SELECT name, min(depth)::BIGINT AS depth FROM r WHERE name <> '{start}' GROUP BY name) {tail}"""


@_query(_impact_sql(_EDGES, "region::0", 5, "SELECT name, depth FROM levels"))
def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(materialize(edges(spark, d), "edges"), "region::0", 5)


@_query(_impact_sql(_EDGES, "region::0", 5, "SELECT depth, count(*) AS n FROM levels GROUP BY ROLLUP (depth)"))
def graph_impact_totals(spark: SparkSession, d: str) -> DataFrame:
    return G.impact_totals(graph_impact(spark, d))


@_query(_impact_sql(_CYCLIC, "u::8", 3, "SELECT name, depth FROM levels"))
def graph_impact_cyclic(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(materialize(cyclic_edges(spark, d), "edges"), "u::8", 3)


@_query(_impact_sql(_EDGES, "nation::3", 2, """, f AS (SELECT *, row_number() OVER (PARTITION BY cpp_name ORDER BY ord) AS n FROM (SELECT 'customer::' || c_custkey AS cpp_name, c_name AS python_name, c_mktsegment AS dispatch_key, c_custkey AS ord FROM customer) WHERE cpp_name IN (SELECT name FROM levels)),
ranked AS (SELECT *, row_number() OVER (ORDER BY cpp_name) AS rank, count(*) OVER () AS total FROM f WHERE n = 1) SELECT python_name, cpp_name, dispatch_key, rank, total FROM ranked WHERE rank <= 10"""))
def impact_entry_points(spark: SparkSession, d: str) -> DataFrame:
    levels = G.impact(materialize(edges(spark, d), "edges"), "nation::3", 2)
    c = _t(spark, d, "customer").select(F.concat(F.lit("customer::"), "c_custkey").alias("cpp_name"), F.col("c_name").alias("python_name"), F.col("c_mktsegment").alias("dispatch_key"), F.lit("customer").alias("file_path"), F.col("c_custkey").alias("ord"))
    return G.entry_points(levels, c)


@_query(f"WITH e AS {_EDGES}, l AS {_LOCATIONS} SELECT split_part(name, '::', 1) AS kind, count(*) AS n FROM (SELECT caller AS name FROM e UNION SELECT callee FROM e UNION SELECT name FROM l) GROUP BY 1")
def vertex_union(spark: SparkSession, d: str) -> DataFrame:
    return G.vertices(edges(spark, d), locations(spark, d)).groupBy(F.split_part("name", F.lit("::"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT caller, callee FROM {_CYCLIC}")
def self_edge_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return cyclic_edges(spark, d)


@_query("""SELECT s.name, s.n_calls, l.event_type AS file, l.event_id AS line FROM (SELECT user_id AS name, count(DISTINCT event_type) AS n_calls FROM events GROUP BY 1) s
JOIN (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) l ON l.user_id = s.name AND l.n = 1""")
def merge_call_graph(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    places = R.last_wins(events.select(F.col("user_id").alias("name"), F.col("event_type").alias("file"), F.col("event_id").alias("line")), ["name"], ["line"])
    calls = events.select(F.col("user_id").alias("name"), "event_type").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_calls"))
    return calls.join(places, "name")


# ---------------------------------------------------------------- status and indexes


@_query(" UNION ALL ".join(f"SELECT '{t}' AS item, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = _t(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("item"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT p_brand AS dispatch_key, n, row_number() OVER (ORDER BY n DESC, p_brand) AS rank FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 5")
def dispatch_key_topk(spark: SparkSession, d: str) -> DataFrame:
    counts = _t(spark, d, "part").groupBy(F.col("p_brand").alias("dispatch_key")).agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(counts, 5, [F.desc("n"), F.col("dispatch_key")])


@_query(f"SELECT python_name, count(*) AS n, string_agg(cpp_name, ',' ORDER BY ord) AS \"values\" FROM {_BINDINGS} WHERE python_name <> '' GROUP BY 1")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return R.inverted_index(bindings(spark, d), "python_name", "cpp_name", ["ord"])


@_query("SELECT p_type AS binding_type, count(*) AS n FROM part GROUP BY 1")
def binding_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").groupBy(F.col("p_type").alias("binding_type")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- modules


@_query("""WITH c AS (SELECT p_name, p_brand, p_partkey, CASE WHEN lower(p_brand) = 'brand#2' THEN 0 WHEN contains(lower(p_brand), 'brand#2') THEN 1 END AS tier FROM part),
l AS (SELECT *, min(tier) OVER () AS least FROM c WHERE tier IS NOT NULL)
SELECT p_brand, p_name, rank, total FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rank, count(*) OVER () AS total FROM l WHERE tier = least) WHERE rank <= 1""")
def module_trace(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.lower("p_brand") == "brand#2", 0).when(P.holds(F.col("p_brand"), "brand#2"), 1)
    rows = _t(spark, d, "part").withColumn("tier", tier).where("tier is not null").withColumn("q", F.lit("Brand#2"))
    return R.top_k_with_total(R.best_tier(rows, ["q"], "tier").select("p_brand", "p_name", "p_partkey"), 1, [F.col("p_partkey")]).drop("p_partkey")


_CLASS_NAME = "upper(p_type[1]) || lower(p_type[2:]) || CASE p_size % 5 WHEN 0 THEN 'Loss' WHEN 1 THEN 'Sequential' WHEN 2 THEN 'ModuleList' WHEN 3 THEN 'Container' ELSE '' END"


def _class_name():
    end = F.element_at(F.array(*[F.lit(x) for x in ("Loss", "Sequential", "ModuleList", "Container", "")]), (F.col("p_size") % 5 + 1).cast("int"))
    return F.concat(F.initcap(F.lower("p_type")), end)


@_query(f"""WITH m AS (SELECT DISTINCT {_CLASS_NAME} AS name FROM part), g AS (
SELECT 'layers' AS grp, name FROM m WHERE NOT (contains(name, 'Loss') OR contains(name, 'Container') OR contains(name, 'Sequential'))
UNION ALL SELECT 'losses', name FROM m WHERE contains(name, 'Loss')
UNION ALL SELECT 'containers', name FROM m WHERE contains(name, 'Container') OR contains(name, 'Sequential') OR contains(name, 'ModuleList') OR contains(name, 'ModuleDict'))
SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY name) AS rank, count(*) OVER (PARTITION BY grp) AS total FROM g""")
def module_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select(_class_name().alias("name")).distinct()
    return R.top_k_with_total(rows.select(F.explode(P.module_groups(F.col("name"))).alias("grp"), "name"), 1 << 30, [F.col("name")], ["grp"])


@_query("SELECT DISTINCT p_name, p_brand FROM part WHERE contains(lower(p_type || '.' || p_name), 'promo') AND NOT starts_with(p_name, 'blue') ORDER BY p_name, p_brand LIMIT 20")
def module_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").where(P.holds(F.concat_ws(".", "p_type", "p_name"), "promo") & ~F.col("p_name").startswith("blue"))
    return rows.select("p_name", "p_brand").distinct().orderBy("p_name", "p_brand").limit(20)


@_query("SELECT n_name AS name, rank, total FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS rank, count(*) OVER () AS total FROM nation WHERE contains(lower(n_name), 'nation_1')) WHERE rank <= 20")
def class_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").where(P.holds(F.col("n_name"), "Nation_1")).select(F.col("n_name").alias("name"))
    return R.top_k_with_total(rows, 20, [F.col("name")])


# ---------------------------------------------------------------- tests

_WORD = "(instr(lower({n}), lower({q})) > 0 AND NOT regexp_matches(CASE WHEN instr(lower({n}), lower({q})) > 1 THEN substr(lower({n}), instr(lower({n}), lower({q})) - 1, 1) ELSE '_' END, '^\\p{{L}}') AND NOT regexp_matches(substr(lower({n}), instr(lower({n}), lower({q})) + length({q}), 1), '^\\p{{L}}'))"


def _word_sql(q: str, n: str) -> str:
    return _WORD.format(q=q, n=n)


@_query(f"""WITH s AS (SELECT 'functions' AS section, p_name AS name, p_partkey AS id FROM part WHERE {_word_sql("'ring'", "p_name")}
UNION ALL SELECT 'classes', n_name, n_nationkey FROM nation WHERE {_word_sql("'nation'", "n_name")}
UNION ALL SELECT 'files', url, page_id FROM pages WHERE contains(lower(url), 'ref=')),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY name, id) AS rank, count(*) OVER (PARTITION BY section) AS total FROM s)
SELECT section, name, id::BIGINT AS id, rank, total FROM r WHERE rank <= CASE section WHEN 'functions' THEN 10 ELSE 5 END""")
def tests_find(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "part").where(P.word_match(F.lit("Ring"), F.col("p_name"))).select(F.lit("functions").alias("section"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    b = _t(spark, d, "nation").where(P.word_match(F.lit("nation"), F.col("n_name"))).select(F.lit("classes").alias("section"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    c = _t(spark, d, "pages").where(P.holds(F.col("url"), "REF=")).select(F.lit("files").alias("section"), F.col("url").alias("name"), F.col("page_id").alias("id"))
    top = R.top_k_with_total(a.union(b).union(c), 10, [F.col("name"), F.col("id")], ["section"])
    return top.where((F.col("section") == "functions") | (F.col("rank") <= 5))


@_query("""SELECT conv_id, count(*) AS n_functions, count(DISTINCT role) AS n_classes, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def test_file_info(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_functions"), F.countDistinct("role").alias("n_classes"), F.array_join(F.transform(turns, lambda x: x["role"]), ",").alias("roles"))


@_query("SELECT section, count(*) AS n FROM (SELECT role AS section FROM conversations) GROUP BY ROLLUP (section)")
def section_totals(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("role").alias("section")).rollup("section").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT query, name, {_word_sql('query', 'name')} AS matched FROM (SELECT DISTINCT p_name AS name FROM part) n, {_Q}")
def word_match(spark: SparkSession, d: str) -> DataFrame:
    pairs = _names(spark, d).select("name").crossJoin(F.broadcast(_words(spark)))  # eleven queries
    return pairs.select("query", "name", P.word_match(F.col("query"), F.col("name")).alias("matched"))


# ---------------------------------------------------------------- fuzzy


@_query(f"""WITH m AS (SELECT query, name, ord, levenshtein(lower(query), lower(name)) AS d FROM {_NAMES}, {_Q}),
t AS (SELECT *, CASE WHEN name = query THEN 0 WHEN ends_with(lower(name), lower(query)) THEN 1 WHEN contains(lower(name), lower(query)) THEN 2
  WHEN length(query) >= 3 AND abs(length(name) - length(query)) <= 3 AND d <= greatest(2, length(query) // 3) THEN 3 END AS tier FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, CASE tier WHEN 2 THEN length(name) WHEN 3 THEN d ELSE 0 END, ord, name) AS n FROM t WHERE tier IS NOT NULL)
SELECT query, name, tier::INT AS tier FROM b WHERE n = 1""")
def fuzzy_find(spark: SparkSession, d: str) -> DataFrame:
    return M.fuzzy_find(_words(spark), _names(spark, d))


@_query(f"""WITH m AS (SELECT query, name, name AS base_name, ord, CASE WHEN name = query THEN 0 WHEN lower(name) = lower(query) THEN 1 WHEN contains(lower(name), lower(query)) THEN 2 END AS tier FROM {_NAMES}, {_Q}),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 2 THEN length(name) ELSE 0 END, ord, name) AS n FROM m WHERE tier IS NOT NULL)
SELECT query, name AS lookup_name, tier::INT AS tier FROM b WHERE n = 1""")
def native_lookup(spark: SparkSession, d: str) -> DataFrame:
    return M.native_lookup(_words(spark), _names(spark, d).select(F.col("name").alias("lookup_name"), F.col("name").alias("base_name"), "ord"))


@_query(f"""WITH m AS (SELECT query, name, ord, levenshtein(lower(query), lower(name)) AS d FROM {_NAMES}, {_Q}),
s AS (SELECT *, CASE WHEN contains(lower(name), lower(query)) THEN 0 WHEN length(name) < 50 AND abs(length(name) - length(query)) <= 5 AND d > 0 AND d <= greatest(3, length(query) // 2) THEN d END AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, length(name), ord, name) AS rank FROM s WHERE score IS NOT NULL)
SELECT query, name, score::INT AS score, rank FROM r WHERE rank <= 10""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    return M.similar_names(_words(spark), _names(spark, d))


@_query(f"""WITH m AS (SELECT query, name, levenshtein(lower(query), lower(name)) AS d FROM {_NAMES}, {_Q}),
s AS (SELECT *, CASE WHEN lower(name) = lower(query) THEN 0 WHEN contains(lower(name), lower(query)) THEN 1 WHEN length(query) >= 3 AND abs(length(name) - length(query)) <= 5 AND d <= greatest(3, length(query) // 2) THEN 2 + d END AS priority FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, length(name), name) AS rank FROM s WHERE priority IS NOT NULL)
SELECT query, name, priority::INT AS priority, rank FROM r WHERE rank <= 10""")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return M.fuzzy_match(_words(spark), _names(spark, d))


@_query(f"""WITH v AS (SELECT DISTINCT cpp_name AS name, string_split(cpp_name, '::')[-1] AS base FROM {_BINDINGS}),
m AS (SELECT query, name, levenshtein(lower(query), lower(base)) AS d, base FROM v, {_Q}),
t AS (SELECT *, CASE WHEN name = query THEN 0 WHEN ends_with(name, '::' || query) THEN 1 WHEN contains(lower(name), lower(query)) THEN 2
  WHEN length(query) >= 4 AND abs(length(base) - length(query)) <= 3 AND d <= greatest(2, length(query) // 3) THEN 3 END AS tier FROM m),
l AS (SELECT *, min(tier) OVER (PARTITION BY query) AS least FROM t WHERE tier IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN tier = 3 THEN d ELSE 0 END, length(name), name) AS n FROM l WHERE tier = least)
SELECT query, name, tier::INT AS tier FROM r WHERE tier < 2 OR (tier = 2 AND n <= 20) OR (tier = 3 AND n <= 10)""")
def qualified_match(spark: SparkSession, d: str) -> DataFrame:
    return M.qualified_match(_words(spark), bindings(spark, d).select(F.col("cpp_name").alias("name")))


@_query(f"SELECT query, name, levenshtein(query, name)::INT AS distance FROM {_NAMES}, {_Q}")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = _names(spark, d).select("name").crossJoin(F.broadcast(_words(spark)))  # eleven queries
    return pairs.select("query", "name", F.levenshtein("query", "name").alias("distance"))


# ---------------------------------------------------------------- scalars


@_query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS short, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS excerpt FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("short"), X.excerpt(F.col("text")).alias("excerpt"))


@_query("SELECT key, row_number() OVER (ORDER BY key ASC NULLS LAST) AS rank FROM (SELECT DISTINCT CASE WHEN p_brand <> 'Brand#2' THEN p_brand END AS key FROM part)")
def safe_sort(spark: SparkSession, d: str) -> DataFrame:
    keys = _t(spark, d, "part").select(F.when(F.col("p_brand") != "Brand#2", F.col("p_brand")).alias("key")).distinct()
    return R.top_k(keys, 1 << 30, X.nulls_last(F.col("key")))


@_query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS path, string_split(url, '.')[-1] AS last_part, split_part(url, '.', 1) AS first_part, substr(md5(url), 1, 12) AS hash FROM pages")
def relative_path(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", X.relative_path(url, "http://x", ["http://", "https://"]).alias("path"), X.dotted_base(url).alias("last_part"), X.overload_base(url).alias("first_part"), X.md5_prefix(url, 12).alias("hash"))


@_query("SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_name <> '') WHERE n = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return R.dedupe_first(_t(spark, d, "part").select("p_name", "p_brand", "p_partkey"), ["p_name"], ["p_partkey"], drop_empty=True)


@_query("SELECT p_name || ' (' || p_brand || ')' AS label, p_brand || '::' || p_name AS qualified, p_brand || ':' || p_size AS place, p_partkey, format('{:,}', p_partkey) AS shown FROM part")
def name_formatting(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    return part.select(F.format_string("%s (%s)", "p_name", "p_brand").alias("label"), X.qualified(F.col("p_brand"), F.col("p_name")).alias("qualified"), X.location(F.col("p_brand"), F.col("p_size")).alias("place"), "p_partkey", X.thousands(F.col("p_partkey")).alias("shown"))


# ---------------------------------------------------------------- predicates


def _any_sql(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


@_query(f"SELECT page_id, {_any_sql('lower(url)', C.EXCLUDED)} AS excluded, {_any_sql('url', ['/en/', '/fr/'])} AS included, (contains(url, '/test/') AND NOT contains(url, '/testing/')) AS main_tests FROM pages")
def path_exclusion(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", P.excluded(url).alias("excluded"), P.in_dirs(url, ["/en/", "/fr/"]).alias("included"), P.in_main_tests(url).alias("main_tests"))


@_query(f"SELECT doc_id, {_any_sql('text', C.BINDING_MARKS)} AS has_bindings, {_any_sql('text', C.TEST_MARKS)} AS has_tests, {_any_sql('text', ['token', 'License'])} AS holds FROM documents")
def content_prefilter(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", P.has_bindings(t).alias("has_bindings"), P.has_tests(t).alias("has_tests"), P.holds_any(t, ["token", "License"]).alias("holds"))


# ---------------------------------------------------------------- extraction

_LICENCE = "[Ll]icense[d]? (?:under|the)"


@_query(f"""WITH p AS (SELECT doc_id, string_split_regex(text, '{_LICENCE}') AS gaps, regexp_extract_all(text, '{_LICENCE}') AS ms FROM documents WHERE regexp_matches(text, '{_LICENCE}')),
x AS (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM p)
SELECT doc_id, ms[i] AS match, (length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')))::INT AS pos, (1 + length(array_to_string(gaps[1:i], '')) - length(replace(array_to_string(gaps[1:i], ''), chr(10), '')))::INT AS line FROM x""")
def extract_with_line(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.explode(X.matches(F.col("text"), _LICENCE)).alias("x"))
    return rows.select("doc_id", F.col("x.m").alias("match"), "x.pos", "x.line")


_HEAD = "<(h[1-6]|title)>"


@_query(f"SELECT page_id, regexp_extract_all(substr(html, 1, instr(html, '</p>') - 1), '{_HEAD}', 1)[-1] AS enclosing FROM pages WHERE instr(html, '</p>') > 0")
def enclosing_context(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("html", "</p>")
    found = F.regexp_extract_all(F.substring("html", F.lit(1), at - 1), F.lit(_HEAD), F.lit(1))
    return _t(spark, d, "pages").where(at > 0).select("page_id", F.try_element_at(found, F.lit(-1)).alias("enclosing"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name = 'blue bolt' UNION SELECT p_partkey FROM part WHERE p_size = 7)")
def target_semijoin(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    targets = part.where("p_name = 'blue bolt'").select("p_partkey").union(part.where("p_size = 7").select("p_partkey")).distinct()
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(targets, F.col("l_partkey") == F.col("p_partkey"), "left_semi")


_OVERLOADS = "SELECT p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || p_type END AS name, p_name AS base_name, p_brand || ', ' || p_type AS keys, p_brand AS impl, p_partkey AS ord FROM part"


def _overloads(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(".", "p_name", "p_type"))
    dispatch = F.array(F.struct(F.concat_ws(", ", "p_brand", "p_type").alias("keys"), F.col("p_brand").alias("impl")))
    rows = _t(spark, d, "part").select(name.alias("name"), F.concat(name, F.lit("(Tensor self)")).alias("signature"), dispatch.alias("dispatch"), F.lit("").alias("variants"), F.lit(False).alias("structured"), F.lit(None).cast("string").alias("structured_delegate"), F.array().cast("array<string>").alias("tags"), F.col("p_partkey").alias("ord"))
    return yaml_ops.with_aliases(rows)


@_query(f"""WITH o AS ({_OVERLOADS}), exact AS (SELECT name AS lookup_name, name, ord, false AS is_alias FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord DESC) AS n FROM o) WHERE n = 1),
alias AS (SELECT base_name AS lookup_name, name, ord, true AS is_alias FROM (SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY ord) AS n FROM o WHERE name <> base_name) WHERE n = 1 AND base_name NOT IN (SELECT lookup_name FROM exact))
SELECT * FROM exact UNION ALL SELECT * FROM alias""")
def overload_alias(spark: SparkSession, d: str) -> DataFrame:
    return _overloads(spark, d).select("lookup_name", "name", "ord", "is_alias")


@_query(f"""WITH o AS ({_OVERLOADS}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord DESC) AS n FROM o) WHERE n = 1)
SELECT name, trim(unnest(string_split(keys, ','))) AS key, impl FROM last""")
def dispatch_explode(spark: SparkSession, d: str) -> DataFrame:
    return _overloads(spark, d).where("not is_alias").select("name", F.explode("dispatch").alias("key", "impl"))


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.last_wins(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def event_minutes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", X.minute(F.col("ts")).alias("minute"))


@_query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS doc FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return _t(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("doc"))


_BLOCK = 1000


@_query(f"SELECT event_type, event_id // {_BLOCK} AS block, substr(md5(string_agg(event_id || ':' || user_id, '|' ORDER BY event_id)), 1, 16) AS fingerprint FROM events GROUP BY 1, 2")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One fingerprint for each block of ids of a type, so that no group grows with the table."""
    rows = _t(spark, d, "events").select("event_type", F.expr(f"event_id div {_BLOCK}").alias("block"), "event_id", F.concat_ws(":", "event_id", "user_id").alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "part"))), lambda x: x["part"])
    return rows.groupBy("event_type", "block").agg(X.md5_prefix(F.array_join(parts, "|"), 16).alias("fingerprint"))


@_query("SELECT d.doc_id, coalesce(a.name, b.name) AS name FROM (SELECT doc_id, source, lang FROM documents) d LEFT JOIN (SELECT 'src' || n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 5) a ON a.k = d.source LEFT JOIN (SELECT unnest(['en', 'fr']) AS k, unnest(['English', 'French']) AS name) b ON b.k = d.lang")
def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("src"), "n_nationkey").alias("source"), F.col("n_name").alias("a"))
    b = spark.createDataFrame([("en", "English"), ("fr", "French")], "lang string, b string")
    rows = _t(spark, d, "documents").select("doc_id", "source", "lang").join(a, "source", "left").join(b, "lang", "left")
    return rows.select("doc_id", F.coalesce("a", "b").alias("name"))


@_query("SELECT p_name AS name FROM part WHERE contains(p_name, 'o') EXCEPT SELECT p_name FROM part WHERE starts_with(p_name, 'blue')")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return part.where(F.contains("name", F.lit("o"))).join(part.where(F.col("name").startswith("blue")), "name", "left_anti")


def queries() -> dict[str, Query]:
    return _QUERIES | tree_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | tree_queries.oracle_sql()
