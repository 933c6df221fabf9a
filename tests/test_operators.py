"""Scalars, predicates, ranking, fuzzy lookup and graphs on small literals and random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions import text as X
from codeloom.operators import graph as G
from codeloom.operators import match as M
from codeloom.operators import ranking as R


def col(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_edit_distance(spark):
    cases = [("hello", "hello", 0), ("", "", 0), ("abc", "", 3), ("cat", "bat", 1), ("cat", "cats", 1), ("cat", "at", 1), ("matmul", "matmull", 1), ("softmax", "softmin", 2), ("relu", "selu", 1), ("abc", "xyz", 3), ("é", "e", 1)]
    got = col(spark, [(a, b) for a, b, _ in cases], "a string, b string", F.levenshtein("a", "b"), F.levenshtein("b", "a"))
    assert got == [(n, n) for *_, n in cases]


def test_truncate_and_excerpt(spark):
    rows = [("hello", ), ("hello world this is long",), ("",), (None,)]
    got = col(spark, rows, "t string", X.truncate(F.col("t"), 10), X.truncate(F.col("t"), 5))
    assert [g[0] for g in got] == ["hello", "hello w...", "", ""]
    assert got[0][1] == "hello" and len(got[1][1]) == 5


def test_names_and_paths(spark):
    c = F.col("x")
    rows = [("at::native::add",), ("nn.Linear",), ("add.out",), (None,)]
    got = col(spark, rows, "x string", X.scope_base(c), X.dotted_base(c), X.overload_base(c), X.relative_path(c, "at::native:"))
    assert got == [("add", "at::native::add", "at::native::add", "at::native::add"), ("nn.Linear", "Linear", "nn", "nn.Linear"), ("add.out", "out", "add", "add.out"), (None, None, None, "")]
    got = col(spark, [("/src/a/b.py",), ("pytorch/c.py",), ("/other/d.py",)], "x string", X.relative_path(c, "/src/"))
    assert [g[0] for g in got] == ["a/b.py", "c.py", "/other/d.py"]
    assert col(spark, [("a.py", 3), ("b.py", None), (None, 4)], "p string, n int", X.location(F.col("p"), F.col("n"))) == [("a.py:3",), ("b.py",), (None,)]
    assert [X.clamp(n, 1, 5) for n in (-3, 1, 4, 99)] == [1, 1, 4, 5]


def test_matches_have_lines(spark):
    text = "a1\nb22\r\n\nc333 a4é5"
    got = col(spark, [(text,), ("",), (None,)], "t string", X.matches(X.newlines(F.col("t")), r"\d+"))
    assert [(x.m, x.pos, x.line) for x in got[0][0]] == [("1", 1, 1), ("22", 4, 2), ("333", 9, 4), ("4", 14, 4), ("5", 16, 4)]
    assert got[1][0] == [] and not got[2][0]


def test_word_match(spark):
    yes = [("add", "test_add"), ("add", "add_tensor"), ("add", "test_add_relu"), ("norm", "batch_norm_cpu"), ("add", "add_something"), ("relu", "relu"), ("conv", "conv2d"), ("Add", "test_add")]
    no = [("add", "padding"), ("add", "loading"), ("add", "address"), ("matmul", "softmax"), ("add", "padding_add"), ("add", "éadd")]
    got = col(spark, yes + no, "q string, n string", P.word_match(F.col("q"), F.col("n")))
    assert [g[0] for g in got] == [True] * len(yes) + [False] * len(no)


def test_predicates(spark):
    c = F.col("x")
    rows = [("/a/Test/x.py",), ("/a/src/x.cpp",), ("/test/testing/x",), ("/a/foo_test.cc",)]
    assert [r[0] for r in col(spark, rows, "x string", P.excluded(c))] == [True, False, True, True]
    assert [r[0] for r in col(spark, rows, "x string", P.in_main_tests(c))] == [False] * 4
    assert [r[0] for r in col(spark, [("nn/test_x.py",), ("a/tests/b.py",), ("ok.py",), ("__pycache__/a.py",)], "x string", P.skipped_python(c))] == [True, True, False, True]
    groups = col(spark, [("Linear",), ("ModuleList",), ("MSELoss",), ("Sequential",)], "x string", P.module_groups(c))
    assert [g[0] for g in groups] == [["layers"], ["layers", "containers"], ["losses"], ["containers"]]
    assert col(spark, [("torch.optim.sgd.SGD", "SGD"), ("torch.optim._x", "_x")], "q string, n string", P.is_optimizer(F.col("q"), F.col("n"))) == [(True,), (False,)]


def test_ranking(spark):
    df = spark.createDataFrame([("add", "a", 1), ("add", "b", 2), ("mul", "c", 3), (None, "d", 4), ("", "e", 5)], "name string, file string, ord long")
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    first = R.dedupe_first(df, ["name"], ["ord"], drop_empty=True)
    assert key(first) == [("add", "a", 1), ("mul", "c", 3)] and key(R.dedupe_first(first, ["name"], ["ord"])) == key(first)
    assert ("add", "b", 2) in key(R.last_wins(df, ["name"], ["ord"]))
    assert len(R.dedupe_first(df, ["name"], ["ord"]).collect()) == 4
    assert R.dedupe_first(df.limit(0), ["name"], ["ord"]).collect() == []
    top = R.top_k_with_total(df, 2, [F.desc("ord")])
    assert key(top) == [("", "e", 5, 1, 5), (None, "d", 4, 2, 5)]
    by = R.top_k_with_total(df, 1, [F.col("ord")], ["name"])
    assert {(r.name, r.file, r.total) for r in by.collect()} >= {("add", "a", 2), ("mul", "c", 1)}
    index = R.inverted_index(df, "name", "file", ["ord"])
    assert key(index) == [("add", 2, "a,b"), ("mul", 1, "c")]
    tiers = spark.createDataFrame([("q", 2, "x"), ("q", 1, "y"), ("q", 1, "z"), ("p", 3, "w")], "q string, tier int, v string")
    assert sorted(r.v for r in R.best_tier(tiers, ["q"], "tier").collect()) == ["w", "y", "z"]


def names(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "name string, ord long")


def q(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "query string")


@pytest.mark.parametrize(("query", "keys", "want"), [
    ("relu", ["relu"], "relu"), ("relu", ["at::native::relu"], "at::native::relu"), ("relu", ["mkldnn_relu"], "mkldnn_relu"), ("nonexistent_function_xyz", ["softmax"], None),
    ("sofmax", ["softmax"], "softmax"), ("relu", ["my_relu", "prelu"], "my_relu"), ("elu", ["xelu_longer", "elu_1"], "elu_1"), ("zz", ["zy"], None),
])
def test_fuzzy_find(spark, query, keys, want):
    got = M.fuzzy_find(q(spark, query), names(spark, *keys)).collect()
    assert [r.name for r in got] == ([want] if want else [])


def test_fuzzy_match(spark):
    def run(query, values, k=10):
        rows = M.fuzzy_match(q(spark, query), names(spark, *values), k).orderBy("rank").collect()
        return [r.name for r in rows]

    assert run("relu", ["relu", "relu6", "prelu", "leaky_relu"])[0] == "relu"
    assert set(run("norm", ["batch_norm", "layer_norm", "group_norm", "conv2d"])) == {"batch_norm", "layer_norm", "group_norm"}
    assert "softmax" in run("sofmax", ["softmax", "softmin", "sigmoid", "relu"])
    assert len(run("func", [f"func_{i}" for i in range(100)], 5)) == 5
    assert len(run("", ["a", "b", "c"])) == 3
    assert set(run("RELU", ["relu", "ReLU", "selu"])[:2]) == {"relu", "ReLU"}


def test_lookup_and_similar(spark):
    f = spark.createDataFrame([("add.Tensor", "add", 0), ("add.Scalar", "add", 1), ("Sum", "Sum", 2), ("cumsum_long", "cumsum_long", 3), ("cumsum", "cumsum", 4)], "lookup_name string, base_name string, ord long")
    got = {r.query: r.lookup_name for r in M.native_lookup(q(spark, "add.Scalar", "ADD", "sum", "umsu", "nothing"), f).collect()}
    assert got == {"add.Scalar": "add.Scalar", "ADD": "add.Tensor", "sum": "Sum", "umsu": "cumsum"}
    rows = M.similar_names(q(spark, "cumsun"), names(spark, "cumsum", "cumsunny", "cumsun", "other"), 2).orderBy("rank").collect()
    assert [(r.name, r.score) for r in rows] == [("cumsun", 0), ("cumsunny", 0)]


def test_qualified_match(spark):
    v = names(spark, "gemm", "at::gemm", "at::native::gemm", "at::Gemv", "x::gemmlike")
    run = lambda s, fuzzy=True: sorted(r.name for r in M.qualified_match(q(spark, s), v, fuzzy).collect())
    assert run("gemm") == ["gemm"] and run("native::gemm") == ["at::native::gemm"] and run("Gemv") == ["at::Gemv"]
    assert run("GEMM") == ["at::gemm", "at::native::gemm", "gemm", "x::gemmlike"] and run("gemv") == ["at::Gemv"]
    assert run("gexm") == ["at::Gemv", "at::gemm", "at::native::gemm", "gemm"] and run("gexm", False) == [] and run("gem") != []


def test_scope_ends_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ab:") for _ in range(rng.randrange(n)))
    pool, asked = sorted({text(8) for _ in range(120)}), sorted({text(5) for _ in range(40)})
    got = {(r.query, r.name, r.tier) for r in M.qualified_match(q(spark, *asked), names(spark, *pool)).collect() if r.tier < 2}
    want = set()
    for query in asked:
        hits = {(query, x, 0 if x == query else 1) for x in pool if x == query or x.endswith("::" + query)}
        want |= {h for h in hits if h[2] == min(t for *_, t in hits)}
    assert got == want and {t for *_, t in got} == {0, 1}


def bfs(edges, seeds, name, depth):
    seen, level = {}, set(seeds)
    for k in range(1, depth + 1):
        level = {a for a, b in edges if b in level and a != name and a not in seen}
        seen.update(dict.fromkeys(level, k))
    return seen


def test_impact(spark):
    rng = random.Random(4)
    for n, m in ((6, 9), (25, 60)):
        pairs = {(f"f{rng.randrange(n)}", f"f{rng.randrange(n)}") for _ in range(m)} | {("f0", "f1"), ("f1", "f0"), ("f2", "f2")}
        edges = G.merge_edges(spark.createDataFrame(sorted(pairs), "caller string, callee string"))
        plain = {p for p in pairs if p[0] != p[1]}
        got = {r.name: r.depth for r in G.impact(edges, "f1", 3).collect()}
        assert got == bfs(plain, {"f1"}, "f1", 3)
    deep = spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(9)], "caller string, callee string")
    assert G.impact(deep, "c0", 99).agg(F.max("depth")).first()[0] == 5 and G.impact(deep, "c0", -1).count() == 1
    assert G.impact(deep, "nothing at all", 2).collect() == []
    totals = {r.depth: r.n for r in G.impact_totals(G.impact(deep, "c0", 3)).collect()}
    assert totals == {1: 1, 2: 1, 3: 1, None: 3}


def test_neighbours_and_entry_points(spark):
    edges = spark.createDataFrame([("a::f", "b::g"), ("a::h", "b::g"), ("a::f", "c::k"), ("x::f", "c::k")], "caller string, callee string")
    places = spark.createDataFrame([("b::g", "g.cpp", 7)], "name string, file string, line int")
    calls = G.listed(edges, places, "f", True).orderBy("rank").collect()
    assert [(r.name, r.file, r.line, r.total) for r in calls] == [("b::g", "g.cpp", 7, 2), ("c::k", None, None, 2)]
    assert [r.name for r in G.listed(edges, places, "g", False).orderBy("rank").collect()] == ["a::f", "a::h"]
    b = spark.createDataFrame([("py.f", "a::f", "CPU", "x.cpp", 2), ("py.first", "a::f", None, "x.cpp", 1), ("other", "zz", None, "x.cpp", 0)], "python_name string, cpp_name string, dispatch_key string, file_path string, ord long")
    got = G.entry_points(G.impact(edges, "b::g", 1), b).collect()
    assert [(r.python_name, r.total) for r in got] == [("py.first", 1)]


def test_long_query_lists(spark, monkeypatch):
    """A list that is too long to be sent whole gives the same."""
    names = spark.createDataFrame([("at::native::add", 1), ("at::mul", 2), ("x::add", 3), ("addmm", 4)], "name string, ord int")
    queries = spark.createDataFrame([("add",), ("mul",), ("at::mul",), ("admm",), ("MM",), ("zzzzzz",), (None,)], "query string")
    run = lambda: (sorted(map(str, M.qualified_match(queries, names).collect())), sorted(map(str, M.fuzzy_find(queries, names).collect())), sorted(map(str, M.qualified_match(queries, names, fuzzy=False).collect())))
    short = run()
    assert [r for r in short[0] if "'add'" in r] and len(short[0]) == 8 and len(short[2]) == 1
    monkeypatch.setattr(M, "MAX_QUERIES", 2)
    assert run() == short
