"""Connected components against a plain union-find, and what they leave in the shared folder."""

import os
import random

from codeloom.llm.graph import components


def plain(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1100)]
    hub = [(5000, 5000 + i) for i in range(1, 200)]
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    pairs = [(a, b) for a, b in chain + hub + loose + loose[:20] if a != b]
    rng.shuffle(pairs)
    got = components(spark.createDataFrame(pairs + [(7, 7), (9999, 9999)], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == plain(pairs)


def test_one_table_stays(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: {x for x in os.listdir(base.removeprefix("file://")) if x.startswith("edges-")}
    before = tables()
    out = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    assert len(tables() - before) == 1 and {r.root for r in out.collect()} == {0}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
