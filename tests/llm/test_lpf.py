import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import lpf
from codeloom.llm.lpf import remove_repeats


def brute(rows, min_len):
    docs = sorted(((float("inf") if d is None else d), i, (t or "").encode(), d) for i, (d, t) in enumerate(rows))
    seen, out = set(), []
    for _, _, b, d in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - min_len + 1):
            w = b[i : i + min_len]
            if w in seen:
                gone[i : i + min_len] = b"\1" * min_len
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string")
    return sorted((tuple(r) for r in remove_repeats(df, **kw).collect()), key=str)


@pytest.mark.parametrize("hot", [1, 4096])
def test_against_brute_force(spark, hot):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "de", "ë", "fox\n", "a", "aaaaaaa"]
    passage = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for d in range(80):
        parts = [" ".join(rng.choice(words + [str(rng.random())]) for _ in range(rng.randrange(40))) for _ in range(3)]
        parts.insert(1, rng.choice(passage)[rng.randrange(20) :])
        rows.append((d * 3, " ".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (2, None), (5, ""), (7, "z" * 700), (8, "z" * 99), (9, "ab" * 300), (11, "z" * 100)]
    rng.shuffle(rows)
    assert run(spark, rows, hot=hot) == brute(rows, 100)
    assert run(spark, rows, hot=hot, min_len=40, block_bytes=500) == brute(rows, 40)
    assert run(spark, rows, hot=hot, block_bytes=500, fan=2) == brute(rows, 100)  # blocks and buckets are reached in two steps


def test_lpf_arrays():
    rng = random.Random(1)
    for trial in range(60):
        n, cap = rng.randrange(40, 300), rng.choice([32, 40, 100])
        t = bytes(rng.choice(b"ab" if trial % 2 else b"a" * 20 + b"b") for _ in range(n + cap))
        starts = np.array(sorted(rng.sample(range(n), rng.randrange(1, n))))
        order, lcp = lpf.suffix_array(np.frombuffer(t, np.uint8), starts, cap)
        suffix = [t[s : s + cap] for s in starts]
        common = lambda a, b, cap=cap: next((k for k in range(cap) if a[k] != b[k]), cap)
        assert [suffix[i] for i in order] == sorted(suffix)
        assert lcp.tolist() == [0] + [common(suffix[a], suffix[b]) for a, b in zip(order, order[1:], strict=False)]
        got, source = lpf.longest_previous_factors(order, lcp)
        assert got.tolist() == [max([common(suffix[i], suffix[j]) for j in range(i)], default=0) for i in range(len(suffix))]
        for i, s in enumerate(source.tolist()):
            assert (s < 0) == (got[i] == 0) and (s < 0 or (s < i and common(suffix[i], suffix[s]) == got[i]))


def test_edges(spark):
    assert run(spark, []) == []
    t = "some text that is long enough to be removed when it is seen for the second time, since it has 100 bytes or more."
    got = run(spark, [(None, t), (1, t), (1, t), (None, None)])
    assert sorted(r[2] for r in got) == [0, 0, len(t), len(t)]
    assert [r[2] for r in got if r[0] == 1] in ([0, len(t)], [len(t), 0])


def test_equal_rows(spark):
    long, short = " ".join(f"word {i} of the first of the equal rows," for i in range(6)), "too short"
    rows = [(4, long)] * 300 + [(None, long)] * 70 + [(4, short)] * 5 + [(None, None)] * 3 + [(9, long + "z" * 200), (9, "y" * 150)]
    got = run(spark, rows, block_bytes=200)
    assert len(got) == len(rows)
    n = len(long)
    assert sorted(r[2] for r in got if r[0] == 4 and r[1] == n) == [0] + [n] * 299
    assert all(r[2:4] == (n, 1) and r[4] == hashlib.sha256(b"").hexdigest() for r in got if r[0] is None and r[1] == n)
    assert all(r[2:] == (0, 0, hashlib.sha256(short.encode()).hexdigest()) for r in got if r[1] == len(short))
    own = {r[1]: r[2] for r in got if r[0] == 9}
    assert own[n + 200] == n + 199 and own[150] == 149  # runs overlap themselves
