import random
import re

import numpy as np
import xxhash

from codeloom.llm import simhash as S


def brute_fp(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    fp = [(d, brute_fp(t, 3)) for d, t in rows]
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i][1] ^ fp[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fp):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(fp)), key=str)


def corpus(rng):
    vocab = ["Alpha", "beta", "GAMMA", "delta", "é", "zwei", "x y", "Ünï"] + [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 30, 200, 700]))] for _ in range(25)]
    rows = []
    for d in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((d * 2 + 5, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(1, None), (3, ""), (4, " \n"), (0, "a b"), (None, "a b"), (None, rows[0][1]), (7, rows[2][1]), (7, rows[2][1])]


def test_against_brute_force(spark):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    want = brute_groups(rows)
    for limit in (8192, 3):
        assert sorted((tuple(r) for r in S.simhash_groups(df, limit=limit).collect()), key=str) == want
    empty = df.limit(0)
    assert S.simhash_groups(empty).collect() == [] and S.drop_near_copies(empty).collect() == []


def test_blocks_of_any_size():
    rng = np.random.default_rng(1)
    for n in (2, 63, 64, 65, 300):
        for radius in (3, 12):
            centers = rng.integers(0, 2**64, 12, dtype=np.uint64)
            x = centers[rng.integers(0, 12, n)]
            for _ in range(radius // 2 + 1):
                x = x ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
            x = np.unique(x)
            keys = np.zeros(len(x), np.int64)
            got = S._links(radius)
            batch = next(iter([S.pa.RecordBatch.from_arrays([S.pa.array(keys), S.pa.array(x.view(np.int64))], names=["key", "fp"])]))
            out = [r for b in got(iter([batch])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]

            def groups(pairs, nodes=x.view(np.int64).tolist()):
                p = {v: v for v in nodes}

                def find(v):
                    while p[v] != v:
                        v = p[v]
                    return v

                for a, b in pairs:
                    p[find(a)] = find(b)
                sets = {}
                for v in p:
                    sets.setdefault(find(v), set()).add(v)
                return sorted(map(sorted, sets.values()))

            v = x.tolist()
            want = [(int(x.view(np.int64)[i]), int(x.view(np.int64)[j])) for i in range(len(v)) for j in range(i) if bin(v[i] ^ v[j]).count("1") <= radius]
            assert groups(out) == groups(want)
            assert len(out) < len(x)


def test_drop_near_copies(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(12)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        words = t.split()
        words[50] = "changed"
        words[300] = "changed"
        rows += [(200 + i, " ".join(words)), (300 + i, t)]
    rows += [(100, base[0]), (None, base[1]), (400, None), (401, "")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, keys string")
    got = S.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [*range(100, 112), 400]
