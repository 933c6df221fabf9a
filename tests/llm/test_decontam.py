import random

import numpy as np

from codeloom.llm import decontam as D


def edits(item, text):
    """Fewest edits of item against any passage of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def mutate(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        k = rng.randrange(3)
        if k == 0:
            t[i] = rng.choice("abé ")
        elif k == 1:
            t.insert(i, rng.choice("xyz"))
        else:
            del t[i]
    return "".join(t)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["the", "Of", "thé", "ing", "ation", "er", "and", "on", "re"]
    text = lambda n: " ".join("".join(rng.choice(vocab) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(8)] + [(20, "Qx\n7"), (21, None), (22, ""), (3, "Extra  item\twith the same id, long enough to count")]
    docs = []
    for d in range(70):
        t = text(rng.randrange(60))
        if d % 2:
            leak = mutate(rng, rng.choice(items[:8])[1], rng.randrange(16))
            t = t + rng.choice([" ", "\n\n"]) + leak.upper() + " " + text(5)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (None, "a " + items[0][1]), (102, items[1][1]), (102, items[1][1]), (103, items[2][1][:-3]), (104, "qx  7"), (105, "extra item with the same id, long enough to count")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    want = []
    for d, t in docs:
        for i, b in items:
            x, y = D.normal(t), D.normal(b)
            if y and (k := edits(y, x)) <= int(0.08 * len(y)):
                want.append((d, i, k))
    assert len(want) > 15 and any(k for *_, k in want)
    for slice_chars in (1 << 22, 300):
        got = D.find_leaks(df, bench, slice_chars=slice_chars).collect()
        assert sorted(((r.doc_id, r.item_id, r.edits) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        x = D.normal(dict(docs)[r.doc_id])[r.start : r.end]
        assert min(abs(len(x) - len(D.normal(b))) for i, b in items if i == r.item_id) <= r.edits
    stay = D.drop_leaks(df, bench)
    assert stay.columns == df.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(d) for d, _ in docs if d not in {w[0] for w in want})
    assert D.find_leaks(df.limit(0), bench).collect() == []
    assert D.find_leaks(df, bench.limit(0)).collect() == []


def test_qgrams():
    x = D.codes("abcabcabcabcabcxabcabcabcabcabc")
    for q in (1, 2, 3, 7, 10, 12):
        h = D.qgrams(x, q)
        assert len(h) == len(x) - q + 1 and (h[0] == h[3]) == (q <= 12) and len(np.unique(h)) > 1


def test_short_items(spark):
    """Items for which ten characters are too long a q-gram: every passage within the budget is found all the same."""
    rng = random.Random(5)
    letters = "abcdefgh "
    items = [(n, D.normal("".join(rng.choice(letters) for _ in range(n + 6)))[:n].strip()) for n in [*range(1, 48)]]
    docs = []
    for d in range(400):
        item = rng.choice([x for x in items if len(x[1]) > 3])[1]
        docs.append((d, " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(8)) + " " + mutate(rng, item, rng.randrange(3)) + " end"))
    docs.append((1000, "zz abcdefXhijklm zz"))
    items.append((100, "abcdefghijklm"))
    got = {(r.doc_id, r.item_id, r.edits) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i, k) for d, t in docs for i, b in items if b and (k := edits(D.normal(b), D.normal(t))) <= int(0.08 * len(D.normal(b)))}
    assert got == want and (1000, 100, 1) in got and sum(k > 0 for *_, k in want) > 20


def test_repetitive_text(spark):
    """Shared q-grams of a text that repeats itself are counted in pieces; the result is that of the whole."""
    items = [(1, "ab" * 60), (2, "ab" * 30 + "c" + "ba" * 30), (3, "a" * 90)]
    docs = [(1, "ab" * 20_000), (2, "x" + "ab" * 30 + "cd" + "ba" * 30), (3, "a" * 84 + "b"), (4, "a" * 30_000)]
    piece, D.PIECE = D.PIECE, 1 << 12
    try:
        got = sorted((docs[n][0], i) for n, i, *_ in D.scan(D.Index(items, 10, 0.08), D.pa.array([t for _, t in docs])))
    finally:
        D.PIECE = piece
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 2), (4, 2)]
    assert all((edits(b, D.normal(t[:400])) <= int(0.08 * len(b))) == ((d, n) in got) for d, t in docs for n, (_, b) in enumerate(items))
