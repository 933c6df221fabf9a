import random
import zlib

import numpy as np
import pytest

from codeloom.llm import toxicity as X


def corpus(rng, n):
    vocab = [f"word{i}" for i in range(400)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(10)).capitalize() + rng.choice([".", "!", ".\n"])
    docs, labels = [], []
    for d in range(n):
        parts = [sentence() for _ in range(rng.randrange(1, 25))]
        toxic = d % 6 == 0
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] = "You " + rng.choice(["Fool", "idiot!!", "schlimmwort" + rng.choice("abcdef")]) + ", " + parts[at]
        docs.append((d, " ".join(parts)))
        labels.append((d, int(toxic)))
    return docs, labels


def test_learns_located_sentences(spark):
    rng = random.Random(1)
    docs, labels = corpus(rng, 900)
    docs += [(5000, None), (5001, ""), (5002, "?!"), (None, docs[0][1]), (7, "you fool, again"), (7, "clean")]
    labels += [(None, 1), (9999, 1), (13, None)]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = X.score_documents(df, marks).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    held = [r for d, r in by.items() if d is not None and d < 900 and d != 7 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in by.items() if d is not None)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[5000].score == by[5001].score < 0.5 and by[None].predicted == 1 and not by[None].held_out
    assert sorted(r.predicted for r in got if r.doc_id == 7) == [0, 0, 1]

    model = X.fit(df, marks)
    found = X.locate(spark.createDataFrame(docs[:300], "doc_id long, text string"), model).collect()
    texts = dict(docs[:300])
    right = sum(any(w in r.text.lower() for w in ("fool", "idiot", "schlimm")) for r in found)
    assert right / len(found) > 0.95 and len({r.doc_id for r in found}) > 40
    assert all(texts[r.doc_id][r.start : r.end] == r.text for r in found)
    for r in got:  # the worst sentence is one of those that locate finds, and they are counted
        if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 7:
            own = [x for x in found if x.doc_id == r.doc_id]
            assert r.n_offending == len(own)
            assert (r.worst_start, r.worst_end) in {(x.start, x.end) for x in own if x.p == max(y.p for y in own)} if own else r.worst_start is r.worst_end is None
    stay = X.drop_toxic(df, marks)
    assert stay.columns == df.columns and stay.count() == sum(r.predicted == 0 for r in got)
    assert X.score_documents(df.limit(0), marks).collect() == []
    none = X.score_documents(df, marks.limit(0)).collect()
    assert len(none) == len(docs) and all(r.predicted == 0 for r in none)


def test_noisy_or():
    m = X.Model({"bad": 3.0, "terri*": 1.0}, -2.0)
    z = m.logits("So bad bad. Terrible. fine\nterri")
    assert z == [1.0, -1.0, -2.0, -2.0]
    assert m.score("So bad bad. Terrible. fine\nterri") == pytest.approx(1 - np.prod(1 / (1 + np.exp(z))))


def test_locate_edges(spark):
    m = X.Model({"bad": 9.0}, -4.0)
    rows = [(1, None), (2, ""), (3, "Bad\n\n  fine! BAD"), (3, "Bad\n\n  fine! BAD"), (None, "x. İbad bad?"), (4, "good. " * 50_000 + "bad")]
    found = X.locate(spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, start int"), m).collect()
    assert sorted(((r.doc_id, r.sentence, r.start, r.end, r.text) for r in found), key=str) == sorted([(3, 0, 0, 3, "Bad"), (3, 3, 12, 16, " BAD")] * 2 + [(None, 1, 2, 11, " İbad bad"), (4, 50_000, 299_999, 300_003, " bad")], key=str)
    assert X.locate(spark.createDataFrame([], "doc_id long, text string"), m).collect() == []
    assert m.judge(None) == (pytest.approx(1 / (1 + np.exp(4))), 0, None, None) and m.judge("a. bad. bad bad")[1:] == (2, 2, 6)
