"""Copies of a document, as mixing makes them, have slots of their own."""

import random
from collections import Counter

from codeloom.llm import tokens as T
from codeloom.llm.common import shared_dir


def test_copies_are_scattered(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "é\n", "12"]) for _ in range(n))
    rare = text(60)
    rows = [(i, text(rng.randrange(1, 120))) for i in range(300)]
    rows += [(7, rare)] * 2500 + [(None, text(20)) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = shared_dir(spark, "tokens")
    manifest = spark.createDataFrame(T.training_order(T.write_shards(df, folder, length=32)).collect())
    got = T.read_shards(manifest, folder, 32, with_ids=True).orderBy("place").collect()
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((d, x[a : a + 32].tobytes()) for d, t in rows for x in [T.np.append(T.encode(t, T.TOKENIZER), T.np.uint16(T.EOS))] for a in range(0, len(x), 32))
    share = Counter(r.doc_id for r in got).most_common(1)[0][1] / len(got)
    in_shard = Counter(r.shard for r in got)
    assert len(in_shard) == 4 and max(in_shard.values()) < 1.2 * len(got) / 4  # even shards
    for s in in_shard:
        own = [r for r in got if r.shard == s]
        assert abs(sum(r.doc_id == 7 for r in own) / len(own) - share) < 0.1
    same = sum((a.doc_id, a.sequence) == (b.doc_id, b.sequence) for a, b in zip(got, got[1:], strict=False)) / len(got)
    apart = sum((c / len(got)) ** 2 for c in Counter((r.doc_id, r.sequence) for r in got).values())
    assert same < 1.2 * apart + 0.02  # neighbours are alike as often as in a random order
    again = T.materialise_training_order(df.repartition(3), length=32).collect()
    assert sorted((r.place, r.ids_xxh64) for r in again) == [(r.place, r.ids_xxh64) for r in got]
