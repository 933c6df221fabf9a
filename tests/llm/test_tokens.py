import base64
import random
from collections import defaultdict

import numpy as np

from codeloom.llm import tokens as T
from codeloom.llm.common import shared_dir


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        got = T.feistel(np.arange(n), n, 5)
        assert sorted(got.tolist()) == list(range(n))
    a, b = T.feistel(np.arange(1000), 1000, 1), T.feistel(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9


def test_fast_pattern_gives_the_same_ids():
    rng = random.Random(1)
    slow = T._encoders(T.TOKENIZER)[0]
    for _ in range(300):
        t = "".join(rng.choice(["a", "Word", "é", " ", "\n", "'s", "12", "...", "\t", " it's", " ", "的"]) for _ in range(30))
        assert T.encode(t, T.TOKENIZER).tolist() == slow.encode_ordinary(t)


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(i * 7 + 3, " ".join(rng.choice(["alpha", "beta", "é\n", "x  y", "12"]) for _ in range(rng.randrange(400)))) for i in range(150)]
    rows += [(1, None), (2, ""), (None, "no id"), (8, "same id"), (8, "same id"), (8, "other")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int").repartition(3)
    folder = shared_dir(spark, "tokens")
    manifest = spark.createDataFrame(T.training_order(T.write_shards(df, folder, length=32)).collect())
    got = T.read_shards(manifest, folder, 32, with_ids=True).collect()
    assert sorted(r.place for r in got) == list(range(len(got)))
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(T.TOKENIZER, "rb"))}
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence, r.place)):
        if r.doc_id != 8:
            whole[r.doc_id].append(r.ids)
    for d, t in rows:
        if d != 8:
            ids = np.frombuffer(b"".join(whole[d]), np.uint16).tolist()
            assert ids[-1] == T.EOS and b"".join(ranks[i] for i in ids[:-1]).decode() == (t or "")
    assert sum(r.doc_id == 8 for r in got) == 3
    key = lambda r: (r.place, r.doc_id, r.sequence, r.ids_xxh64)
    again = T.materialise_training_order(df.repartition(5), length=32).collect()
    assert sorted(map(key, again)) == sorted(map(key, got)) if None not in {r.doc_id for r in got} else sorted(map(str, map(key, again))) == sorted(map(str, map(key, got)))
    later = T.read_shards(manifest, folder, 32, start=100).collect()
    assert sorted(r.place for r in later) == list(range(100, len(got)))
    by_place = [r.doc_id for r in sorted(got, key=lambda r: r.place)]
    assert sum(a == b for a, b in zip(by_place, by_place[1:], strict=False)) < len(got) / 4  # sequences of a document are scattered
    assert T.materialise_training_order(df.limit(0)).collect() == []


def test_wide_ids_and_two_steps(spark):
    """Ids as far apart as 64 bits allow, the largest one beside a null one, and shards that are reached in two steps."""
    rng = random.Random(4)
    top = (1 << 63) - 1
    rows = [(rng.randrange(-top, top), "some words " * rng.randrange(60)) for _ in range(200)] + [(top, "at the top"), (-top - 1, "at the bottom"), (None, "nowhere"), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.place, r.sequence, str(r.doc_id), r.ids)
    results = []
    for fan in (2, T.FAN):
        folder = shared_dir(spark, "tokens")
        manifest = spark.createDataFrame(T.training_order(T.write_shards(df, folder, length=32, shard_bytes=4096, fan=fan)).collect())
        assert manifest.count() > 8
        results.append(sorted(map(key, T.read_shards(manifest, folder, 32, with_ids=True).collect())))
    assert results[0] == results[1] and [r[0] for r in results[0]] == list(range(len(results[0])))
    assert sorted({r[2] for r in results[0]}) == sorted({str(d) for d, _ in rows})
    texts = {str(d): T.np.append(T.encode(t, T.TOKENIZER), T.np.uint16(T.EOS)).tobytes() for d, t in rows}
    whole = defaultdict(bytes)
    for _, _, d, ids in sorted(results[0], key=lambda r: (r[2], r[1])):
        whole[d] += ids
    assert whole == texts
