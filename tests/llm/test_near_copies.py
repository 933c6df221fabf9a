"""The pipeline's near copies, held against exact Jaccard similarities of the texts' own shingle sets."""

import random

import pytest

from codeloom.llm import simhash as S


def sets_of(rows):
    return [set(S.shingle_hashes(t, 5).tolist()) for _, t in rows]


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def survivors(rows):
    """The smallest id of each component of pairs of similarity 0.8 or more."""
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def edited(rng, words, low, high):
    """words with single ones replaced until the similarity to words lies in [low, high)."""
    base, out = set(zip(*[words[i:] for i in range(5)], strict=False)), list(words)
    while True:
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
        like = jaccard(base, set(zip(*[out[i:] for i in range(5)], strict=False)))
        if like < low:
            out = list(words)
        elif like < high:
            return out


def pairs(seed, n, low, high):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, low, high)))]
    return rows


def kept(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in S.drop_near_copies(df, **settings).collect())


def test_pairs_of_the_least_similarity_go(spark):
    rows = pairs(1, 300, 0.8, 0.83)
    sets = sets_of(rows)
    assert all(0.8 <= jaccard(sets[i], sets[i + 1]) < 0.83 for i in range(0, 600, 2))
    assert sum(d % 2 for d in kept(spark, rows)) <= 6


def test_less_similar_documents_stay(spark):
    rng = random.Random(2)
    rows = pairs(3, 150, 0.7, 0.79)
    template = [f"t{i}" for i in range(300)]
    for i in range(60):  # a family: all hold most of one template, no two are near copies
        words = list(template)
        for at in range(rng.randrange(20), 300, 23):
            words[at] = f"own{i}x{at}"
        rows.append((1000 + i, " ".join(words)))
    assert survivors(rows) == sorted(d for d, _ in rows) == kept(spark, rows)


@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_groups_of_any_size(spark, limit):
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(200)]
    for family in range(3):
        words = edited(rng, words, 0.55, 0.65)
        rows += [(100 * family + i, " ".join(edited(rng, words, 0.86, 0.99))) for i in range(40)]
    rows += [(1000, "a b c d e f g h"), (1001, "A  b c d e f g h"), (1002, "a b c d e f g x"), (1003, rows[5][1])]
    assert kept(spark, rows, limit=limit) == survivors(rows)


def test_documents_without_an_id_are_not_copies_of_each_other(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(5)]
    df = spark.createDataFrame([(None, t) for t in [*texts, texts[0]]], "doc_id long, text string")
    assert sorted(r.text for r in S.drop_near_copies(df).collect()) == sorted(texts)
