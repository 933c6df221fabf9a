"""What the driver gets to fit the model."""

import zlib

from codeloom.llm import toxicity as X


def test_one_text_of_each_labelled_document(spark, monkeypatch):
    ids = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5]
    rows = [(d, f"some text {d}. fool" if d % 3 else f"some text {d}.") for d in ids] + [(ids[0], f"row {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(d, int(d % 3 > 0)) for d in ids], "doc_id long, toxic int")
    seen, bags = [], X._bags
    monkeypatch.setattr(X, "_bags", lambda sample, known: seen.append(sorted(map(str, sample.select("y", "text").collect()))) or bags(sample, known))
    models = [X.fit(df, marks), X.fit(df.repartition(3), marks)]
    assert len(seen[0]) == len(ids) and seen[0] == seen[1]
    assert models[0].weights == models[1].weights


def test_bound_of_the_sample(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('fine ', id) as text")
    seen, bags = [], X._bags
    try:
        X._bags = lambda sample, known: seen.append(sample.count()) or bags(sample, known)
        X.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    finally:
        X._bags = bags
    assert seen == [8000]


def test_bytes_of_the_sample(spark):
    """Long texts are left out and the rest is bounded together; what is taken does not depend on how rows are dealt."""
    rows = [(d, ("fool " if d % 2 else "fine ") * (10 if d % 7 else 50_000)) for d in range(400)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, toxic int")
    seen, bags = [], X._bags
    try:
        X._bags = lambda sample, known: seen.append(sorted(r.text for r in sample.collect())) or bags(sample, known)
        X.fit(docs, marks, max_text=100_000, max_bytes=5_000)
        X.fit(docs.repartition(5), marks, max_text=100_000, max_bytes=5_000)
    finally:
        X._bags = bags
    assert seen[0] == seen[1] and len(seen[0]) == 100 and sum(map(len, seen[0])) == 5_000
