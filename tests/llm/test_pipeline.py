"""The pipeline on the smallest tables: each stage against a plain reading of its rule, on its own input."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from codeloom.llm import decontam, simhash, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_shape(stages):
    assert [s[0] for s in stages] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_shards"]
    for _, before, after, columns, columns_after in stages[:-1]:
        assert columns_after == columns == ["doc_id", "text", "lang", "source", "n_chars"] and before and after
    for _, before, after, *_ in stages[:3]:
        assert set(after) <= set(before)


def test_toxic_documents_go(spark, stages):
    _, before, after, *_ = stages[0]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(r.text) < 0.5}


def test_one_of_each_group_stays(stages):
    """The stage's result is the rule's: the smallest id of each component of pairs of similarity 0.8 or more, and no other."""
    _, before, after, *_ = stages[1]
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in before}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, d in enumerate(ids):
        for e in ids[:i]:
            if sets[d] == sets[e] or len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                parent[max(find(d), find(e))] = min(find(d), find(e))
    assert sorted(r.doc_id for r in after) == sorted({find(d) for d in ids}) and len(after) < len(before)


def test_leaks_go(stages):
    _, before, after, *_ = stages[2]
    items = [decontam.normal(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    held = {r.doc_id for r in before if any(i in decontam.normal(r.text) for i in items)}
    assert not held & {r.doc_id for r in after} and len(before) - len(after) <= len(held) + 2


def test_every_drawn_document_becomes_tokens(stages):
    (_, before, after, *_), (_, _, rows, *_) = stages[3], stages[4]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and 0.6 < len(after) / len(before) < 1.4
    assert sum(r.n_tokens for r in rows) == sum(len(tokens.encode(r.text, tokens.TOKENIZER)) + 1 for r in after)
    assert sorted(r.place for r in rows) == list(range(len(rows)))


def test_odd_rows_pass_every_stage(spark):
    odd = [(None, None, None, None, None, "x", 1), (None, "", "en", "a", 0, None, 2), (5, "same row " * 30, "en", None, 9, "y", 3), (5, "same row " * 30, "en", None, 9, "y", 3), (6, "long " * 200_000, None, "a", 1, "z", 4), (7, "\n\t ", "fr", "a", 3, "", 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, replica string, __fp int")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            found = out.collect()
            if name == "token_shards":
                assert len(found) >= rows.count()
            else:
                assert out.columns == docs.columns and {str(r) for r in found} <= {str(r) for r in rows.collect()}
            if name in ("toxicity", "decontamination"):
                assert len(found) == rows.count()
            if name == "near_dedup":
                assert len(found) == (3 if rows is docs else 0)  # wordless rows are one group, equal rows another


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[-1][2]))
