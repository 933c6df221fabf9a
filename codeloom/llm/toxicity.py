"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its distinct words and of their beginnings, and the document's is the
noisy-or of its sentences': 1 - product(1 - p). Only document labels are known, and the gradient of the noisy-or tells which
sentences they speak of, so the model also locates offending sentences (``locate``).

The model is fitted on the driver to a sample of labelled rows that is bounded in rows and bytes (``max_rows``, those of smallest id hash, one text of
each, ``max_bytes``), and in features (``max_words``). Executors count the sample's features; the driver gets the numbers of the known ones, and no text; executors make the sample's features, and every text is scored whole
where it lies. Rows are labelled for training only where crc32(doc_id) mod 5 is not 0; labels, lang, source and doc_id are never inputs of a score.

Edge cases: a null, empty or wordless text has one empty sentence and so the model's base rate; a label without a document, of a
null id or null toxic is not used; a doc_id with several labels takes the largest, with several rows the text of the smallest hash; repeated rows score alike; without labels of both kinds
the model knows no words and every score is near 0 (near 1 if all labels are 1); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import free_names, materialize

FOLDS = 5
WORD = re.compile(r"\w+")
ENDS = re.compile(r"[.!?]+(?=\s|$)|\n")


#: A word's features are itself and its first letters, for words that are longer.
PREFIXES = (5, 6)
CACHE = 1 << 20


def features(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


def noisy_or(logits: list[float]) -> float:
    """1 - product(1 - p), by the sum of log(1 - p)."""
    return float(min(1.0, max(0.0, -np.expm1(-np.logaddexp(0.0, np.sort(np.array(logits))).sum()))))


def sentence_bounds(text: str | None, number: int) -> tuple[int, int]:
    """Where the sentence of this number starts and ends. Sentences are parted by marks that have no case."""
    start = 0
    for n, mark in enumerate(ENDS.finditer(text or "")):
        if n == number:
            return start, mark.start()
        start = mark.end()
    return start, len(text or "")


@dataclass
class Model:
    """Weights of features in a sentence's logit, and the logit of a sentence of none of them."""

    weights: dict[str, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            got = self.cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def logits(self, text: str | None) -> list[float]:
        """Of each sentence: the bias and the weights of its distinct words."""
        seen, bias, weight = self.cache.get, self.bias, self.weight
        out = []
        for s in ENDS.split((text or "").lower()):
            z = bias
            for word in dict.fromkeys(WORD.findall(s)):
                w = seen(word)
                z += weight(word) if w is None else w
            out.append(z)
        return out

    def score(self, text: str | None) -> float:
        return noisy_or(self.logits(text))

    def judge(self, text: str | None, least: float = 0.5) -> tuple[float, int, int | None, int | None]:
        """Score, sentences of probability least or more, and where the likeliest of them is (start, end in code points; None if there is none)."""
        z = self.logits(text)
        bad = sum(x >= math.log(least / (1 - least)) for x in z)
        return noisy_or(z), bad, *(sentence_bounds(text, z.index(max(z))) if bad else (None, None))


def _sentences(text: str | None) -> list[list[str]]:
    """The distinct words of each sentence, sorted."""
    return [sorted(set(WORD.findall(x))) for x in ENDS.split((text or "").lower())]


def _frequencies(sample: DataFrame) -> DataFrame:
    """sample (y, text) -> feature, n, toxic: in how many documents and in how many toxic ones a feature is. Added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {f for words in _sentences(text.as_py()) for w in words for f in features(w)}
                n.update(own)
                if y:
                    toxic.update(own)
        names = list(n)
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([n[f] for f in part], pa.int64()), pa.array([toxic[f] for f in part], pa.int64())], names=["feature", "n", "toxic"])

    return sample.select("y", "text").mapInArrow(run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _bags(sample: DataFrame, known: dict[str, int]) -> DataFrame:
    """sample (doc_id, y, text) -> doc_id, y, n (sentences), ids, at: numbers of the known features, and the sentence that each is in."""
    spread = sample.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = spread.value.get
        for batch in batches:
            sizes, ids, at = [], [], []
            for text in batch.column(2):
                found = _sentences(text.as_py())
                own = [(k, i) for i, words in enumerate(found) for w in words for f in features(w) if (k := number(f)) is not None]
                sizes.append(len(found))
                ids.append([k for k, _ in own])
                at.append([i for _, i in own])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(ids, kind), pa.array(at, kind)], names=["doc_id", "y", "n", "ids", "at"])

    return sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(run, "doc_id long, y int, n int, ids array<int>, at array<int>")


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_words: int = 20_000, min_docs: int = 5, least_z: float = 3.5, epochs: int = 200, l1: float = 0.7,
    max_text: int = 1 << 20, max_bytes: int = 64 << 20,
) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic).

    The sample that the driver gets: labelled ids in the order of their hashes, max_rows at most; of each one text, of those of max_text bytes or less that of the
    smallest hash; as many of them as have max_bytes together.
    Features are screened: in min_docs documents or more, and off the rate of toxic ones by least_z standard errors.
    l1: nats that a unit of a word's weight costs; a word that a few documents share by chance does not pay for it.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    marks = labels.where("doc_id is not null and toxic is not null").where(fold != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_text).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("y", "text"), F.xxhash64("text")).alias("x"))
    sample = materialize(sample.select("doc_id", "x.y", "x.text", F.octet_length("x.text").alias("size")), "labelled")
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of max_rows slim rows
    within = sample.select("doc_id", "size").withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id")
    sample = sample.join(F.broadcast(within), "doc_id")
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total or positive in (0, total):
        return Model({}, 20.0 if total and positive else -20.0)
    share = F.col("n") / total  # of all documents; as many of the toxic ones if the feature says nothing
    z = F.abs(F.col("toxic") - positive * share) / F.sqrt(positive * share * (1 - share) * (1 - positive / total) + 1e-9)
    strongest = _frequencies(sample).where(F.col("n") >= min_docs).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(max_words)
    known = sorted(r.feature for r in strongest.select("feature").collect())
    rows = _bags(sample, {f: i for i, f in enumerate(known)}).toArrow().sort_by("doc_id")
    y, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "n"))
    sizes = rows.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    feature = rows.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    at = rows.column("at").combine_chunks().flatten().to_numpy(zero_copy_only=False) + np.repeat(np.cumsum(n) - n, sizes)
    owner = np.repeat(np.arange(len(y)), n)  # of each sentence
    del rows
    w, bias = np.zeros(len(known)), -5.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, epochs + 1):
        z = bias + np.bincount(at, weights=w[feature], minlength=len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        quiet = np.bincount(owner, weights=-np.logaddexp(0, z), minlength=len(y))  # log of the chance that no sentence offends
        pull = np.where(y == 1, -1 / np.maximum(np.expm1(-np.minimum(quiet, -1e-12)), 1e-12), 1.0)  # -Q/(1-Q) or 1
        gz = pull[owner] * p / len(y)
        g = np.append(np.bincount(feature, weights=gz[at], minlength=len(known)), gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = (0.15 if step < epochs * 0.7 else 0.03) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        move = rate * m / (1 - 0.9**step)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * l1 * min(1.0, step / epochs * 2) / len(y), 0)  # proximal step of the l1 penalty, which sets in by and by
    return Model({f: float(x) for f, x in zip(known, w.tolist(), strict=True) if abs(x) > 1e-3}, float(bias))


JUDGED = {"score": T.DoubleType(), "n_offending": T.LongType(), "worst_start": T.LongType(), "worst_end": T.LongType()}


def with_scores(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """docs with four more columns (JUDGED, named by columns if given): the score, sentences of probability 1/2 or more, and where the likeliest is (null: none)."""
    spread, at = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = spread.value.judge
        for batch in batches:
            rows = [judge(x.as_py()) for x in batch.column(at)]
            own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[f"c{i}" for i in range(batch.num_columns + 4)])

    types = [f.dataType for f in docs.schema.fields] + list(JUDGED.values())
    return docs.mapInArrow(run, T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])).toDF(*docs.columns, *(columns or JUDGED))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, sentence (number), start, end (code points), p, text: sentences of probability least or more."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, z in enumerate(spread.value.logits(text)):
                    p = float(1 / (1 + np.exp(-z)))
                    if p >= least:
                        start, end = sentence_bounds(text, n)
                        rows.append((doc_id, n, start, end, p, (text or "")[start:end]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], names=["doc_id", "sentence", "start", "end", "p", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence int, start long, end long, p double, text string")


def score_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted, n_offending, worst_start, worst_end."""
    model = fit(docs, labels, **settings)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = with_scores(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end")


def drop_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs without the rows that the model predicts to be toxic, with all their columns."""
    names = free_names(docs.columns, list(JUDGED))
    return with_scores(docs, fit(docs, labels, **settings), names).where(F.col(names[0]) < 0.5).select(*docs.columns)
