"""Operator 6: benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and their white space is collapsed. An item of m characters may differ in
e = floor(rate x m) edits; by the q-gram lemma a passage within e edits shares at least m - q + 1 - q x e of its q-grams, all
on diagonals (place in the document less place in the item) within e of each other. Where that bound would fall below one, the
item takes shorter q-grams: q = floor(m / (e + 1)) is the longest for which the lemma still speaks. Shared q-grams are counted in diagonal
bands of width 2(e + 1) that overlap by half, so any such passage lies whole in a band; bands that reach the bound are verified
by banded alignment, which gives the exact number of edits and the place.

A document is scanned where it lies: nothing is shuffled. The benchmark is the small side: its size is measured first, and beyond
``slice_chars`` it is scanned in slices, one after the other: each pass is written to the shared folder before the next slice is sent and
the last one's index is destroyed. In a document, shared q-grams are counted in pieces of bounded size: bands behind the piece are done.

Edge cases: null or empty texts and items match nothing; an item too short for an edit must occur exactly; equal items of one id
count once; repeated rows are reported each; rows of a null doc_id are reported with it; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

HITS = "doc_id long, item_id long, start long, end long, edits int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z = (z + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return z ^ (z >> np.uint64(29))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q characters from every place, by doubling."""
    n = len(x) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, width = None, 0, x.astype(np.uint64), 1
    while True:
        if q & width:
            part = power[done : done + n]
            out = part if out is None else _mix(out, part)
            done += width
        if done == q:
            return out
        power = (power[:-1] << np.uint64(32)) | power[1:] if width == 1 else _mix(power[: len(power) - width], power[width:])
        width *= 2


#: Shared q-grams that are counted at once.
PIECE = 1 << 20
_BASE = 1 << 20


class _Grams:
    """q-grams of the items of one q: sorted hashes with postings, and a table of bits that turns most places away."""

    def __init__(self, items: list[tuple[int, str]], q: int):
        self.q = q
        hashes = [qgrams(codes(t), q) for _, t in items]
        h = np.concatenate(hashes)
        item = np.repeat(np.array([n for n, _ in items]), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes])
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        bits = max(16, math.ceil(math.log2(len(self.keys) * 24 + 1)))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """-> item, place in the item, place in x of shared q-grams, in the order of x, about PIECE at a time."""
        for lo in range(0, len(x), 1 << 18):
            h = qgrams(x[lo : lo + (1 << 18) + self.q - 1], self.q)
            at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            real = self.keys[k] == h[at]
            at, k = at[real], k[real]
            if not len(at):
                continue
            total = np.cumsum(self.count[k]) // PIECE
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(total)) + 1):
                n, start = self.count[k[some]], self.first[k[some]]
                posting = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield self.item[posting], self.place[posting], np.repeat(at[some] + lo, n)


class Index:
    """The benchmark items and their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        self.items = [(i, t) for i, t in items if t]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.edits = np.array([int(rate * len(t)) for _, t in self.items], np.int64)
        self.q = np.minimum(q, self.size // (self.edits + 1))
        self.bound = self.size - self.q + 1 - self.q * self.edits
        self.grams = [_Grams([(int(n), self.items[n][1]) for n in np.flatnonzero(self.q == k)], int(k)) for k in np.unique(self.q)]

    def candidates(self, x: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """bounds: where each document starts in x. -> document, item, first diagonal (in x) of each band that reaches the bound."""
        for grams in self.grams:
            held = np.empty((4, 0), np.int64)
            for item, ipos, dpos in grams.hits(x):
                doc = np.searchsorted(bounds, dpos, "right") - 1
                band = (dpos - ipos + _BASE) // (self.edits[item] + 1)
                rows = np.concatenate((held, np.stack((doc, item, band, ipos)), np.stack((doc, item, band - 1, ipos))), axis=1)
                rows = rows[:, np.lexsort(rows[::-1])]
                new = np.ones(rows.shape[1], bool)
                new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
                rows = rows[:, new]  # each q-gram of the item counts once in a band
                done = (rows[2] + 2) * (self.edits[rows[1]] + 1) - _BASE + self.size[rows[1]] < dpos[-1]
                yield from self._counted(rows[:, done])
                held = rows[:, ~done]
            yield from self._counted(held)

    def _counted(self, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if not rows.shape[1]:
            return
        rows = rows[:3]
        start = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0))))
        n = np.diff(np.append(start, rows.shape[1]))
        for d, i, b in rows[:, start[n >= self.bound[rows[1, start]]]].T.tolist():
            yield d, i, b * (int(self.edits[i]) + 1) - _BASE


#: Diagonals that are aligned at once.
WIDE = 1 << 14


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, int]:
    """Fewest edits between item and a passage of text on diagonals lo..hi -> edits, start, end (edits of over len(item): none)."""
    k = np.arange(lo, hi + 1)
    none = len(item) + len(text) + 1
    cost = np.where((k >= 0) & (k <= len(text)), 0, none)
    start = k.copy()
    index = np.arange(len(k))
    for i, c in enumerate(item.tolist(), 1):
        j = k + i  # characters of text used so far
        same = np.full(len(k), none)
        inside = (j >= 1) & (j <= len(text))
        same[inside] = cost[inside] + (text[j[inside] - 1] != c)
        skip = np.append(cost[1:] + 1, none)  # a character of the item is missing in the text
        skip[(j < 0) | (j > len(text))] = none
        x = np.minimum(same, skip)
        s = np.where(same <= skip, start, np.append(start[1:], 0))
        best = np.minimum.accumulate(x - index)  # characters of the text that the item lacks
        source = np.maximum.accumulate(np.where(x - index == best, index, 0))
        cost = np.where((j < 0) | (j > len(text)), none, best + index)
        start = s[source]
    at = int(np.lexsort((start, cost))[0])
    return int(cost[at]), int(start[at]), int(k[at]) + len(item)


def scan(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """-> number of the text, number of the item, start, end (in the normal form), edits: the best place of each pair."""
    batch: list[tuple[int, str]] = []
    size = 0
    for n, text in enumerate(texts):
        t = normal(text.as_py())
        batch.append((n, t))
        size += len(t) + 1
        if size > 1 << 21 or n == len(texts) - 1:
            yield from _scan(index, batch)
            batch, size = [], 0


def _scan(index: Index, batch: list[tuple[int, str]]) -> Iterator[tuple[int, int, int, int, int]]:
    texts = [t for _, t in batch]
    x = codes("\n".join(texts))  # no normal text or item has a line break
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    bands: dict[tuple[int, int], list[int]] = defaultdict(list)
    for d, i, diagonal in index.candidates(x, bounds):
        bands[d, i].append(diagonal - int(bounds[d]))
    for (d, i), places in bands.items():
        item, e = index.items[i][1], int(index.edits[i])
        at = texts[d].find(item)
        if at >= 0:
            found[d, i] = (0, at, at + len(item))
            continue
        a = x[bounds[d] : bounds[d] + len(texts[d])]
        y = codes(item)
        places.sort()
        runs = [places[:1]]
        for first in places[1:]:  # bands that touch are aligned at once, up to WIDE diagonals
            if first - runs[-1][-1] <= 2 * (e + 1) and first - runs[-1][0] < WIDE:
                runs[-1].append(first)
            else:
                runs.append([first])
        for run in runs:
            first, last = run[0] - e, run[-1] + 2 * (e + 1) + e
            lo, hi = max(0, first), min(len(a), last + len(item))
            edits, s, t = align(y, a[lo:hi], first - lo, last - lo)
            if edits <= e and (edits, s + lo) < found.get((d, i), (e + 1, 0, 0))[:2]:
                found[d, i] = (edits, s + lo, t + lo)
    for (d, i), (edits, s, t) in found.items():
        yield batch[d][0], i, s, t, edits


def indexes(benchmark: DataFrame, q: int, rate: float, slice_chars: int) -> list[DataFrame]:
    """The benchmark (item_id, text) in slices of about slice_chars characters; each text of an id once."""
    if rate * q >= 1:
        raise ValueError("rate x q must be below 1, or the lemma says nothing")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("length(text) > 0").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / slice_chars))
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == s) for s in range(slices)]


def _index(items: DataFrame, q: int, rate: float):
    """The index of one slice, as a broadcast variable."""
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Index(sorted({(r.item_id, normal(r.text)) for r in rows}, key=str), q, rate))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, slice_chars: int = 1 << 22) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> HITS: a row for each document and each item that it holds.

    start and end are characters of the document's normal form.
    """
    slices, out = indexes(benchmark, q, rate, slice_chars), None
    for items in slices:
        spread = _index(items, q, rate)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            index = spread.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[n], index.items[i][0], s, e, edits) for n, i, s, e, edits in scan(index, batch.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)
        if len(slices) > 1:
            part = materialize(part, "leaks")
            spread.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, slice_chars: int = 1 << 22) -> DataFrame:
    """docs without the rows that hold an item, with all their columns."""
    slices, at = indexes(benchmark, q, rate, slice_chars), [c.lower() for c in docs.columns].index("text")
    for items in slices:
        spread = _index(items, q, rate)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[n for n, *_ in scan(spread.value, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if len(slices) > 1:
            docs = materialize(docs, "clean")
            spread.destroy()
    return docs
