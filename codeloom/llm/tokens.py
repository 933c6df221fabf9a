"""Operator 5: token-ID shards in training order.

Texts become token ids of a byte-level BPE vocabulary, each document ended by ``eos``, cut into sequences of ``length`` ids. A keyed
Feistel permutation with cycle-walking sends every sequence's index to a slot of the same domain, which is known before any text is
read into tokens; range partitions of the slots are sorted and written as shards of fixed
stride, so the n-th record of a shard is one seek away and a reader resumes from any record. A record's global place in training
order is the records of the shards before plus its own number: ``training_order`` gives it from the manifest.

A sequence's index is its row's place x the most sequences that any row can have, plus its number. A row's place is its doc_id, if no two rows
share one and the ids lie close enough together for 62 bits. Else rows are put in the order of (doc_id, text hashes), equal rows one after the
other, and each has as many indexes as its bytes allow sequences: so ids may lie as far apart as they like, and every copy of a document
has slots of its own; equal rows are read into tokens once.

Tokens are made once and shuffled once (twice beyond 2,048 shards, see routing.py), in compressed blobs. The number of shards follows
the input's bytes, so a shard fits a task. A task writes under a fresh name and reports it, so a repeated attempt is harmless; the
order is the same on every run.

Record: doc_id int64, sequence int32, tokens int32 (little endian), then ``length`` ids as uint16, padded with eos. A row without a doc_id
has zero there and the complement of its sequence number, which is negative.

Edge cases: a null or empty text is one record of eos alone; a null doc_id takes the place after the largest; any doc_id of 64 bits is
allowed; rows that share a doc_id are scattered like any others; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, partitions, shared_dir
from codeloom.llm.routing import FAN, grouped

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's pre-tokenizer parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOS = 50256
LENGTH = 256
KEY = 0x5EED
#: Characters that are read into tokens at once, copies counted.
BATCH = 4 << 20
HEAD = np.dtype([("doc_id", "<i8"), ("sequence", "<i4"), ("tokens", "<i4")])


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The vocabulary with its own pattern, and with one that gives the same ids, faster, where white space never repeats."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return [tiktoken.Encoding(f"own{i}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for i, p in enumerate((PATTERN, PATTERN.replace(r"\s+(?!\S)|", "")))]


_RUNS = re.compile(r"\s\s")


def encode(text: str | None, path: str) -> np.ndarray:
    slow, fast = _encoders(path)
    text = text or ""
    return (slow if _RUNS.search(text) else fast).encode_to_numpy(text, disallowed_special=()).astype(np.uint16)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    z = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def feistel(index: np.ndarray, domain: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of [0, domain): balanced Feistel rounds on the next even number of bits; values outside walk on."""
    half = np.uint64(max(1, math.ceil(math.ceil(math.log2(max(domain, 2))) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(rounds):
            left, right = right, left ^ (_round(right, key + r * 0x632BE59BD9B4E019) & mask)
        x = (left << half) | right
        out[todo] = x
        todo = todo[x >= np.uint64(domain)]
    return out


def _numbered(docs: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """docs (null_id, doc_id, text, most) -> the same with base and copies, equal rows once: base is the first index of the first copy; and the number of indexes.

    Only counts are sorted. Rows of many copies are parted, so that no task writes all copies of one document.
    """
    n, key = partitions(docs.sparkSession), ["null_id", "doc_id", "h", "g"]
    docs = docs.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            own = batch.column(4).to_numpy() * batch.column(5).to_numpy()
            ends = before + np.cumsum(own)
            if len(ends):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(ends - own)], names=[*key, "copies", "most", "own", "inside"])
                before = int(ends[-1])

    counts = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.max("most").alias("most")).repartitionByRange(n, *key).sortWithinPartitions(*key)
    counts = counts.mapInArrow(run, "null_id boolean, doc_id long, h long, g long, copies long, most long, own long, inside long")
    counts = materialize(counts.withColumn("part", F.spark_partition_id()), "counts")
    sums = counts.groupBy("part").agg(F.sum("own").alias("sum"))  # a row for each of n partitions
    before = F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    total, copies = counts.agg(F.sum("own"), F.max("copies")).first()
    counts = counts.join(F.broadcast(sums), "part").select(*key, "copies", (F.col("before") + F.col("inside")).alias("place"))
    rows = docs.dropDuplicates(key).join(counts, key)
    step = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.lit(BATCH) / (F.coalesce(F.octet_length("text"), F.lit(0)) + 1)))).cast("long")
    rows = rows.withColumn("step", step)
    parted = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.col("step"))))
    if copies and (copies > 1024 or copies * (longest + 1) > BATCH):
        some = parted.where("copies > step").repartition(n, *key, "at")
        parted = rows.where("copies <= step").withColumn("at", F.lit(0).cast("long")).unionByName(some)
    base = F.col("place") + F.col("at") * F.col("most")
    return parted.select("null_id", "doc_id", "text", "most", base.alias("base"), F.least("step", F.col("copies") - F.col("at")).alias("copies")), total or 0


def write_shards(
    docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, length: int = LENGTH, eos: int = EOS, key: int = KEY, shard_bytes: int = 64 << 20, fan: int = FAN
) -> DataFrame:
    """docs (doc_id, text) -> manifest: shard (in order), path, records, stride. Files are written when the result is read.

    tokenizer: path of a vocabulary of ranks, present on every machine. shard_bytes: bytes of text for each shard.
    fan: shards beyond which blobs are sent in two steps.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    most = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / length).cast("long") + 1  # byte-level tokens are no more than bytes; one more for eos
    given = F.col("doc_id").cast("long")
    docs = docs.select(given.isNull().alias("null_id"), F.coalesce(given, F.lit(0).cast("long")).alias("doc_id"), "text", most.alias("most"))
    real = F.when(~F.col("null_id"), F.col("doc_id"))
    size = docs.agg(F.min(real).alias("low"), F.max(real).alias("high"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest"), F.max("most").alias("most"), F.count(F.lit(1)).alias("rows")).first()
    low, span = size.low or 0, (size.high or 0) - (size.low or 0) + 2  # one place for null ids
    domain = span * (size.most or 1)
    if domain < 1 << 62 and docs.groupBy("null_id", "doc_id").count().where("count > 1").isEmpty():
        docs = docs.select("null_id", "doc_id", "text", "most", (F.coalesce(real - low, F.lit(span - 1)) * (size.most or 1)).alias("base"), F.lit(1).cast("long").alias("copies"))
    else:
        docs, domain = _numbered(docs, size.longest or 0)
    record = np.dtype([("head", HEAD), ("ids", "<u2", (length,))])
    stored = (size.bytes or 0) + size.rows * record.itemsize  # a row is one record at least
    shards = max(partitions(spark), math.ceil(stored / shard_bytes))
    one_step = shards <= fan

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress if one_step else bytes
        for batch in batches:
            weight = np.cumsum([len(t or "") * c + 1024 for t, c in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)])
            cuts = np.flatnonzero(np.diff(weight // BATCH, prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=False):
                part = batch.slice(lo, hi - lo)
                no_id, ids, most, base, copies = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3, 4, 5))
                tokens = [np.append(encode(t, tokenizer), np.uint16(eos)) for t in part.column(2).to_pylist()]
                sizes = np.array([len(t) for t in tokens], np.int64)
                copy = np.repeat(np.arange(len(sizes)), copies)  # the row of each copy
                first = base[copy] + (np.arange(len(copy)) - np.repeat(np.cumsum(copies) - copies, copies)) * most[copy]
                n = (sizes[copy] + length - 1) // length
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                slot = feistel((np.repeat(first, n) + number).astype(np.uint64), domain, key)
                doc = np.repeat(copy, n)
                head = np.zeros(len(doc), HEAD)
                head["doc_id"], head["sequence"], head["tokens"] = ids[doc], np.where(no_id[doc], ~number, number), np.minimum(length, sizes[doc] - number * length)
                flat = np.concatenate(tokens)
                first = (np.cumsum(sizes) - sizes)[doc] + number * length
                # slots are below 2**62, shards below 2**31: multiply in halves
                shard = _scale(slot, shards, domain)
                order = np.argsort(shard, kind="stable")
                found, at = np.unique(shard[order], return_index=True)
                rows = []
                for some in np.split(order, at[1:]):
                    body = b"".join(flat[a : a + k].tobytes() for a, k in zip(first[some].tolist(), head["tokens"][some].tolist(), strict=True))
                    rows.append(pack(slot[some].tobytes() + head[some].tobytes() + body))
                counts = np.diff(np.append(at, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(rows, pa.binary())], names=["shard", "records", "body"])

    def write(t):
        shard = t.column("shard")[0].as_py()
        unpack = zstandard.ZstdDecompressor().decompress if one_step else bytes
        slots, heads, bodies = [], [], []
        for n, blob in zip(t.column("records").to_pylist(), t.column("body").to_pylist(), strict=True):
            data = unpack(blob)
            slots.append(np.frombuffer(data, np.uint64, count=n))
            heads.append(np.frombuffer(data, HEAD, count=n, offset=8 * n))
            bodies.append(np.frombuffer(data, np.uint16, offset=(8 + HEAD.itemsize) * n))
        slot, head, body = np.concatenate(slots), np.concatenate(heads), np.concatenate(bodies)
        first = np.cumsum(head["tokens"], dtype=np.int64) - head["tokens"]
        order = np.argsort(slot)  # no two records share a slot
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/{shard:08d}-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(path, compression=None) as out:
            for lo in range(0, len(order), 8192):
                some = order[lo : lo + 8192]
                block = np.zeros(len(some), record)
                block["head"] = head[some]
                n = head["tokens"][some].astype(np.int64)
                inside = np.arange(length) < n[:, None]
                ids = np.full((len(some), length), eos, np.uint16)
                ids[inside] = body[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                block["ids"] = ids
                out.write(block.tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "records": pa.array([len(order)], pa.int64()), "stride": pa.array([record.itemsize], pa.int32())})

    blobs = docs.mapInArrow(tokenize, "shard int, records int, body binary")
    return grouped(blobs, "shard", shards, stored, write, "shard int, path string, records long, stride int", fan)


def _scale(slot: np.ndarray, shards: int, domain: int) -> np.ndarray:
    """floor(slot * shards / domain) up to rounding that never decreases: equal ranges of slots."""
    return np.minimum((slot.astype(np.float64) * (shards / domain)).astype(np.int64), shards - 1)


def training_order(manifest: DataFrame) -> DataFrame:
    """manifest, with first: the place in training order of each shard's first record. The manifest has a row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame, folder: str, length: int = LENGTH, start: int = 0, with_ids: bool = False) -> DataFrame:
    """manifest (shard, path, stride, first) -> place, shard, doc_id, sequence, n_tokens, ids_xxh64 [, ids]; from place start on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for shard, path, stride, first in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                with store.open_input_file(path) as f:
                    f.seek(max(0, start - first) * stride)
                    place = max(first, start)
                    while data := f.read(stride * 8192):
                        block = np.frombuffer(data, np.dtype([("head", HEAD), ("ids", "<u2", (length,))]))
                        n, h = len(block), block["head"]
                        bodies = [x[:k].tobytes() for x, k in zip(block["ids"], h["tokens"].tolist(), strict=True)]
                        columns = [pa.array(np.arange(place, place + n)), pa.array(np.full(n, shard, np.int32)), pa.array(h["doc_id"].astype(np.int64), mask=h["sequence"] < 0), pa.array(np.maximum(h["sequence"], ~h["sequence"]).astype(np.int32)), pa.array(h["tokens"].astype(np.int32))]
                        columns.append(pa.array(np.array([xxhash.xxh64_intdigest(b) for b in bodies], np.uint64).view(np.int64)))
                        if with_ids:
                            columns.append(pa.array(bodies, pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, names=["place", "shard", "doc_id", "sequence", "n_tokens", "ids_xxh64", "ids"][: len(columns)])
                        place += n

    schema = "place long, shard int, doc_id long, sequence int, n_tokens int, ids_xxh64 long" + (", ids binary" if with_ids else "")
    rows = manifest.where(F.col("first") + F.col("records") > start).select("shard", "path", "stride", "first")
    return rows.repartition(partitions(manifest.sparkSession), "shard").mapInArrow(run, schema)


def materialise_training_order(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """Write the shards, read them back -> place, shard, doc_id, sequence, n_tokens, ids_xxh64: a row for each sequence."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_shards(training_order(write_shards(docs, folder, tokenizer, length, key=key)), folder, length)
