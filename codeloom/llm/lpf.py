"""Operator 2: removal of repeated byte strings by longest-previous-factor (LPF) arrays.

``remove_repeats`` treats every text as UTF-8 bytes and removes each byte that lies in a string of ``min_len`` bytes
which also starts earlier: in a document of smaller doc_id, or earlier in the same document. Matches never cross documents;
the first copy stays.

How it is distributed. A suffix array of the whole corpus would need every suffix's first ``min_len`` bytes in the
shuffle. Instead the windows are dealt out by content: the anchor of a window is its smallest k-gram by hash, so equal
windows have equal anchors and meet in the same group.

1. Blocks of documents list their anchors' hashes, each once with its count (pre-aggregated), and buckets of the hash space
   add them up. A window whose anchor occurs once in the corpus has no copy.
2. Blocks send the runs of windows ("segments") of repeated anchors, equal segments of a block once, to buckets.
3. A bucket builds the suffix array of its distinct segments and the LCP array, both truncated at ``min_len`` bytes, finds the
   previous and next smaller positions in suffix order (PSV, NSV) and from them the LPF array; LPF >= min_len marks a window for removal.
4. An anchor in more than ``hot`` blocks is split over several buckets by block. What a split bucket leaves
   is compared once more by 128-bit window digest, with a combinable minimum, so no task ever holds a hot anchor's rows.
5. Blocks cut the marked bytes.

Blocks and buckets both grow with the input, so beyond ``fan`` of them rows reach their bucket or block in two steps (routing.py).

Edge cases: a null text is empty; an empty or short one has nothing to remove; null doc_ids come after all others; rows that share a
doc_id are documents of their own, in the order of a hash of id and text; equal rows are read once, all but the first are
removed whole if they have ``min_len`` bytes, however many they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import NULL_ID, materialize, partitions
from codeloom.llm.routing import FAN, grouped, routed

KGRAM = 24
CHUNK = 1 << 18
_LOW = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- arrays


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as one integer; the last 7 positions see zeros."""
    n = len(buf)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = buf
    out = np.empty((n + 8) // 8 * 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(padded, "<u8", count=len(out) // 8, offset=o)
        out[o::8] = part
    return out[:n]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(31)
    z += b
    z *= np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(29)
    return z


def segments(buf: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash of the anchor, first and last window start (positions in buf)."""
    total, span = len(buf), min_len - KGRAM + 1
    hashes, firsts, lasts = [], [], []
    ends = offsets[1:]
    for lo in range(0, max(0, total - min_len + 1), CHUNK):
        hi = min(total, lo + CHUNK + min_len - 1)
        n_windows = hi - lo - min_len + 1
        first_doc, last_doc = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right")
        valid = np.zeros(n_windows + 1, np.int32)
        docs = np.arange(first_doc, last_doc + 1)
        a = np.clip(offsets[docs] - lo, 0, n_windows)
        b = np.clip(ends[docs] - min_len + 1 - lo, 0, n_windows)
        some = b > a
        np.add.at(valid, a[some], 1)
        np.add.at(valid, b[some], -1)
        at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        if not len(at):
            continue
        w = _words(buf[lo:hi])
        h = _mix(_mix(w[: len(w) - 8], w[8:])[: len(w) - 16], w[16:])
        h = h[: hi - lo - KGRAM + 1]
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        anchor = (m & _LOW)[at].astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(at)) - 1
        hashes.append(h[anchor[start]])
        firsts.append(at[start] + lo)
        lasts.append(at[stop] + lo)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def suffix_array(buf: np.ndarray, starts: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes from starts in the order of their first min_len bytes, and the LCP of each with the one before, both truncated at min_len.

    Prefix doubling: ranks of 8 bytes give ranks of 16, of 32 and of 64; two ranks that overlap give min_len.
    """
    w = _words(buf)
    width, rank = 8, np.unique(w.byteswap(), return_inverse=True)[1].astype(np.uint64)
    while width * 2 <= min_len:
        nxt = np.zeros(len(rank), np.uint64)
        nxt[: len(rank) - width] = rank[width:]
        rank = np.unique((rank << np.uint64(32)) | nxt, return_inverse=True)[1].astype(np.uint64)
        width *= 2
    key = (rank[starts] << np.uint64(32)) | rank[starts + (min_len - width)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    lcp = np.full(len(order), min_len, np.int32)
    lcp[:1] = 0
    left = np.flatnonzero(key[1:] != key[:-1]) + 1
    for k in range(0, min_len, 8):  # 8 bytes at a time, of those that have not differed yet
        differ = w[starts[order[left]] + k] ^ w[starts[order[left - 1]] + k]
        off = np.flatnonzero(differ)
        low = differ[off] & (~differ[off] + np.uint64(1))  # the first byte that differs holds the lowest bit set
        lcp[left[off]] = np.minimum(k + np.log2(low.astype(np.float64)).astype(np.int32) // 8, min_len)
        left = left[differ == 0]
        if not len(left):
            break
    return order, lcp


def _smaller_before(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest rank before whose suffix starts earlier (PSV; -1: none), and the LCP with it.

    All ranks jump at once: from a rank that starts later on to the one that it points to. What lies between was passed since it starts later,
    and the least LCP on the way is that of the two ends. Jumps double, so rounds grow with the logarithm.
    """
    at = np.append(-1, order)
    to, common = np.maximum(np.arange(len(at)) - 1, 0), np.append(0, lcp)
    todo = np.arange(1, len(at))
    while True:
        common[todo[to[todo] == 0]] = 0
        todo = todo[(at[to[todo]] > at[todo]) & (common[todo] > 0)]
        if not len(todo):
            break
        via = to[todo]
        to[todo], common[todo] = to[via], np.minimum(common[todo], common[via])
    return np.where(common > 0, to - 1, -1)[1:], common[1:]


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LPF of each suffix (by its number in text order; order[r] is the number of rank r), and the number of the earlier suffix that has it (-1: none).

    LPF[i] is the larger LCP with the nearest ranks before and after that of i whose suffixes start earlier (PSV and NSV).
    """
    n = len(order)
    before, most = _smaller_before(order, lcp)
    after, other = _smaller_before(order[::-1], np.append(0, lcp[:0:-1]) if n else lcp)
    after, other = np.where(after >= 0, n - 1 - after, -1)[::-1], other[::-1]
    lpf, source = np.zeros(n, np.int32), np.full(n, -1)
    lpf[order] = np.maximum(most, other)
    best = np.where(other > most, after, before)
    source[order] = np.where(best >= 0, order[best], -1)
    return lpf, source


# ---------------------------------------------------------------- groups


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's documents in order: row numbers, keys, the texts end to end and their offsets."""
    ids = t.column("doc_id").cast(pa.int64()).combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    body = t.column("body").cast(pa.large_binary()).combine_chunks()
    if isinstance(body, pa.ChunkedArray):
        body = pa.concat_arrays(body.chunks) if body.num_chunks else pa.array([], pa.large_binary())
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        values = body.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], values[i])), dtype=np.int64)
    body = body.take(pa.array(order))
    offsets = np.frombuffer(body.buffers()[1], np.int64, count=len(body) + 1, offset=body.offset * 8) if len(body) else np.zeros(1, np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(body) and body.buffers()[2] else np.empty(0, np.uint8)
    return order, ids[order], data, offsets - offsets[0]


def _anchors(min_len: int, n_buckets: int):
    def run(key, t):
        _, _, buf, offsets = _columns(t)
        h, counts = np.unique(segments(buf, offsets, min_len)[0], return_counts=True)
        bucket = (h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        ids, at = np.unique(bucket, return_index=True)
        counts, ends = np.minimum(counts, 2).astype(np.uint8), np.append(at[1:], len(h))[: len(at)]
        return pa.table({
            "bucket": pa.array(ids.astype(np.int64)),
            "block": pa.array(np.full(len(ids), key[0].as_py(), np.int64)),
            "hashes": pa.array([h[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
        })

    return run


def _repeated(hot: int):
    def run(t):
        rows = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        if not rows:
            return pa.table({"block": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "splits": pa.array([], pa.binary())})
        h = np.concatenate(rows)
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("counts").to_pylist()])
        values, inverse, blocks = np.unique(h, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=counts, minlength=len(values))
        keep, splits = (total >= 2)[inverse], (1 + blocks // hot).astype(np.uint32)[inverse]
        ends = np.cumsum([len(x) for x in rows])
        out: tuple[list, list, list] = ([], [], [])
        for block, a, b in zip(t.column("block").to_pylist(), ends - [len(x) for x in rows], ends, strict=True):
            k = keep[a:b]
            if k.any():
                for to, x in zip(out, (block, h[a:b][k].tobytes(), splits[a:b][k].tobytes()), strict=True):
                    to.append(x)
        return pa.table({"block": pa.array(out[0], pa.int64()), "hashes": pa.array(out[1], pa.binary()), "splits": pa.array(out[2], pa.binary())})

    return run


META = np.dtype([("key", "<i8"), ("rank", "<i4"), ("start", "<i8"), ("windows", "<i4"), ("anchor", "<u4"), ("split", "?")])


def _ship(min_len: int, n_buckets: int, table):
    empty = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("copies", pa.bool_()), ("meta", pa.binary()), ("body", pa.binary())])

    def run(key, docs, answers):
        answers = table(answers)
        if not docs.num_rows or not answers.num_rows:
            return empty.empty_table()
        block = key[0].as_py()
        wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("hashes").to_pylist()])
        splits = np.concatenate([np.frombuffer(x, np.uint32) for x in answers.column("splits").to_pylist()])
        order = np.argsort(wanted)
        wanted, splits = wanted[order], splits[order]
        _, ids, buf, offsets = _columns(docs)
        h, first, last = segments(buf, offsets, min_len)
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        keep = wanted[at] == h
        h, first, last, parts = h[keep], first[keep], last[keep], splits[at[keep]]
        doc = np.searchsorted(offsets, first, "right") - 1
        meta = np.zeros(len(h), META)
        meta["key"], meta["rank"], meta["start"], meta["windows"], meta["split"] = ids[doc], doc, first - offsets[doc], last - first + 1, parts > 1
        meta["anchor"] = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        salt = _mix(h, (block % parts.astype(np.int64)).astype(np.uint64))
        bucket = ((salt >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        data, seen = buf.tobytes(), set()
        fresh = np.ones(len(h), bool)
        bodies = []
        for i, (a, b) in enumerate(zip(first.tolist(), (last + min_len).tolist(), strict=True)):
            x = data[a:b]
            bodies.append(x)
            if x in seen:
                fresh[i] = False
            else:
                seen.add(x)
        out: dict[str, list] = {name: [] for name in empty.names}
        pack = zstandard.ZstdCompressor(level=1).compress

        def row(bucket: int, rows: np.ndarray, copies: bool) -> None:
            out["bucket"].append(bucket)
            out["block"].append(block)
            out["copies"].append(copies)
            out["meta"].append(pack(meta[rows].tobytes()))
            out["body"].append(b"" if copies else pack(b"".join(bodies[i] for i in rows)))

        if not fresh.all():
            row(block % n_buckets, np.flatnonzero(~fresh), True)
        rows = np.flatnonzero(fresh)
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        ids_, at = np.unique(bucket[rows], return_index=True)
        for b, some in zip(ids_.tolist(), np.split(rows, at[1:]), strict=True):
            row(b, some, False)
        return pa.table(out, schema=empty)

    return run


MARKS = pa.schema([("left", pa.bool_()), ("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])


def _mark(min_len: int):
    def run(t):
        unpack = zstandard.ZstdDecompressor().decompress
        out: dict[str, list] = {name: [] for name in MARKS.names}

        def emit(left: bool, blocks, meta, starts, ends, digests=()) -> None:
            order = np.argsort(blocks, kind="stable")
            ids, at = np.unique(blocks[order], return_index=True)
            for b, some in zip(ids.tolist(), np.split(order, at[1:]), strict=True):
                out["left"].append(left)
                out["block"].append(b)
                out["keys"].append(meta["key"][some] if left else [])
                out["ranks"].append(meta["rank"][some])
                out["starts"].append(starts[some])
                out["ends"].append(ends[some])
                out["digests"].append([digests[i] for i in some] if left else [])

        metas, blocks, bodies = [], [], []
        for block, copies, meta, body in zip(*(t.column(c).to_pylist() for c in ("block", "copies", "meta", "body")), strict=True):
            m = np.frombuffer(unpack(meta), META)
            if copies:
                emit(False, np.full(len(m), block), m, m["start"].astype(np.int64), m["start"] + m["windows"] - 1)
                continue
            data, at = unpack(body), 0
            for size in (m["windows"] + (min_len - 1)).tolist():
                bodies.append(data[at : at + size])
                at += size
            metas.append(m)
            blocks.append(np.full(len(m), block))
        if metas:
            meta, block = np.concatenate(metas), np.concatenate(blocks)
            order = np.lexsort((meta["start"], meta["rank"], block, meta["key"]))
            meta, block = meta[order], block[order]
            seen: set[bytes] = set()
            copy = np.zeros(len(meta), bool)
            distinct = []
            for i, j in enumerate(order.tolist()):
                if bodies[j] in seen:
                    copy[i] = True
                else:
                    seen.add(bodies[j])
                    distinct.append(bodies[j])
            rows = np.flatnonzero(copy)
            if len(rows):
                emit(False, block[rows], meta[rows], meta["start"][rows], (meta["start"] + meta["windows"] - 1)[rows])
            # equal windows have equal anchors: a segment whose anchor no other distinct one has is not repeated
            kept, kblock = meta[~copy], block[~copy]
            shared = np.unique(kept["anchor"], return_inverse=True, return_counts=True)
            rows = np.flatnonzero((shared[2][shared[1]] > 1) | kept["split"])
            kept, kblock, distinct = kept[rows], kblock[rows], [distinct[i] for i in rows]
            if len(distinct):
                text = b"".join(distinct)
                n = kept["windows"].astype(np.int64)
                base = np.cumsum(n + min_len - 1) - (n + min_len - 1)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                starts = np.repeat(base, n) + within
                buf = np.frombuffer(text, np.uint8)
                repeated = longest_previous_factors(*suffix_array(buf, starts, min_len))[0] >= min_len
                owner = np.repeat(np.arange(len(kept)), n)
                place = kept["start"][owner] + within
                hit = np.flatnonzero(repeated)
                if len(hit):
                    cut = np.ones(len(hit), bool)
                    cut[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
                    a = hit[cut]
                    b = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
                    emit(False, kblock[owner[a]], kept[owner[a]], place[a], place[b])
                rest = np.flatnonzero(~repeated & kept["split"][owner])
                if len(rest):
                    digests = [xxhash.xxh3_128_digest(text[s : s + min_len]) for s in starts[rest].tolist()]
                    emit(True, kblock[owner[rest]], kept[owner[rest]], place[rest], place[rest], digests)
        return pa.table(out, schema=MARKS)

    return run


def _cut(min_len: int, with_text: bool, table):
    def run(key, docs, marks):
        marks = table(marks)
        order, _, buf, offsets = _columns(docs)
        delta = np.zeros(len(buf) + 1, np.int32)
        for ranks, starts, ends in zip(*(marks.column(c).to_pylist() for c in ("ranks", "starts", "ends")), strict=True):
            at = offsets[np.array(ranks, np.int64)]
            np.add.at(delta, at + np.array(starts, np.int64), 1)
            np.add.at(delta, at + np.array(ends, np.int64) + min_len, -1)
        gone = np.cumsum(delta[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offsets[:-1][(offsets[:-1] < len(buf)) & (np.diff(offsets) > 0)]
        edge[inner] = gone[inner]
        edges = np.concatenate(([0], np.cumsum(edge)))
        kept = buf[~gone].tobytes()
        bounds = offsets - total[offsets]
        pieces = [kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out = {
            "doc_id": docs.column("doc_id").combine_chunks().take(pa.array(order)) if docs.num_rows else pa.array([], pa.int64()),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(np.diff(total[offsets]), pa.int64()),
            "n_spans": pa.array(np.diff(edges[offsets]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array(pieces, pa.binary())
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, min_len: int = 100, block_bytes: int = 4 << 20, hot: int = 4096, with_text: bool = False, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text; other columns are ignored) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept binary].

    min_len: 32 at least. block_bytes: text in a block. hot: an anchor in more blocks than this is split. fan: blocks or buckets that one exchange serves.
    """
    if min_len < KGRAM + 8:
        raise ValueError(f"min_len must be at least {KGRAM + 8}")
    spark = docs.sparkSession
    given = F.col("doc_id").cast("long")
    docs = docs.select(given.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _remove(docs, F.xxhash64("doc_id"), min_len, block_bytes, hot, with_text, fan)
    key = ["no_id", "id", "h", "g"]
    docs = docs.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    counts = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    once = materialize(docs.dropDuplicates(key).join(counts, key).select("doc_id", "text", "copies"), "once")
    first = _remove(once.select("doc_id", "text"), F.xxhash64("doc_id", "text"), min_len, block_bytes, hot, with_text, fan)
    n, step = F.octet_length("text").cast("long"), 1 << 16
    gone = n >= min_len
    body = F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary"))
    later = once.where("copies > 1").select(
        "doc_id", n.alias("n_bytes"), F.when(gone, n).otherwise(F.lit(0)).cast("long").alias("n_removed"), gone.cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"),
        *([body.alias("kept")] if with_text else []), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))).alias("at"), "copies",
    )
    later = later.repartition(partitions(spark), "kept_sha256", "doc_id", "at")  # counts are dealt out before they become rows
    later = later.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("copies") - F.col("at")))))
    return first.unionByName(later.select(*first.columns))


def _remove(docs: DataFrame, spread: Column, min_len: int, block_bytes: int, hot: int, with_text: bool, fan: int) -> DataFrame:
    """remove_repeats for rows that are all different."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(4 * partitions(spark), math.ceil(total / block_bytes))
    n_buckets = max(partitions(spark), n_blocks // 2)
    rows = docs.select(F.pmod(spread, F.lit(n_blocks)).alias("block"), "doc_id", F.col("text").cast("binary").alias("body"))
    blocks = rows.groupBy("block")
    anchors = blocks.applyInArrow(_anchors(min_len, n_buckets), "bucket long, block long, hashes binary, counts binary")
    answers = grouped(anchors, "bucket", n_buckets, total // 2, _repeated(hot), "block long, hashes binary, splits binary", fan)
    answers, table = routed(answers, "block", n_blocks, total // 4, fan)
    sent = blocks.cogroup(answers.groupBy("block")).applyInArrow(_ship(min_len, n_buckets, table), "bucket long, block long, copies boolean, meta binary, body binary")
    marks = grouped(sent, "bucket", n_buckets, 2 * total, _mark(min_len), "left boolean, block long, keys array<long>, ranks array<int>, starts array<long>, ends array<long>, digests array<binary>", fan)
    marks = materialize(marks, "lpf-marks")
    found = marks.where("not left").select("block", "ranks", "starts", "ends")
    if not marks.where("left").isEmpty():
        left = marks.where("left").select("block", F.explode(F.arrays_zip("keys", "ranks", "starts", "digests")).alias("x"))
        left = left.select(F.struct(F.col("x.keys").alias("key"), "block", F.col("x.ranks").alias("rank"), F.col("x.starts").alias("start")).alias("at"), F.col("x.digests").alias("digest"))
        first = left.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        later = left.join(first, "digest").where("at > first")
        found = found.unionByName(later.select("at.block", F.array("at.rank").alias("ranks"), F.array("at.start").alias("starts"), F.array("at.start").alias("ends")))
    found, table = routed(found, "block", n_blocks, total // 4, fan)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return blocks.cogroup(found.groupBy("block")).applyInArrow(_cut(min_len, with_text, table), schema)
