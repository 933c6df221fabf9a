"""Operator 4: near-duplicate groups by SimHash and bit-sliced Hamming comparison.

``with_fingerprints`` adds a 64-bit SimHash of word shingles. ``near_groups`` links fingerprints at ``radius`` or fewer differing
bits and returns each row's group. Rows of equal fingerprints are collapsed first, so copies never meet in pairs.

Blocks to compare come from keys: with a radius of 3 or less, every pair of the five bands of a fingerprint (a pair of
fingerprints with 3 differing bits or fewer agrees in at least two bands, so this loses nothing); for larger radii, bands
of a one-permutation MinHash of the same shingles, which find a Jaccard similarity of 0.8 with probability 0.99.
In a block, bit planes are stored vertically (bit b of 64 fingerprints in one word), distances of a fingerprint to all 64
grow by carry-save counters, one plane at a time, and a block is abandoned when all its counters have passed the radius.
A block beyond ``limit`` fingerprints is compared as pairs of parts in tasks of their own: no partner is capped.
Blocks give spanning links (each fingerprint to the smallest of its group there), and components() joins them.

``drop_near_copies`` takes such groups, at a wide radius, only as places to look: fingerprints there are of shingle sets, each group's distinct
sets meet once, and ``verified_links`` links those of exact Jaccard similarity ``least`` or more, whichever pair of the group they are.

Edge cases: a null or wordless text has fingerprint zero and links like any other; shorter texts are one shingle; a group's
id is its smallest doc_id (null only if all are null); repeated rows stay as rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import NULL_ID, materialize, partitions
from codeloom.llm.graph import components

SEED = 42
BINS, BAND_ROWS = 126, 6
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: One byte lane for each bit of a byte.
_LANES = np.array([sum(1 << (8 * b) for b in range(8) if v >> b & 1) for v in range(256)], np.uint64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle; of the whole sequence if it has no more than size words. Long texts are hashed in parts."""
    raw = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    gap = _WHITE[raw]
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # one white space after each word
    flat = np.where(gap[keep], np.uint8(32), raw[keep])
    flat = flat[:-1] if len(flat) and flat[-1] == 32 else flat
    if not len(flat):
        return np.empty(0, np.uint64)
    joined, ends = flat.tobytes(), np.append(np.flatnonzero(flat == 32), len(flat))
    digest = xxhash.xxh64_intdigest
    if len(ends) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    starts, ends = np.append(0, ends[: len(ends) - size] + 1), ends[size - 1 :]
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        out[part] = [digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
    return out


def fold(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set if it is in more than half of a run. A run of none gives zero."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    starts = np.cumsum(n) - n
    pieces = (n + 254) // 255  # a byte lane holds 255
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)
        out[some] |= bits << np.uint64(8 * j)
    return out


def minhash_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of the bands of a one-permutation MinHash; empty bins take the next full one (rotation)."""
    n = len(sizes)
    bins = np.full(n * BINS, _ONES, np.uint64)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    slot = np.repeat(np.arange(n), sizes) * BINS + ((mixed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(bins, slot, mixed * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1))
    bins = bins.reshape(n, BINS)
    full = bins != _ONES
    at = np.where(full, np.arange(BINS), 2 * BINS)
    nxt = np.minimum.accumulate(np.concatenate((at, at + BINS), axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    bins = np.take_along_axis(bins, np.where(full.any(axis=1)[:, None], nxt, 0), axis=1)
    key = np.zeros((n, BINS // BAND_ROWS), np.uint64)
    for r in range(BAND_ROWS):
        key = (key ^ bins[:, r::BAND_ROWS]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key ^ np.arange(BINS // BAND_ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def with_fingerprints(df: DataFrame, shingle: int = 3, text: str = "text", fp: str = "fp", keys: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds column fp (long) and, if keys is given, an array of MinHash band keys. All other columns pass; the text only if keep_text.

    With keys, a shingle counts once a text, and columns set_id (XXH128 of the set of shingles) and set_size come last.
    """

    passed = [c for c in df.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, ids, counts = [], [], [], []
            hashes: list[np.ndarray] = []
            sizes: list[int] = []

            def flush(hashes=hashes, sizes=sizes, fps=fps, bands=bands) -> None:
                h, n = np.concatenate([np.empty(0, np.uint64), *hashes]), np.array(sizes, np.int64)
                fps.append(fold(h, n))
                if keys:
                    bands.append(minhash_keys(h, n))
                hashes.clear()
                sizes.clear()

            waiting = 0
            for value in batch.column(text):
                x = (shingle_set if keys else shingle_hashes)(value.as_py(), shingle)
                if keys:
                    ids.append(xxhash.xxh3_128_digest(x.tobytes()))
                    counts.append(len(x))
                hashes.append(x)
                sizes.append(len(x))
                waiting += len(x)
                if waiting > 200_000:
                    flush()
                    waiting = 0
            flush()
            columns = [*[batch.column(c) for c in passed], pa.array(np.concatenate(fps).view(np.int64))]
            if keys:
                flat = np.concatenate(bands)
                columns.append(pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.reshape(-1).view(np.int64)))
                columns += [pa.array(ids, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    names = [fp] + ([keys, "set_id", "set_size"] if keys else [])
    types = [df.schema[c].dataType for c in passed] + [T.LongType()] + ([T.ArrayType(T.LongType()), T.BinaryType(), T.LongType()] if keys else [])
    return df.mapInArrow(run, T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])).toDF(*passed, *names)


# ---------------------------------------------------------------- bit-sliced comparison


class _Counters:
    """How many planes differed, for 64 fingerprints in a word: carry-save counters of enough bits, and who has overflowed."""

    def __init__(self, shape, radius: int):
        self.radius, self.bits = radius, max(1, radius.bit_length())
        self.digits = [np.zeros(shape, np.uint64) for _ in range(self.bits)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, differs: np.ndarray) -> None:
        for d in range(self.bits):
            carry = self.digits[d] & differs
            self.digits[d] ^= differs
            differs = carry
        self.over |= differs

    def beyond(self) -> np.ndarray:
        """Who is past the radius: overflowed, or digits greater than the radius."""
        greater, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for d in range(self.bits - 1, -1, -1):
            if self.radius >> d & 1:
                equal = equal & self.digits[d]
            else:
                greater |= equal & self.digits[d]
                equal = equal & ~self.digits[d]
        return self.over | greater

    def take(self, rows: np.ndarray) -> None:
        self.digits, self.over = [d[rows] for d in self.digits], self.over[rows]


def _near(planes: np.ndarray, where: np.ndarray, fps: np.ndarray, candidates: np.ndarray, radius: int) -> np.ndarray:
    """For each query i, the words of candidates[i] (bits: fingerprints) within the radius. planes[b, where[i]] are its words."""
    near = np.zeros_like(candidates)
    alive = np.arange(len(fps))
    counters = _Counters(candidates.shape, radius)
    for b in range(64):
        flip = (np.uint64(0) - (fps[alive] >> np.uint64(b) & np.uint64(1))).reshape(-1, *[1] * (candidates.ndim - 1))
        counters.add(planes[b][where[alive]] ^ flip)
        if b % 8 == 7 and b < 63:  # abandon the blocks in which all are beyond the radius
            left = (candidates[alive] & ~counters.beyond()).reshape(len(alive), -1).any(axis=1)
            if not left.all():
                counters.take(np.flatnonzero(left))
                alive = alive[left]
                if not len(alive):
                    return near
    near[alive] = candidates[alive] & ~counters.beyond()
    return near


def _small_blocks(start: np.ndarray, size: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of 2 to 64 at once: one word each. -> positions of linked fingerprints and of the first of their group."""
    rows = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    x, block = fps[rows], np.repeat(np.arange(len(size)), size)
    head = np.cumsum(size) - size
    slot = (np.arange(len(x)) - head[block]).astype(np.uint64)
    planes = np.stack([np.bitwise_or.reduceat((x >> np.uint64(b) & np.uint64(1)) << slot, head) for b in range(64)])
    everyone = _ONES >> (np.uint64(64) - size.astype(np.uint64))
    near = _near(planes, block, x, everyone[block] & ~(np.uint64(1) << slot), radius)
    linked = np.flatnonzero(near)
    if not len(linked):
        return linked, linked
    reach = near[linked] | (np.uint64(1) << slot[linked])
    place = np.full(len(x), -1)
    place[linked] = np.arange(len(linked))
    while True:  # the closure of the links, by squaring
        wider = reach.copy()
        for j in range(int(size.max())):
            other = place[np.minimum(head[block[linked]] + j, len(x) - 1)]
            has = (reach >> np.uint64(j) & np.uint64(1)).astype(bool)
            wider[has] |= reach[other[has]]
        if (wider == reach).all():
            break
        reach = wider
    lowest = np.zeros(len(reach), np.int64)
    bit = reach & (~reach + np.uint64(1))
    for k in (32, 16, 8, 4, 2, 1):
        high = bit >= np.uint64(1) << np.uint64(k)
        lowest += np.where(high, k, 0)
        bit = np.where(high, bit >> np.uint64(k), bit)
    return rows[linked], rows[head[block[linked]] + lowest]


def _large_block(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One block of any size, 64 fingerprints to a word. -> positions of linked ones and of the first of their group."""
    n, width = len(x), (len(x) + 63) // 64
    padded = np.zeros(width * 64, np.uint64)
    padded[:n] = x
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    planes = np.stack([((padded >> np.uint64(b) & np.uint64(1)).reshape(width, 64) * weights).sum(axis=1, dtype=np.uint64) for b in range(64)])[:, None, :]
    everyone = np.full(width, _ONES)
    if n % 64:
        everyone[-1] = _ONES >> np.uint64(64 - n % 64)
    near = np.empty((n, width), np.uint64)
    for a in range(0, n, 128):
        q = x[a : a + 128]
        near[a : a + 128] = _near(planes, np.zeros(len(q), np.int64), q, np.tile(everyone, (len(q), 1)), radius)
    todo, member, root = everyone.copy(), [], []
    for i in range(n):
        w, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
        if not todo[w] & bit:
            continue
        todo[w] &= ~bit
        frontier = np.array([i])
        while len(frontier):
            fresh = np.bitwise_or.reduce(near[frontier], axis=0) & todo
            todo &= ~fresh
            frontier = np.flatnonzero(np.unpackbits(fresh.view(np.uint8), bitorder="little"))
            member.append(frontier)
            root.append(np.full(len(frontier), i))
    return np.concatenate(member), np.concatenate(root)


def _links(radius: int):
    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small = np.flatnonzero((size > 1) & (size <= 64))
        for part in np.array_split(small, max(1, len(small) // 20_000)):
            if len(part):
                x, y = _small_blocks(start[part], size[part], fps, radius)
                a.append(x)
                b.append(y)
        for g in np.flatnonzero(size > 64):
            x, y = _large_block(fps[start[g] : start[g] + size[g]], radius)
            a.append(x + start[g])
            b.append(y + start[g])
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        pairs = np.unique(np.stack((fps[a[keep]], fps[b[keep]])), axis=1) if keep.any() else np.empty((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:  # sorted by key; the last key's rows wait for the next batch
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            if cut:
                yield solve(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield solve(keys, fps)

    return run


def _band_keys(fp):
    """Ten keys: the pairs of the five bands of 13, 13, 13, 13 and 12 bits, and which pair it is."""
    at = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND((1 << n) - 1) for lo, n in at]
    return F.array(*[F.shiftleft(F.lit(t).cast("long"), 26).bitwiseOR(F.shiftleft(part[i], 13)).bitwiseOR(part[j]) for t, (i, j) in enumerate(combinations(range(5), 2))])


def near_links(rows: DataFrame, radius: int = 3, limit: int = 8192) -> DataFrame:
    """rows (key, fp), distinct -> a, b: links that span the groups of each key's block.

    A block of more than limit fingerprints is dealt to parts, and all pairs of parts are compared: each of its rows is then sent count / limit times.
    """
    n = partitions(rows.sparkSession)
    hot = rows.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).alias("parts"))
    if not hot.isEmpty():
        rows = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        split = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("parts") == 1, F.col("key")).otherwise(split).alias("key"), "fp").distinct()
    return rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_links(radius), "a long, b long")


def near_groups(rows: DataFrame, radius: int = 3, keys: str | None = None, limit: int = 8192) -> DataFrame:
    """rows (doc_id, fp [, keys array<long>]) -> fp, component_id: for every fingerprint the smallest doc_id of its group.

    A radius above 3 needs keys. limit: fingerprints that are compared in one task.
    """
    if radius > 3 and not keys:
        raise ValueError("a radius above 3 needs keys")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    pairs = rows.select(F.explode(keys).alias("key"), "fp").distinct() if keys else nodes.select(F.explode(_band_keys(F.col("fp"))).alias("key"), "fp")
    root = components(near_links(pairs, radius, limit)).select(F.col("node").alias("fp"), "root")
    nodes = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return nodes.join(least, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, limit: int = 8192) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialize(with_fingerprints(docs.select("doc_id", "text"), shingle, keep_text=False), "simhash")
    out = rows.join(near_groups(rows, radius, limit=limit), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- exact similarity


def _like(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each of some distinct non-empty sets the position of the first set of its component of Jaccard similarity least or more."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(size) - size
    root, marked = np.arange(len(sets)), np.zeros(flat.max() + 1, bool)
    todo, rest, n = root[1:].copy(), flat[size[0] :], size[1:]  # sets not reached, their shingles and sizes
    seed, frontier = 0, [0]
    while len(todo):
        if not frontier:
            seed = todo[0]
            frontier, todo, rest, n = [seed], todo[1:], rest[n[0] :], n[1:]
            continue
        i = frontier.pop()
        own = flat[first[i] : first[i] + size[i]]
        marked[own] = True
        common = np.add.reduceat(marked[rest], np.cumsum(n) - n, dtype=np.int64)
        marked[own] = False
        near = common / (size[i] + n - common) >= least
        if near.any():
            root[todo[near]] = seed
            frontier += todo[near].tolist()
            rest, todo, n = rest[np.repeat(~near, n)], todo[~near], n[~near]
    return root


def _links_of_sets(rows: DataFrame, least: float) -> DataFrame:
    """rows (unit, set_id, shingles) -> a, b: links that span the components among each unit's sets."""

    def solve(units: np.ndarray, ids: list[bytes], sets: list[bytes]) -> pa.RecordBatch:
        a, b = [], []
        cuts = [*np.flatnonzero(np.append(True, units[1:] != units[:-1])[: len(units)]).tolist(), len(units)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = dict(zip(ids[lo:hi], sets[lo:hi], strict=True))
            names = sorted(own)
            if len(names) > 1:
                root = _like([np.frombuffer(own[k], np.uint64) for k in names], least)
                for i in np.flatnonzero(root != np.arange(len(root))).tolist():
                    a.append(names[i])
                    b.append(names[root[i]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, ids, sets = np.empty(0, np.int64), [], []
        for batch in batches:  # sorted by unit; the last unit's rows wait for the next batch
            units = np.concatenate((units, batch.column(0).to_numpy()))
            ids += batch.column(1).to_pylist()
            sets += batch.column(2).to_pylist()
            cut = int(np.searchsorted(units, units[-1])) if len(units) else 0
            if cut:
                yield solve(units[:cut], ids[:cut], sets[:cut])
                units, ids, sets = units[cut:], ids[cut:], sets[cut:]
        yield solve(units, ids, sets)

    return rows.repartition(partitions(rows.sparkSession), "unit").sortWithinPartitions("unit").mapInArrow(run, "a binary, b binary")


def verified_links(wanted: DataFrame, texts: DataFrame, shingle: int, least: float, limit: int = 1 << 20) -> DataFrame:
    """wanted (root, set_id, set_size), texts (the same, text), a row for each set -> a, b: links of exact similarity that span the components of each root.

    limit: shingles that meet in one task. The sets of a larger root are dealt to parts, each with one set of all parts beside it. Those that this
    leaves outside of the root's largest component then meet every part, so a large group of like texts is sent twice and not once for each part.
    """
    sizes = wanted.groupBy("root").agg(F.sum("set_size").alias("total"), F.min("set_id").alias("hub"))
    sizes = materialize(sizes.select("root", "hub", F.ceil(F.col("total") / limit).alias("parts")), "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t, shingle).tobytes() for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], names=["root", "set_id", "set_size", "shingles"])

    sets = texts.select("root", "set_id", "set_size", "text").mapInArrow(run, "root long, set_id binary, set_size long, shingles binary")
    part = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    hot = sizes.where("parts > 1")
    if hot.isEmpty():
        return _links_of_sets(sets.select(F.col("root").alias("unit"), "set_id", "shingles"), least)
    sets = materialize(sets.join(sizes, "root"), "sets")
    own = F.explode(F.when(F.col("set_id") == F.col("hub"), every("parts")).otherwise(F.array(part("parts"))))
    links = materialize(_links_of_sets(sets.withColumn("own", own).select(F.xxhash64("root", "own").alias("unit"), "set_id", "shingles"), least), "links")
    large = sets.where("parts > 1")
    found = components(links).select(F.col("node").alias("set_id"), F.col("root").alias("found"))
    placed = large.select("root", "set_id", "set_size").join(found, "set_id", "left").withColumn("found", F.coalesce("found", "set_id"))
    weights = placed.groupBy("root", "found").agg(F.sum("set_size").alias("weight"))
    largest = weights.groupBy("root").agg(F.max(F.struct("weight", "found"))["found"].alias("largest"))
    rest = materialize(placed.join(largest, "root").where("found <> largest").select("root", "set_id", "set_size"), "rest")
    slices = rest.groupBy("root").agg(F.ceil(F.sum("set_size") / limit).alias("slices"))
    large = large.join(slices, "root")
    one = large.join(rest.select("set_id"), "set_id", "left_semi").withColumn("i", part("slices")).withColumn("j", F.explode(every("parts")))
    other = large.withColumn("j", part("parts")).withColumn("i", F.explode(every("slices")))
    unit = [F.xxhash64("root", "i", "j").alias("unit"), "set_id", "shingles"]
    return links.unionByName(_links_of_sets(one.select(*unit).unionByName(other.select(*unit)), least))


def drop_near_copies(docs: DataFrame, shingle: int = 5, radius: int = 20, least: float = 0.8, limit: int = 1 << 20) -> DataFrame:
    """docs without near copies: of each group one row stays, with all its columns: that of the smallest doc_id (null: last).

    Texts are linked if their sets of shingles have a Jaccard similarity of least or more. radius: within which pairs are looked for; it decides
    nothing by itself. Among rows that share the smallest doc_id the one whose text has the smallest hash stays; of equal rows one stays.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("h")]
    rows = materialize(with_fingerprints(docs.select(*key, "text"), shingle, keys="keys", keep_text=False), "simhash")
    repeated = not rows.groupBy("d", "h").count().where("count > 1").isEmpty()
    places = components(near_links(rows.select(F.explode("keys").alias("key"), "fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")
    nodes = rows.groupBy("set_id").agg(F.min("fp").alias("fp"), F.min("set_size").alias("set_size"), F.min(F.struct("d", "h")).alias("at"))
    nodes = materialize(nodes.join(places, "fp", "left").withColumn("root", F.coalesce("root", "fp")).drop("fp"), "nodes")
    shared = nodes.where("set_size > 0").groupBy("root").count().where("count > 1").select("root")
    wanted = nodes.where("set_size > 0").join(shared, "root").select("root", "set_id", "set_size", "at.d", "at.h")
    wanted = materialize(wanted, "wanted")
    texts = docs.select(*key, "text").join(wanted, ["d", "h"])
    if repeated:
        texts = texts.dropDuplicates(["set_id"])
    found = components(verified_links(wanted, texts, shingle, least, limit)).select(F.col("node").alias("set_id"), F.col("root").alias("found"))
    stay = nodes.select("set_id", "at").join(found, "set_id", "left").groupBy(F.coalesce("found", "set_id").alias("found")).agg(F.min("at").alias("at"))
    stay = stay.select(F.col("at.d").alias("__d"), F.col("at.h").alias("__h"))
    out = docs.withColumns({"__d": key[0], "__h": key[1]}).join(stay, ["__d", "__h"], "left_semi")
    if repeated:
        out = out.dropDuplicates(["__d", "__h"])
    return out.select(*docs.columns)
