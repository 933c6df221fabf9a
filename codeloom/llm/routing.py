"""Rows to numbered groups, where both the tasks that send and the groups that receive grow with the input.

A sender that cuts its rows by group makes (senders x groups) pieces: beyond some thousand groups the pieces are so small that their headers
outweigh them. ``grouped`` therefore sends in two steps there: rows go to coarse ranges of groups first, in compressed packs, are dealt
to the groups inside a range by tasks of bounded size, and reach their group in a second exchange. Up to ``fan`` groups one exchange does.
The groups' functions see the same rows either way, but not in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

FAN = 2048
#: Bytes of rows that wait in a sender, and of rows that one task of the first step deals out.
WAITING, SLICE = 32 << 20, 128 << 20
_PACK = "coarse long, slice long, pack binary"


def _packed(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _unpacked(packs: pa.ChunkedArray, schema: pa.Schema) -> pa.Table:
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs]
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _parts(t: pa.Table, key: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    order = np.argsort(key, kind="stable")
    t, key = t.take(pa.array(order)), key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist(), strict=True):
        yield int(key[a]), t.slice(a, b - a)


def routed(rows: DataFrame, key: str, groups: int, size: int, fan: int = FAN) -> tuple[DataFrame, Callable]:
    """rows with key (integer, 0 to groups - 1) -> rows to be grouped by key, and what makes a group's table of the original rows.

    size: bytes of all rows, about.
    """
    if groups <= fan:
        return rows, lambda t: t
    schema = to_arrow_schema(rows.schema)
    at = rows.columns.index(key)
    ranges = math.ceil(math.sqrt(groups))
    per = math.ceil(groups / ranges)
    slices = max(1, math.ceil(size / (ranges * SLICE)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % slices  # the same on every attempt
        waiting, n = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting, schema)
            packs = [(k, _packed(x)) for k, x in _parts(t, t.column(at).to_numpy() // per)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in packs], pa.int64()), pa.array([part] * len(packs), pa.int64()), pa.array([p for _, p in packs], pa.binary())], names=["coarse", "slice", "pack"])

        for batch in batches:
            waiting.append(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
            n += batch.nbytes
            if n >= WAITING:
                yield flush()
                waiting, n = [], 0
        if waiting:
            yield flush()

    def deal(t: pa.Table) -> pa.Table:
        t = _unpacked(t.column("pack"), schema)
        packs = [(k, _packed(x)) for k, x in _parts(t, t.column(at).to_numpy())]
        return pa.table({key: pa.array([k for k, _ in packs], pa.int64()), "pack": pa.array([p for _, p in packs], pa.binary())})

    packs = rows.mapInArrow(send, _PACK).groupBy("coarse", "slice").applyInArrow(deal, f"{key} long, pack binary")
    return packs, lambda t: _unpacked(t.column("pack"), schema)


def grouped(rows: DataFrame, key: str, groups: int, size: int, run: Callable, schema: str, fan: int = FAN) -> DataFrame:
    """run(table of a group's rows) -> table, for every group that has rows."""
    rows, table = routed(rows, key, groups, size, fan)
    return rows.groupBy(key).applyInArrow(lambda t: run(table(t)), schema)
