"""Hierarchical best-fit packing of token sequences.

Every task packs its own pieces by best fit, longest first, and emits the bins that
are nearly full. What is left over are underfull bins; they go up a tree, ``FAN``
tasks into one, and are packed again as items that are never taken apart, until one
task has packed the last of them.

A task holds numbers only, at most ``BLOCK`` pieces at a time. After best fit at
most one bin of a block is at most half full, all others are of use only to take in
such a bin from elsewhere; so a block hands on its ``HAND_ON`` least full bins and
emits the rest, which bounds every level of the tree.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, trim
from .wordids import WordIds

CAPACITY = 4096
END = 1               # the id that closes a document
NEARLY_FULL = 0.995   # share of the capacity from which a bin is emitted at once
FAN = 8
BLOCK = 1 << 16
HAND_ON = 64


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin. Items go longest
    first (ties by position) into the bin with the least room that takes them."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0   # bit r is set while a bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            if not by_room[room - n]:
                rooms |= 1 << (room - n)
            by_room[room - n].append(b)
    return bins, offsets, np.array(fill, dtype=np.int64)


def _done(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Bins that are emitted: nearly full ones, and all but the least full others."""
    done = fill >= NEARLY_FULL * capacity
    rest = np.flatnonzero(~done)
    done[rest[np.argsort(fill[rest], kind="stable")[HAND_ON:]]] = True
    return done


COLUMNS = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, task int, done boolean"


def _bin_numbers(level: int, task: int, block: int) -> int:
    """The first of 2^17 numbers that no other block has."""
    return (level << 58) + (task << 34) + (block << 17)


def _emit(ids, piece, start, length, crc, bins, offset, done, level, task, block):
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
         pa.array(crc, pa.int64()), pa.array(bins + _bin_numbers(level, task, block)),
         pa.array(offset, pa.int64()), pa.array(np.full(len(bins), task, dtype=np.int32)), pa.array(done)],
        ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "task", "done"])


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Piece, start, length and CRC of a document given as 32-bit ids."""
    for piece, at in enumerate(range(0, max(len(ids), 1), capacity * 4)):
        part = ids[at:at + capacity * 4]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def _encode_and_pack(vocabulary, capacity, end):
    def run(batches):
        encode = WordIds.of(vocabulary)
        task, block = TaskContext.get().partitionId(), 0
        closing = array("I", [end]).tobytes()
        held, docs, size = [], [], 0

        def flush():
            piece, start, length, crc, row = (np.array(c, dtype=np.int64) for c in zip(*held, strict=True))
            bins, offset, fill = best_fit(length, capacity)
            done = _done(fill, capacity)
            ids = pa.concat_arrays(docs).take(pa.array(row))
            return _emit(ids, piece, start, length, crc, bins, offset, done[bins], 0, task, block)

        for batch in batches:
            docs.append(batch.column(0))
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + closing if text else closing
                held.extend((*p, size + i) for p in cut(ids, capacity))
            size += len(batch)
            if len(held) >= BLOCK:
                yield flush()
                held, docs, size, block = [], [], 0, block + 1
        if held:
            yield flush()
        trim()
    return run


def _pack_bins(level, capacity, last):
    """Pack the bins of a group of tasks as items; their pieces move along."""
    def run(_key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        old = table.column("sequence_id").to_numpy()
        length, offset = table.column("length").to_numpy(), table.column("offset").to_numpy()
        numbers, item = np.unique(old, return_inverse=True)
        bins, moved, fill = best_fit(np.bincount(item, weights=length).astype(np.int64), capacity)
        done = np.ones(len(fill), dtype=bool) if last else _done(fill, capacity)
        task = int(table.column("group")[0].as_py())
        return pa.Table.from_batches(_emit(
            table.column("doc_id").combine_chunks(), table.column("piece").to_numpy(),
            table.column("start").to_numpy(), length, table.column("ids_crc32").to_numpy(), bins[item],
            moved[item] + offset, done[bins][item], level, task, 0) for _ in range(1))
    return run


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int = END) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. A document is its ids followed by ``end``; only one longer than the
    capacity is cut, into pieces of full capacity and a last one. A null or empty
    text is the closing id alone. Rows that repeat, also with the same or a null
    doc_id, are packed each. Other columns are not read. An empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {COLUMNS}"
    packed = settle(own.mapInArrow(_encode_and_pack(vocabulary, capacity, end), schema), "packed")
    out = [packed.where("done")]
    rest = packed.where("not done")
    tasks, level = (rest.agg(F.max("task")).first()[0] or 0) + 1, 1
    while True:
        last = tasks <= FAN
        grouped = rest.withColumn("group", (F.col("task") / FAN).cast("int"))
        packed = settle(grouped.groupBy("group").applyInArrow(_pack_bins(level, capacity, last), schema), "packed")
        out.append(packed.where("done"))
        if last:
            break
        rest, tasks, level = packed.where("not done"), -(-tasks // FAN), level + 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("task", "done")
