"""Packed token-id output: best-fit decreasing with a segment tree over free capacities.

Each task encodes its documents, cuts those longer than a sequence without loss, and packs blocks of
a bounded number of pieces: the longest piece first, each into the open sequence with the least room
that still holds it. The segment tree counts open sequences by free room, so that search is a descent
of log2(capacity) steps. Rows are fixed-width id matrices' rows with cumulative segment lengths and
position resets, and unpack() gives back every document's ids.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id
stays null in doc_ids; extra columns are not read; an empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit import cut_pieces
from .storage import clean, release, small_arrow_batches
from .tokens import encoder

SEQUENCE = pa.schema([("block", pa.int64()), ("sequence", pa.int32()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int32())), ("pieces", pa.list_(pa.int32()))])
SEQUENCE_SQL = "block long, sequence int, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, occurrences array<int>, pieces array<int>"


class Rooms:
    """Open sequences by free room, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room of at least `size`."""
        at = self.leaves + size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces of each sequence, in the order they were placed."""
    rooms, out = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = rooms.take(lengths[k])
        room, sequence = found or (capacity, len(out))
        if found is None:
            out.append([])
        out[sequence].append(k)
        rooms.put(room - lengths[k], sequence)
    return out


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, pad_id: int = 0, id_dtype: str = "<u2", block_pieces: int = 16384) -> DataFrame:
    """Packed sequences: ids is one matrix row of `capacity` ids, padded behind n_tokens.

    cu_seqlens is 0 and the running ends of the segments; position_resets are the places where a new
    segment starts and positions begin anew at 0; doc_ids, occurrences (which of a block's rows, so
    repeated doc_ids stay apart) and pieces name each segment.
    """
    small_arrow_batches(docs.sparkSession)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, no, end = encoder(tokenizer), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        row = 0
        for b in batches:
            ids, off = words.ids(b.column(1), end)
            if len(ids) and int(ids.max()) > np.iinfo(id_dtype).max:
                raise ValueError(f"id {ids.max()} does not fit {id_dtype}")
            ids, docs_of = ids.astype(id_dtype), b.column(0).to_pylist()
            for own, k, at, n in zip(*(x.tolist() for x in cut_pieces(off, capacity)), strict=True):
                held.append((docs_of[own], row + own, k, ids[at : at + n]))
                if len(held) >= block_pieces:
                    yield from _block((part << 32) + no, held, capacity, pad_id, id_dtype)
                    held, no = [], no + 1
            row += b.num_rows
        if held:
            yield from _block((part << 32) + no, held, capacity, pad_id, id_dtype)
        held = []
        release()

    return clean(docs, id_col, text_col).mapInArrow(sequences, SEQUENCE_SQL)


def _block(no: int, held: list, capacity: int, pad_id: int, id_dtype: str) -> Iterator[pa.RecordBatch]:
    packed = pack_lengths([len(h[3]) for h in held], capacity)
    for at in range(0, len(packed), 512):
        part = packed[at : at + 512]
        matrix = np.full((len(part), capacity), pad_id, id_dtype)
        ends = [np.concatenate([[0], np.cumsum([len(held[k][3]) for k in own])]).astype(np.int32) for own in part]
        for line, own, cut in zip(matrix, part, ends, strict=True):
            for k, a, b in zip(own, cut, cut[1:], strict=False):
                line[a:b] = held[k][3]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(part), no)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([int(e[-1]) for e in ends], pa.int32()),
                pa.array([e.tolist() for e in ends], pa.list_(pa.int32())), pa.array([e[:-1].tolist() for e in ends], pa.list_(pa.int32())),
                *(pa.array([[held[k][c] for k in own] for own in part], pa.list_(kind)) for c, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))),
            ],
            schema=SEQUENCE,
        )


def position_ids(resets: list[int], n_tokens: int) -> np.ndarray:
    """Positions of a sequence's tokens, from 0 in each segment."""
    starts = np.asarray(resets)
    return np.arange(n_tokens) - np.repeat(starts, np.diff(np.append(starts, n_tokens)))


def unpack(sequences: DataFrame, id_dtype: str = "<u2") -> DataFrame:
    """doc_id and ids (little-endian binary) of every document row that pack_tokens() was given."""
    width = np.dtype(id_dtype).itemsize
    each = sequences.select("block", "ids", F.explode(F.arrays_zip("doc_ids", "occurrences", "pieces", "position_resets", F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("ends"))).alias("s"))
    cut = each.select(
        F.shiftright("block", 32).alias("part"), F.col("s.doc_ids").alias("doc_id"), F.col("s.occurrences").alias("occurrence"), F.col("s.pieces").alias("piece"),
        F.expr(f"substring(ids, s.position_resets * {width} + 1, (s.ends - s.position_resets) * {width})").alias("ids"),
    )
    held = cut.groupBy("part", "occurrence", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return held.select("doc_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
