"""Best-fit packing planned on the length histogram.

Token lengths are counted, and best-fit decreasing runs over the counts of at most `capacity`
lengths on the driver, not over documents. The plan is a short list of runs: so many pieces of one
length go into consecutive sequences at one offset. Pieces then take planned places by their rank
within their length; the rank is a task's own count plus the counts of the tasks before it, so no
length, however common, is sorted in one task.

Defined cases: a null text counts as empty and has the end id alone; repeated rows are packed as
often as they come, as documents of their own; a null doc_id stays null; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import clean, materialise, release, small_arrow_batches
from .tokens import encoder

PIECES_SQL = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, place long"
RUNS_SQL = "run_length long, rank_from long, n_items long, per_sequence long, sequence_from long, offset_from long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, items, items per sequence, first sequence, offset).

    Sequences of equal free room are kept as groups. A group that takes q = room // length items each
    has less than `length` room left, so a group is used at most log2(capacity) times, and each length
    splits at most two: the runs number under 40 * capacity whatever the data's size.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, free: int, n: int, q: int) -> None:
            nonlocal left, rank
            runs.append((length, rank, n * q, q, first, capacity - free))  # noqa: B023
            room[free - q * length].append((first, n))  # noqa: B023
            left, rank = left - n * q, rank + n * q

        def fill(first: int, free: int, n: int) -> tuple[int, int]:
            """Fill up to n sequences from `first`; returns those left untouched."""
            q = free // length  # noqa: B023
            whole = min(n, left // q)
            if whole:
                put(first, free, whole, q)
            if whole < n and left:
                put(first + whole, free, 1, left)
                whole += 1
            return first + whole, n - whole

        for free in sorted(f for f in room if f >= length and room[f]):
            groups, room[free] = room[free], []
            while groups and left:
                first, n = groups.pop()
                first, n = fill(first, free, n)
                if n:
                    groups.append((first, n))
            room[free] += groups
            if not left:
                break
        if left:
            n = -(-left // (capacity // length))
            fill(made, capacity, n)
            made += n
    return runs


def cut_pieces(off: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, begin, length) of the pieces of texts whose ids lie between the offsets."""
    size = np.diff(off)
    n = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = off[:-1][row] + piece * capacity
    return row, piece, begin, np.minimum(capacity, off[1:][row] - begin)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: only documents of over `capacity` tokens are cut."""
    small_arrow_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, end = encoder(tokenizer), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, off = own.ids(b.column(1), end)
            row, piece, begin, length = cut_pieces(off, capacity)
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist(), strict=True)]
            # the place of a piece among this task's pieces of its length
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += seen[length]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(row), part, np.int32)), b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity),
                    pa.array(length), pa.array(crc, pa.int64()), pa.array(place),
                ],
                ["part", "doc_id", "piece", "start", "length", "ids_crc32", "place"],
            )
        release()

    return clean(docs, id_col, text_col).mapInArrow(cut, PIECES_SQL)


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    rows = materialise(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    each = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = materialise(each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    counts = {r["length"]: r["n"] for r in based.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    planned = plan(counts, capacity)
    columns = list(zip(*planned, strict=True)) if planned else [[]] * 6
    runs = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in RUNS_SQL.split(", ")]))
    ranked = rows.join(based.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("place") + F.col("base"))
    at = F.col("rank") - F.col("rank_from")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("n_items")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + (at % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )
