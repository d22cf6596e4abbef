"""Shared intermediate storage: lineage cuts in the checkpoint folder, and staged batches of documents.

Everything that a later job reads again is a file in ``spark.checkpoint.dir`` or a bucketed table in
the warehouse, so a lost executor costs a re-run task and never a lost block.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import rolling

#: Used only where the session names no checkpoint folder, as in tests.
DEFAULT_WORK = "/tmp/checkpoints/blockwright"
_TABLES: list[str] = []
#: Options of staged files on a local disk: no checksum file beside each. Hadoop's local file system begins a chmod for every
#: file it makes, and until that has started, it shares the executor's memory and is counted as holding all of it once more.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, else DEFAULT_WORK."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(named or DEFAULT_WORK).rstrip('/')}/blockwright"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and return the reader of those files."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_arrow_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the rows per Arrow batch: texts are long, so the default of 10,000 rows can be gigabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


#: A worker's own memory that stays with it between groups; giving back less costs more time than it saves memory.
KEPT = 160 << 20


def own_memory() -> int:
    """Bytes that this process holds alone, without mapped files; more than any bound where that can't be read."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared, *_ = map(int, f.read().split())
    except (OSError, ValueError):
        return 1 << 62
    return (resident - shared) * os.sysconf("SC_PAGE_SIZE")


def release() -> None:
    """Give freed memory back to the system: Python workers stay alive between stages, beside the JVM's heap."""
    rolling.forget_powers()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(f: Callable) -> Callable:
    """A group function that gives memory back when it is done, if its worker holds more than KEPT."""

    @functools.wraps(f)
    def g(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            if own_memory() > KEPT:
                release()

    g.__signature__ = inspect.signature(f)
    return g


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def clean(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc_id long, text string) and nothing else, so clashing names of extra columns can't matter; null text is ''.

    carry: and the whole input row but its text, as struct `row`.
    """
    own = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return docs.select(*own, *([F.struct(*[F.col(c) for c in docs.columns if c != text_col], F.lit(True).alias("__carried")).alias("row")] if carry else []))


def to_ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def with_text(carried: pa.Table, text: pa.Array, text_col: str, schema: pa.Schema) -> pa.Table:
    """The carried rows with a text column again, in the order of the schema."""
    parts = iter(carried["row"].combine_chunks().flatten())
    return pa.Table.from_arrays([text if f.name == text_col else next(parts) for f in schema], schema=schema)


def in_order(t: pa.Table) -> pa.Table:
    """The rows of a batch by seq, as they mostly stand already."""
    seq = t["seq"].to_numpy()
    return t if (seq[1:] > seq[:-1]).all() else t.sort_by("seq")


def arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


@dataclass(frozen=True)
class Staged:
    """Documents cut into batches of about batch_bytes, bucketed by batch.

    A reader that groups or cogroups by ``batch`` finds the text already dealt out by that key, so
    answers travel to the documents and the text itself never goes through a shuffle.
    """

    table: DataFrame
    n_bytes: int
    n_shards: int
    name: str


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 3 << 20, summary: Callable[[pa.Table], bytes] | None = None, carry: bool = False) -> Staged:
    """summary: of (doc_id, text) rows of a whole batch, kept in column `extra` of its first row.

    carry: the first row of a batch also holds all other input columns of the batch, in `carried`.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    schema = "batch long, seq long, doc_id long, text string" + ", extra binary" * bool(summary) + ", carried binary" * carry

    def whole(no: int, row: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        columns = [pa.array(np.full(len(t), no)), pa.array(np.arange(row, row + len(t))), *(t[k].combine_chunks() for k in ("doc_id", "text"))]
        if summary:
            columns.append(pa.array([summary(t.select(["doc_id", "text"]))] + [None] * (len(t) - 1), pa.binary()))
        if carry:
            columns.append(pa.array([to_ipc(t.drop_columns(["doc_id", "text"]))] + [None] * (len(t) - 1), pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema.replace(",", "").split()[::2])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, row, size, held = TaskContext.get().partitionId(), 0, 0, 0, []
        for b in batches:
            total, at = np.cumsum(_lengths(b.column(1))), 0
            while at < b.num_rows:
                done = int(total[at - 1]) if at else 0
                to = int(np.searchsorted(total, done + batch_bytes - size)) + 1
                piece = b.slice(at, to - at)
                held.append(piece)
                size += int(total[at + piece.num_rows - 1]) - done
                at += piece.num_rows
                if size >= batch_bytes:
                    out = whole((part << 32) + no, row, held)
                    yield out
                    no, row, size, held = no + 1, row + out.num_rows, 0, []
        if held:
            yield whole((part << 32) + no, row, held)

    seen = Observation()
    rows = clean(docs, id_col, text_col, carry).observe(seen, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).mapInArrow(cut, schema)
    n, name = shuffle_partitions(spark), f"bw_stage_{uuid.uuid4().hex}"
    rows.write.format("parquet").options(**PLAIN_FILES).option("compression", "zstd").bucketBy(n, "batch").sortBy("batch").saveAsTable(name)
    _TABLES.append(name)
    n_bytes = int(seen.get["n"])
    return Staged(spark.table(name), n_bytes, max(3 * n, math.ceil(n_bytes / (256 << 20))), name)


def _lengths(col) -> np.ndarray:
    if not len(col):
        return np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    return np.diff(np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]).astype(np.int64)


def drop_staged(spark: SparkSession) -> int:
    """Drop this session's staged tables once their results have been written; returns how many."""
    n = len(_TABLES)
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    return n
