"""The block container: header, records, chunk index, and a data source that reads it chunk by chunk.

Spark reads the files (binaryFile, any store); a file is split at its index, and each chunk of records
is parsed on its own after an exchange by chunk, so one large file is decoded by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from blockwright.functions.blockmath import Reader, Record, varint

# Fixed values of the file format.
MAGIC = "AMBI"
INDEX_PREFIX = b"AMBI"
INDEX_V1, INDEX_V2 = b"IDX!", b"IDX2"

RECORD_SQL = "x int, y int, w int, h int, q int, k int, h_bits int, hp long, refine_flag int, refine_idx int, comp_id int, raw_len int, payload binary"
RECORD_NAMES = [c.split()[0] for c in RECORD_SQL.split(", ")]


def header_bytes(version: int, w: int, h: int, block: int, n: int, magic: str = MAGIC) -> bytes:
    return magic.encode("ascii")[:4] + version.to_bytes(2, "big") + w.to_bytes(4, "big") + h.to_bytes(4, "big") + block.to_bytes(2, "big") + varint(n)


def header_fields(data: bytes) -> dict:
    """The fields of a header as written, with where the records start."""
    r = Reader(data)
    magic = r.take(4).decode("ascii")
    version, w, h, block = r.number(2), r.number(4), r.number(4), r.number(2)
    n = r.varint()
    return {"magic": magic, "version": version, "w": w, "h": h, "block": block, "n": n, "start": r.at}


def read_header(data: bytes) -> dict:
    """The header of a file; more blocks than its image can hold are an error."""
    head = header_fields(data)
    block = max(1, head["block"])
    most = 2 * -(-head["w"] // block) * -(-head["h"] // block)
    if not 0 < head["n"] <= most:
        raise ValueError(f"{head['n']} blocks in an image that holds {most} at most")
    return head


def index_bytes(chunks: list[tuple[int, int]], version: int, crc: int) -> bytes:
    """The footer: (offset, records) of each chunk, for version 2 on with the payload's CRC."""
    table = INDEX_PREFIX + varint(len(chunks)) + b"".join(varint(a) + varint(n) for a, n in chunks)
    size = len(table).to_bytes(8, "little")
    return table + (crc.to_bytes(4, "little") + size + INDEX_V2 if version >= 2 else size + INDEX_V1)


def read_index(data: bytes) -> dict | None:
    """Chunk ranges (start, end, records), or None where there is no sound index."""
    kinds = {INDEX_V1: 12, INDEX_V2: 16}
    tail = kinds.get(data[-4:])
    if tail is None or len(data) < tail:
        return None
    at = len(data) - tail - int.from_bytes(data[-12:-4], "little")
    if at < 0 or not data[at : len(data) - tail].startswith(INDEX_PREFIX):
        return None
    r = Reader(data[: len(data) - tail], at + len(INDEX_PREFIX))
    try:
        chunks = [(r.varint(), r.varint()) for _ in range(r.varint())]
    except ValueError:
        return None
    ends = [a for a, _ in chunks[1:]] + [at]
    return {"ranges": [(a, e, n) for (a, n), e in zip(chunks, ends, strict=True)], "payload_end": at, "crc": int.from_bytes(data[-16:-12], "little") if tail == 16 else None}


def assemble(records: list[bytes], version: int, w: int, h: int, block: int, chunk: int) -> bytes:
    head, body, chunks = header_bytes(version, w, h, block, len(records)), [], []
    at = len(head)
    for k, r in enumerate(records):
        if k % chunk == 0:
            chunks.append((at, min(chunk, len(records) - k)))
        body.append(r)
        at += len(r)
    payload = b"".join(body)
    return head + payload + index_bytes(chunks, version, zlib.crc32(payload))


def split(data: bytes) -> tuple[dict, list[tuple[int, int, int]]]:
    """(header, ranges). A file without an index is one range of all its records; a wrong CRC is an error."""
    head, index = read_header(data), read_index(data)
    if index is None:
        return head, [(head["start"], len(data), head["n"])]
    if index["crc"] is not None and zlib.crc32(data[head["start"] : index["payload_end"]]) != index["crc"]:
        raise ValueError("the payload's CRC differs")
    return head, index["ranges"]


def parse_records(data: bytes, n: int, version: int) -> Iterator[Record]:
    r = Reader(data)
    for _ in range(n):
        yield Record.read(r, version)


def read_containers(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(name, image_w, image_h, leaf_no, record columns) of containers in a column of bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, ranges = split(data)
                first = 0
                rows = []
                for a, e, n in ranges:
                    rows.append((file, head["version"], head["w"], head["h"], first, n, data[a:e]))
                    first += n
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["name", "version", "image_w", "image_h", "first", "n", "data"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                records = [astuple(r) for r in parse_records(row["data"], row["n"], row["version"])]
                columns = list(zip(*records, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([row[c]] * len(records)) for c in ("name", "image_w", "image_h")] + [pa.array(range(row["first"], row["first"] + len(records)), pa.int32())] + [pa.array(c, pa.binary() if k == "payload" else pa.int64() if k == "hp" else pa.int32()) for c, k in zip(columns, RECORD_NAMES, strict=True)], ["name", "image_w", "image_h", "leaf_no", *RECORD_NAMES])

    chunks = files.select(F.col(name).cast("string"), F.col(content)).mapInArrow(cut, "name string, version long, image_w long, image_h long, first long, n long, data binary")
    return chunks.repartition("name", "first").mapInArrow(parse, f"name string, image_w long, image_h long, leaf_no int, {RECORD_SQL}")


class _Chunk(InputPartition):
    def __init__(self, path: str, version: int, first: int, start: int, end: int, n: int):
        self.path, self.version, self.first, self.start, self.end, self.n = path, version, first, start, end, n


class _ChunkReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Chunk]:
        import glob

        out = []
        for path in sorted(glob.glob(self.path)):
            with open(path, "rb") as f:
                head, ranges = split(f.read())
            first = 0
            for a, e, n in ranges:
                out.append(_Chunk(path, head["version"], first, a, e, n))
                first += n
        return out

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        for k, r in enumerate(parse_records(data, partition.n, partition.version)):
            yield (partition.path, partition.first + k, *astuple(r))


class ContainerSource(DataSource):
    """spark.read.format("blockfile").load(path): one task per chunk, for files that every node can open.

    For stores that only Spark reads, use read_containers(spark.read.format("binaryFile").load(path)).
    """

    @classmethod
    def name(cls) -> str:
        return "blockfile"

    def schema(self) -> str:
        return f"path string, leaf_no int, {RECORD_SQL}"

    def reader(self, schema: StructType) -> _ChunkReader:
        return _ChunkReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
