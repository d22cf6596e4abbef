"""Image and table sources and sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the image files that are looked for.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def is_image(path: Column) -> Column:
    """Whether a path ends in one of the known extensions, in any case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files under a folder, or one file, with path, length and modificationTime, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    return files.filter(is_image(F.col("path"))).orderBy("path")


def load_images(spark: SparkSession, root: str) -> DataFrame:
    """images(path, w, h, px): RGB in 0..1, row by row, of files that the JVM can decode. Its bytes are blue first."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).select("image.*")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = []
            for h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "nChannels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(a, 3, 2) if n == 1 else a[..., 2::-1]
                px.append((rgb.astype(np.float32) / np.float32(255)).ravel())
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("width"), b.column("height"), pa.array(px, pa.list_(pa.float32()))], ["path", "w", "h", "px"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(unpack, "path string, w int, h int, px array<float>")


def image_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """The long layout (key, y, x, c, v)."""
    p = images.select(key, "w", F.posexplode("px").alias("n", "v"))
    return p.select(key, F.floor(F.col("n") / (3 * F.col("w"))).cast("int").alias("y"), (F.floor(F.col("n") / 3) % F.col("w")).cast("int").alias("x"), (F.col("n") % 3).cast("int").alias("c"), "v")


def png_bytes(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of values in 0..1: v * 255 + 0.5, cut and truncated."""
    a = np.clip(rgb * 255 + 0.5, 0, 255).astype(np.uint8)
    h, w, _ = a.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1).tobytes()

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def to_png(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): PNG files of images(key, w, h, px)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [png_bytes(np.array(px, np.float32).reshape(h, w, 3)) for w, h, px in zip(*(b.column(c).to_pylist() for c in ("w", "h", "px")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "content"])

    return images.select(key, "w", "h", "px").mapInArrow(pack, f"{key} {dict(images.dtypes)[key]}, content binary")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, columns in order, missing values empty; a column that isn't there is empty."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """CSV with columns tried as types: what can't be read is null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that the session's file system has."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """lines(file, file_no, line_no, line) of text logs, numbered in order; a log file is read as one value."""
    parts = None
    for n, p in enumerate(paths):
        whole = spark.read.text(p, wholetext=True).select(F.lit(n).alias("file_no"), F.element_at(F.split(F.lit(p), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
        one = whole.select("file", "file_no", F.col("line_no").cast("long").alias("line_no"), "line")
        parts = one if parts is None else parts.unionAll(one)
    return parts
