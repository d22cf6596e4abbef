"""Encoding and decoding of blocks as rows: pixels to blocks, records, containers, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.functions import blockmath as M
from blockwright.sources.container import RECORD_NAMES, RECORD_SQL, assemble


@dataclass(frozen=True)
class CodecConfig:
    """policy: constant (q, k, h), fixed_margin (h by the lead of the best score) or budget (q and k by complexity)."""

    policy: str = "fixed_margin"
    q: int = 12
    k: int = 5
    h_high: int = 8
    h_low: int = 0
    margin: float = 0.06
    q_bounds: tuple[int, int] = (10, 20)
    k_bounds: tuple[int, int] = (3, 6)
    version: int = 3
    compression: str | bool | None = "zlib"
    level: int = 6
    chunk: int = 32

    def __post_init__(self) -> None:
        if self.policy not in ("constant", "fixed_margin", "budget"):
            raise ValueError(f"unknown policy {self.policy}")

    @property
    def compress(self) -> bool:
        """Versions before 3 store blocks as they are; an unknown name means none."""
        return self.version >= 3 and str(self.compression).lower() in ("zlib", "deflate", "1", "true")

    def bits(self) -> int | Callable[[list[float]], int]:
        if self.policy == "constant":
            return self.h_high
        return lambda scores: self.h_low if len(scores) < 2 or scores[0] - scores[1] >= self.margin else self.h_high


def to_blocks(pixels: DataFrame) -> DataFrame:
    """Blocks (image_id, leaf_no, x, y, w, h, px) of pixels (image_id, leaf, y, x, c, v): values in row, column, channel order.

    A block's pixels are few, so they are gathered by sorting small arrays, one exchange by block.
    """
    px = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "c", "v"))), lambda s: s["v"])
    g = pixels.groupBy("image_id", F.col("leaf").alias("leaf_no")).agg(F.min("x").cast("int").alias("x"), F.min("y").cast("int").alias("y"), (F.max("x") - F.min("x") + 1).cast("int").alias("w"), (F.max("y") - F.min("y") + 1).cast("int").alias("h"), px.alias("px"))
    return g


def to_pixels(blocks: DataFrame) -> DataFrame:
    p = blocks.select("image_id", "leaf_no", "x", "y", "w", F.posexplode("px").alias("n", "v"))
    return p.select("image_id", F.col("leaf_no").alias("leaf"), (F.col("y") + F.floor(F.col("n") / (3 * F.col("w")))).cast("int").alias("y"), (F.col("x") + F.floor(F.col("n") / 3) % F.col("w")).cast("int").alias("x"), (F.col("n") % 3).cast("int").alias("c"), "v")


def _arrays(b: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    for row in b.to_pylist():
        yield row, np.array(row["px"], np.float32).reshape(row["h"], row["w"], 3)


def block_features(y: np.ndarray) -> np.ndarray:
    """The 18 features of a luma block, as operators.features has them relationally."""
    y = np.clip(y.astype(np.float64), 0, 1)
    h, w = y.shape
    if min(h, w) < 2:
        size = np.zeros_like(y)
    else:
        size = np.hypot(*np.gradient(y))
    p = np.pad(y, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * y
    n = np.bincount(np.minimum((y * 255).astype(int), 255).ravel(), minlength=256)
    share = n[n > 0] / y.size
    quads = [q.size and float((q * q).mean()) for q in (y[: h // 2, : w // 2], y[: h // 2, w // 2 :], y[h // 2 :, : w // 2], y[h // 2 :, w // 2 :])]
    out = [y.mean(), y.var(), size.mean(), size.var(), lap.var(), -(share * np.log2(share)).sum(), *quads, 0, 0, 0, 1, 1, 0, 1, 0]
    return np.nan_to_num(np.array(out, np.float32), nan=0.0, posinf=0.0, neginf=0.0)


def budget_action(f: np.ndarray, q_bounds: tuple[int, int], k_bounds: tuple[int, int]) -> tuple[int, int]:
    a = np.abs(f)
    c = float(np.clip(1 - np.exp(-3 * (0.7 * np.percentile(a, 90) + 0.3 * np.percentile(a, 50))), 0, 1))
    (q0, q1), (k0, k1) = q_bounds, k_bounds
    return int(np.clip(round(q1 - c * max(1, q1 - q0)), q0, q1)), int(np.clip(round(k0 + c * (k1 - k0)), k0, k1))


def encode(blocks: DataFrame, config: CodecConfig = CodecConfig()) -> DataFrame:  # noqa: B008
    """Records of blocks of offset-chroma pixels, with their serialised bytes, error and bits per pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, px in _arrays(b):
                q, k = (config.q, config.k) if config.policy != "budget" else budget_action(block_features(px[..., 0]), config.q_bounds, config.k_bounds)
                r, chosen, _ = M.encode_block(px, row["x"], row["y"], q, k, config.bits(), config.compress, config.level)
                data = r.to_bytes(config.version)
                rows.append((row["image_id"], row["leaf_no"], *astuple(r), data, M.mse(chosen, px), 8 * len(data) / (row["w"] * row["h"])))
            kinds = [pa.int32(), pa.int32(), *[pa.binary() if n == "payload" else pa.int64() if n == "hp" else pa.int32() for n in RECORD_NAMES], pa.binary(), pa.float64(), pa.float64()]
            names = ["image_id", "leaf_no", *RECORD_NAMES, "record", "mse", "bpp"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return blocks.select("image_id", "leaf_no", "x", "y", "w", "h", "px").mapInArrow(run, f"image_id int, leaf_no int, {RECORD_SQL}, record binary, mse double, bpp double")


def containers(records: DataFrame, config: CodecConfig = CodecConfig(), block: int = 8) -> DataFrame:  # noqa: B008
    """(image_id, content): the container file of each image's records in leaf order. A file is one value by nature."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("leaf_no")
        w, h = (max(a + b for a, b in zip(t[p].to_pylist(), t[s].to_pylist(), strict=True)) for p, s in (("x", "w"), ("y", "h")))
        data = assemble(t["record"].to_pylist(), config.version, w, h, block, config.chunk)
        return pa.table({"image_id": pa.array([t["image_id"][0].as_py()], pa.int32()), "content": pa.array([data], pa.binary())})

    return records.select("image_id", "leaf_no", "x", "y", "w", "h", "record").groupBy("image_id").applyInArrow(build, "image_id int, content binary")


def decode(records: DataFrame, *keys: str) -> DataFrame:
    """Blocks of records: keys, leaf_no, x, y, w, h and px of the decoder's choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = [M.decode_block(M.Record(*[row[n] for n in RECORD_NAMES])).ravel() for row in b.to_pylist()]
            names = [*keys, "leaf_no", "x", "y", "w", "h"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array([p.tolist() for p in px], pa.list_(pa.float32()))], [*names, "px"])

    kinds = dict(records.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in (*keys, "leaf_no", "x", "y", "w", "h")) + ", px array<float>"
    return records.select(*keys, "leaf_no", *RECORD_NAMES).mapInArrow(run, schema)
