"""Image quality metrics over pairs of pixel relations, one image per Arrow group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockwright.functions import blockmath as M

OUT_SQL = "image_id int, mse double, psnr double, ssim double, ms_ssim double, gmsd double"


def cube(t: pa.Table, value: str) -> np.ndarray:
    """Rows y, x, c and a value as an H x W x C array."""
    y, x, c = (t[k].to_numpy() for k in ("y", "x", "c"))
    out = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1, c.max() + 1), np.float32)
    out[y - y.min(), x - x.min(), c] = t[value].to_numpy()
    return out


def quality(pairs: DataFrame, truth: str = "v", other: str = "coarse", on: str = "y") -> DataFrame:
    """MSE, PSNR, SSIM, MS-SSIM and GMSD of pairs(image_id, y, x, c, truth, other), per image."""

    def measure(t: pa.Table) -> pa.Table:
        a, b = cube(t, truth), cube(t, other)
        e = M.mse(a, b)
        values = [e, -10 * np.log10(max(e, 1e-12)), M.ssim(a, b, on), M.ms_ssim(a, b, on), M.gmsd(a, b, on)]
        return pa.table({"image_id": pa.array([t["image_id"][0].as_py()], pa.int32())} | {n: [float(v)] for n, v in zip(("mse", "psnr", "ssim", "ms_ssim", "gmsd"), values, strict=True)})

    return pairs.select("image_id", "y", "x", "c", truth, other).groupBy("image_id").applyInArrow(measure, OUT_SQL)
