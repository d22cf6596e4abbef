"""Rate-distortion environment: block rewards, split costs and the search over the action grid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions import blockmath as M
from blockwright.operators.codec import _arrays

STEP_SQL = "image_id int, leaf_no int, q int, k int, h_bits int, split int, bpp double, mse double, psnr double, ssim double, msssim double, gmsd double, psnr_req double, mss_req double, reward double, score double"
STEP_NAMES = [c.split()[0] for c in STEP_SQL.split(", ")]


@dataclass(frozen=True)
class RewardConfig:
    alpha_bpp: float = 1.0
    alpha_psnr: float = 1.0
    alpha_msssim: float = 1.0
    min_psnr_db: float | None = None
    psnr_margin_db: float = 0.5
    #: The median PSNR asked for where there is no floor; without it a block asks for its own, so nothing is missing.
    psnr_median: float | None = None
    min_msssim: float | None = None
    msssim_floor: float = 0.95
    split_bit_cost: float = 1.0
    w_bpp: float = 1.0
    scale: float = 1.0
    with_gmsd: bool = False
    compress: bool = True
    version: int = 3


def block_step(px: np.ndarray, x: int, y: int, q: int, k: int, h: int, c: RewardConfig, seen: dict | None = None) -> dict:
    """One action's step; seen: what the block's other actions have found, as many share candidates."""
    seen = {} if seen is None else seen
    record, _, _ = M.encode_block(px, x, y, q, k, h, c.compress and c.version >= 3)
    if (q, k) not in seen:
        found, _ = M.propose(M.dequantize(M.quantize(px, q), q), k)
        errors = [M.mse(f, px) for f in found]
        seen[q, k] = found, errors
    found, errors = seen[q, k]
    best = int(np.argmin(errors))
    bpp = 8 * len(record.to_bytes(c.version)) / (px.shape[0] * px.shape[1])
    psnr = float(-10 * np.log10(max(errors[best], 1e-12)))
    chosen = found[best].tobytes()
    if chosen not in seen:
        a, b = np.clip(px, 0, 1), np.clip(found[best], 0, 1)
        if c.scale != 1.0:
            size = [max(1, round(n * c.scale)) for n in px.shape[:2]]
            a, b = M.area_resize(a, *size), M.area_resize(b, *size)
        # offset-chroma blocks are measured as if they were RGB, as the reward is defined
        seen[chosen] = M.ms_ssim(a, b), M.gmsd(a, b) if c.with_gmsd else 0.0
    ms, gm = seen[chosen]
    psnr_req = c.min_psnr_db if c.min_psnr_db is not None else (psnr if c.psnr_median is None else c.psnr_median) - c.psnr_margin_db
    mss_req = c.min_msssim if c.min_msssim is not None else c.msssim_floor
    loss = c.alpha_bpp * bpp + c.alpha_psnr * max(0.0, psnr_req - psnr) + c.alpha_msssim * max(0.0, mss_req - ms)
    return {"q": q, "k": k, "h_bits": h, "split": 0, "bpp": bpp, "mse": errors[best], "psnr": psnr, "ssim": 1.0, "msssim": ms, "gmsd": gm, "psnr_req": psnr_req, "mss_req": mss_req, "reward": -loss, "score": loss}


def split_reward(w: Column, h: Column, c: RewardConfig = RewardConfig()) -> Column:  # noqa: B008
    """The cost of splitting a block of w x h."""
    return -c.alpha_bpp * c.w_bpp * c.split_bit_cost / F.greatest(w * h, F.lit(1))


def split_steps(blocks: DataFrame, c: RewardConfig = RewardConfig()) -> DataFrame:  # noqa: B008
    """Split decisions as steps: no error, full similarity, nothing asked for."""
    reward = split_reward(F.col("w"), F.col("h"), c)
    fixed = {"q": 0, "k": 0, "h_bits": 0, "split": 1}
    one = {"mse": 0.0, "psnr": 120.0, "ssim": 1.0, "msssim": 1.0, "gmsd": 0.0}
    values = {n: F.lit(v) for n, v in (fixed | one).items()} | {"bpp": c.split_bit_cost / F.greatest(F.col("w") * F.col("h"), F.lit(1)), "psnr_req": F.lit(None).cast("double"), "mss_req": F.lit(None).cast("double"), "reward": reward, "score": -reward}
    return blocks.select("image_id", "leaf_no", *[values[n].alias(n) for n in STEP_NAMES[2:]])


def steps(blocks: DataFrame, actions: list[tuple[int, int, int]], c: RewardConfig = RewardConfig()) -> DataFrame:  # noqa: B008
    """Rewards of blocks under each action (q, k, h). Actions are a short stated list, tried where the block is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"image_id": row["image_id"], "leaf_no": row["leaf_no"]} | block_step(px, row["x"], row["y"], *a, c, seen) for row, px in _arrays(b) for seen in [{}] for a in actions]
            kinds = {"int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in (s.split() for s in STEP_SQL.split(", "))], STEP_NAMES)

    return blocks.select("image_id", "leaf_no", "x", "y", "w", "h", "px").mapInArrow(run, STEP_SQL)


def best_actions(all_steps: DataFrame) -> DataFrame:
    """The action of highest reward of each block; finer q, fewer candidates and bits among equals."""
    keep = F.struct("q", "k", "h_bits", "bpp", "psnr", "msssim", "reward")
    g = all_steps.groupBy("image_id", "leaf_no").agg(F.min_by(keep, F.struct("score", "q", "k", "h_bits")).alias("b"))
    return g.select("image_id", "leaf_no", "b.*")


def action_grid() -> list[tuple[int, int, int]]:
    return [(q, k, h) for q in M.Q_BINS for k in M.K_BINS for h in M.H_BINS]


def episodes(images: DataFrame, choose, max_block: int, min_block: int, c: RewardConfig = RewardConfig()) -> DataFrame:  # noqa: B008
    """Agent-controlled episodes over images(image_id, w, h, px): one environment per image.

    Tiles lie on a stack, the first on top. `choose(features, w, h)` gives (split, q, k, h); a split puts up to
    four parts of max(min_block, side // 2) on the stack, top left on top, and pays for its bit. An episode
    is sequential by nature, so an image is one task's; t is the turn.
    """
    from blockwright.operators.codec import block_features

    names = ["image_id", "t", "x", "y", "w", "h", *STEP_NAMES[2:]]
    schema = "image_id int, t int, x int, y int, w int, h int, " + STEP_SQL.split(", ", 2)[2]

    def play(t: pa.Table) -> pa.Table:
        image = t.to_pylist()[0]
        w, h = image["w"], image["h"]
        px = np.array(image["px"], np.float32).reshape(h, w, 3)
        cut = lambda x, y, a, b: (x, y, min(a, w - x), min(b, h - y))
        stack = [cut(x, y, max_block, max_block) for y in range(0, h, max_block) for x in range(0, w, max_block)][::-1]
        rows = []
        while stack:
            x, y, bw, bh = stack.pop()
            block = px[y : y + bh, x : x + bw]
            split, q, k, bits = choose(block_features(block[..., 0]), bw, bh)
            where = {"image_id": image["image_id"], "t": len(rows), "x": x, "y": y, "w": bw, "h": bh}
            if split and bw > min_block and bh > min_block:
                cw, ch = max(min_block, bw // 2), max(min_block, bh // 2)
                parts = [(i, j) for j in (0, ch) for i in (0, cw) if i < bw and j < bh]
                stack += [(x + i, y + j, bw - i if i else min(cw, bw), bh - j if j else min(ch, bh)) for i, j in parts][::-1]
                loss = c.alpha_bpp * c.w_bpp * c.split_bit_cost / max(1, bw * bh)
                rows.append(where | {"q": 0, "k": 0, "h_bits": 0, "split": 1, "bpp": c.split_bit_cost / max(1, bw * bh), "mse": 0.0, "psnr": 120.0, "ssim": 1.0, "msssim": 1.0, "gmsd": 0.0, "psnr_req": None, "mss_req": None, "reward": -loss, "score": loss})
            else:
                rows.append(where | block_step(block, x, y, q, k, bits, c))
        kinds = {"int": pa.int32(), "double": pa.float64()}
        return pa.Table.from_arrays([pa.array([r[n] for r in rows], kinds[s.split()[1]]) for n, s in zip(names, schema.split(", "), strict=True)], names)

    return images.select("image_id", "w", "h", "px").groupBy("image_id").applyInArrow(play, schema)
