"""The 18 block features, as windows and aggregates over a luma plane (image_id, leaf, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import clip01

BLOCK = ["image_id", "leaf"]
NAMES = ["mean", "var", "grad_mean", "grad_var", "lap_var", "entropy", "e_ll", "e_lh", "e_hl", "e_hh", "q_left", "q_top", "berr", "n", "s1", "s1_s2", "p_margin", "topk_var"]
#: Neighbour and preview features are constants: nothing passes them a value.
CONSTANT = {"q_left": 0.0, "q_top": 0.0, "berr": 0.0, "n": 1.0, "s1": 1.0, "s1_s2": 0.0, "p_margin": 1.0, "topk_var": 0.0}


def clipped(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("v", clip01(F.col("v")))


def moments(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*BLOCK).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def entropy(blocks: DataFrame) -> DataFrame:
    """Bits of the 256-bin histogram of truncated 8-bit values."""
    bins = blocks.groupBy(*BLOCK, F.least(F.floor(F.col("v") * 255), F.lit(255)).alias("bin")).agg(F.count("*").alias("n"))
    total, logs = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    return bins.groupBy(*BLOCK).agg((F.log2(total) - logs / total).alias("entropy"))


def _along(axis: str) -> tuple[Column, Column, Column, Column]:
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy(*BLOCK, other).orderBy(axis)
    return F.lag("v").over(w), F.lead("v").over(w), F.lag("v").over(w).isNull(), F.lead("v").over(w).isNull()


def slope(axis: str) -> Column:
    """Central differences inside, one-sided at the edges; null in a block one pixel wide."""
    before, after, first, last = _along(axis)
    v = F.col("v")
    return F.when(first & last, None).when(first, after - v).when(last, v - before).otherwise((after - before) / 2)


def gradient(blocks: DataFrame) -> DataFrame:
    """Mean and variance of the gradient magnitude; 0 for a block with a side under 2."""
    g = blocks.withColumns({"gx": slope("x"), "gy": slope("y")})
    size = F.coalesce(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.lit(0.0))
    return g.groupBy(*BLOCK).agg(F.avg(size).alias("grad_mean"), F.var_pop(size).alias("grad_var"))


def laplacian(blocks: DataFrame) -> DataFrame:
    """Variance of the four-neighbour Laplacian with replicated edges."""
    total = -4 * F.col("v")
    for axis in "xy":
        before, after, _, _ = _along(axis)
        total = total + F.coalesce(before, "v") + F.coalesce(after, "v")
    return blocks.withColumn("l", total).groupBy(*BLOCK).agg(F.var_pop("l").alias("lap_var"))


def quadrants(blocks: DataFrame) -> DataFrame:
    """Mean squares of the four spatial quadrants; 0 for an empty one."""
    corner = Window.partitionBy(*BLOCK)
    low_y, low_x = F.min("y").over(corner), F.min("x").over(corner)
    h, w = F.max("y").over(corner) - low_y + 1, F.max("x").over(corner) - low_x + 1
    b = blocks.withColumns({"below": F.col("y") - low_y >= F.floor(h / 2), "right": F.col("x") - low_x >= F.floor(w / 2)})
    square = F.col("v") * F.col("v")
    mean = lambda below, right: F.coalesce(F.avg(F.when((F.col("below") == below) & (F.col("right") == right), square)), F.lit(0.0))
    return b.groupBy(*BLOCK).agg(mean(False, False).alias("e_ll"), mean(False, True).alias("e_lh"), mean(True, False).alias("e_hl"), mean(True, True).alias("e_hh"))


def feature_table(blocks: DataFrame) -> DataFrame:
    """All 18 features by name; what isn't finite is 0. One pass of windows, one aggregate, and the histogram.

    Every window and aggregate is clustered by a subset of (image_id, leaf), so the plane is dealt out
    once by block and stays there.
    """
    b = clipped(blocks).repartition(*BLOCK)
    corner = Window.partitionBy(*BLOCK)
    total = -4 * F.col("v")
    for axis in "xy":
        before, after, _, _ = _along(axis)
        total = total + F.coalesce(before, "v") + F.coalesce(after, "v")
    low_y, low_x = F.min("y").over(corner), F.min("x").over(corner)
    h, w = F.max("y").over(corner) - low_y + 1, F.max("x").over(corner) - low_x + 1
    d = b.withColumns({"gx": slope("x"), "gy": slope("y"), "l": total, "below": F.col("y") - low_y >= F.floor(h / 2), "right": F.col("x") - low_x >= F.floor(w / 2)})
    size, square = F.coalesce(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.lit(0.0)), F.col("v") * F.col("v")
    quadrant = {n: F.avg(F.when((F.col("below") == bl) & (F.col("right") == r), square)) for n, bl, r in (("e_ll", False, False), ("e_lh", False, True), ("e_hl", True, False), ("e_hh", True, True))}
    found = {"mean": F.avg("v"), "var": F.var_pop("v"), "grad_mean": F.avg(size), "grad_var": F.var_pop(size), "lap_var": F.var_pop("l")} | quadrant
    stats = d.groupBy(*BLOCK).agg(*[c.alias(n) for n, c in found.items()]).join(entropy(b), BLOCK)
    value = lambda n: F.lit(CONSTANT[n]) if n in CONSTANT else F.coalesce(F.nanvl(F.col(n), F.lit(0.0)), F.lit(0.0))
    return stats.select(*BLOCK, *[value(n).alias(n) for n in NAMES])


def as_vector(table: DataFrame, size: int | None = None) -> DataFrame:
    """The features as one array, cut or padded with zeros to `size`."""
    v = F.array(*NAMES)
    if size is not None:
        v = F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)
    return table.select(*BLOCK, v.alias("f"))
