"""Residual grids: coarse corrections of a block, packed as small whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import clip01
from blockwright.operators.tiling import cell_of


def grid_size(h: Column, w: Column, grid: int) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(grid), F.greatest(F.lit(2), F.least(F.floor(h / 2), F.floor(w / 2))))).cast("int")


def with_cells(blocks: DataFrame, grid: int = 4) -> DataFrame:
    """Blocks (image_id, leaf, y, x, c, ...) with their cells cy, cx of a g x g split."""
    w = Window.partitionBy("image_id", "leaf")
    b = blocks.withColumns({"_y": F.min("y").over(w), "_x": F.min("x").over(w), "_h": F.max("y").over(w) - F.min("y").over(w) + 1, "_w": F.max("x").over(w) - F.min("x").over(w) + 1})
    b = b.withColumn("g", grid_size(F.col("_h"), F.col("_w"), grid))
    return b.withColumns({"cy": cell_of(F.col("y") - F.col("_y"), F.col("_h"), F.col("g")), "cx": cell_of(F.col("x") - F.col("_x"), F.col("_w"), F.col("g"))}).drop("_y", "_x", "_h", "_w")


def residual_levels(celled: DataFrame, truth: str, base: str, step: float = 0.02, most: int = 4) -> DataFrame:
    """(image_id, leaf, g, cy, cx, c, level) of cell means of truth - base; blocks of zeros alone have no rows."""
    mean = F.avg(F.col(truth).cast("double") - F.col(base).cast("double"))
    level = F.least(F.greatest(F.rint(mean / step), F.lit(float(-most))), F.lit(float(most))).cast("int")
    cells = celled.groupBy("image_id", "leaf", "g", "cy", "cx", "c").agg(level.alias("level"))
    some = F.max(F.abs("level")).over(Window.partitionBy("image_id", "leaf"))
    return cells.withColumn("_s", some).filter("_s > 0").drop("_s")


def residual_bytes(levels: DataFrame) -> DataFrame:
    """The packed form of each block: its grid size, then the levels in row order as signed bytes."""
    one = F.lpad(F.right(F.hex("level"), F.lit(2)), 2, "0")
    g = levels.groupBy("image_id", "leaf", "g").agg(F.sort_array(F.collect_list(F.struct("cy", "cx", "c", one.alias("b")))).alias("l"))
    return g.select("image_id", "leaf", F.unhex(F.concat(F.lpad(F.hex("g"), 2, "0"), F.array_join(F.transform("l", lambda s: s["b"]), ""))).alias("payload"))


def apply_residual(celled: DataFrame, levels: DataFrame, base: str, step: float = 0.02) -> DataFrame:
    """celled with `refined`: base plus its cell's correction, clipped; blocks without levels stay as they are."""
    own = levels.select("image_id", "leaf", "cy", "cx", "c", F.col("level").alias("correction"))
    joined = celled.join(own, ["image_id", "leaf", "cy", "cx", "c"], "left")
    some = F.max("correction").over(Window.partitionBy("image_id", "leaf")).isNotNull()
    plain = F.col(base).cast("double")
    return joined.withColumn("refined", F.when(some, clip01(plain + F.coalesce("correction", F.lit(0)) * step)).otherwise(plain))
