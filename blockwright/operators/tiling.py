"""Fixed grids, adaptive quadtrees and chunks of leaves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECT = ["bx", "by", "bw", "bh"]


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))


def fixed_leaves(sizes: DataFrame, block: int) -> DataFrame:
    """Row-major grid leaves with ragged edges."""
    rows = sizes.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(block))).alias("y"))
    cells = rows.select("image_id", "w", "h", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1, F.lit(block))).alias("x"))
    across = F.ceil(F.col("w") / block)
    return cells.select("image_id", (F.floor(F.col("y") / block) * across + F.floor(F.col("x") / block)).cast("int").alias("leaf_no"), "x", "y", F.least(F.lit(block), F.col("w") - F.col("x")).alias("w"), F.least(F.lit(block), F.col("h") - F.col("y")).alias("h"))


def leaf_of(y: Column, x: Column, block: int, width: int | Column) -> Column:
    """The grid leaf of a pixel, by arithmetic instead of a join."""
    across = F.ceil((F.lit(width) if isinstance(width, int) else width) / block)
    return (F.floor(y / block) * across + F.floor(x / block)).cast("int")


def size_histogram(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("w", "h").agg(F.count("*").alias("n")).select(F.concat_ws("x", "w", "h").alias("size"), "n")


def chunk_size(n_leaves: int, workers: int, chunk: int | None = None) -> int:
    """A quarter of a worker's share between 32 and 2048, or a given size of at most half a share."""
    if chunk:
        return max(1, min(chunk, max(1, n_leaves // (2 * workers))))
    return min(2048, max(32, math.ceil(n_leaves / (4 * workers))))


def chunks(leaves: DataFrame, size: int) -> DataFrame:
    return leaves.groupBy("image_id", F.floor(F.col("leaf_no") / size).cast("int").alias("chunk_no")).agg(F.min("leaf_no").alias("first_leaf"), F.count("*").cast("int").alias("cnt"))


def chunk_offsets(records: DataFrame, size: int, start: int = 0) -> DataFrame:
    """(image_id, chunk_no, start, end, cnt) of records(image_id, leaf_no, n_bytes): running byte places."""
    each = records.groupBy("image_id", F.floor(F.col("leaf_no") / size).cast("int").alias("chunk_no")).agg(F.sum("n_bytes").alias("n"), F.count("*").cast("int").alias("cnt"))
    end = F.sum("n").over(Window.partitionBy("image_id").orderBy("chunk_no")) + start
    return each.select("image_id", "chunk_no", (end - F.col("n")).alias("start"), end.alias("end"), "cnt")


def cell_of(at: Column, n: Column, g: Column) -> Column:
    """The cell of place `at` when n places are split into g cells, the first n % g of them one larger."""
    base, extra = F.floor(n / g), n % g
    large = extra * (base + 1)
    return F.when(at < large, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - large) / F.greatest(base, F.lit(1)))).cast("int")


def with_steps(plane: DataFrame) -> DataFrame:
    """A plane (image_id, y, x, v) with |step| to the right and down."""
    right = F.lead("v").over(Window.partitionBy("image_id", "y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy("image_id", "x").orderBy("y"))
    return plane.withColumn("dx", F.abs(right - F.col("v"))).withColumn("dy", F.abs(down - F.col("v")))


def node_activity(stepped: DataFrame) -> list[Column]:
    """Variance and mean absolute gradient over a node bx, by, bw, bh of its pixels."""
    inside = (F.col("x") < F.col("bx") + F.col("bw") - 1) & (F.col("y") < F.col("by") + F.col("bh") - 1)
    return [F.var_pop("v").alias("var"), F.coalesce(F.avg(F.when(inside, F.col("dx") + F.col("dy"))), F.lit(0.0)).alias("grad")]


def quadtree(plane: DataFrame, min_block: int, max_block: int, var_threshold: float = 0.0025, grad_threshold: float = 0.020) -> DataFrame:
    """Adaptive leaves (image_id, leaf_no, x, y, w, h), in depth-first order of row-major tiles.

    Every pixel carries the rectangle of its node; a level computes the activity of all nodes by one
    aggregate over pixels and then narrows rectangles by arithmetic. The plane is dealt out once by
    image and tile; all levels group within that, so the number of levels adds no shuffle of pixels.
    """
    sizes = image_sizes(plane)
    base = with_steps(plane).join(sizes, "image_id")
    tile = lambda c: F.floor(F.col(c) / max_block) * max_block
    p = base.select("image_id", "y", "x", "v", "dx", "dy", tile("x").cast("int").alias("tx"), tile("y").cast("int").alias("ty"), "w", "h")
    p = p.repartition("image_id", "ty", "tx").withColumns({"bx": F.col("tx"), "by": F.col("ty"), "bw": F.least(F.lit(max_block), F.col("w") - F.col("tx")), "bh": F.least(F.lit(max_block), F.col("h") - F.col("ty")), "path": F.lit("")}).drop("w", "h")
    # a side is halved at most so often before it is under 2 * min_block
    for _ in range(max(1, math.ceil(math.log2(max(2, max_block / min_block)))) + 1):
        node = Window.partitionBy("image_id", "ty", "tx", "by", "bx")
        inside = (F.col("x") < F.col("bx") + F.col("bw") - 1) & (F.col("y") < F.col("by") + F.col("bh") - 1)
        p = p.withColumns({"var": F.var_pop("v").over(node), "grad": F.coalesce(F.avg(F.when(inside, F.col("dx") + F.col("dy"))).over(node), F.lit(0.0))})
        w, h = F.col("bw"), F.col("bh")
        leaf = (w <= min_block) & (h <= min_block)
        wide = ~leaf & (w >= 2 * min_block) & (h < 2 * min_block)
        tall = ~leaf & (h >= 2 * min_block) & (w < 2 * min_block)
        four = ~leaf & ~wide & ~tall & (w > min_block) & (h > min_block) & ((F.col("var") >= var_threshold) | (F.col("grad") >= grad_threshold))
        in_x, in_y = wide | four, tall | four
        w2, h2 = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
        right, below = F.col("x") >= F.col("bx") + w2, F.col("y") >= F.col("by") + h2
        p = p.withColumns(
            {
                "bx": F.when(in_x & right, F.col("bx") + w2).otherwise(F.col("bx")),
                "by": F.when(in_y & below, F.col("by") + h2).otherwise(F.col("by")),
                "bw": F.when(in_x, F.when(right, w - w2).otherwise(w2)).otherwise(w),
                "bh": F.when(in_y, F.when(below, h - h2).otherwise(h2)).otherwise(h),
                "path": F.concat("path", F.when(in_x | in_y, (F.when(in_y & below, 2).otherwise(0) + F.when(in_x & right, 1).otherwise(0)).cast("string")).otherwise("")),
            }
        )
    leaves = p.groupBy("image_id", "ty", "tx", "path", *RECT).agg(F.count("*").alias("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("ty", "tx", "path")) - 1
    return leaves.select("image_id", number.cast("int").alias("leaf_no"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"))


def split_activity(plane: DataFrame, block: int, var_threshold: float, grad_threshold: float, min_block: int) -> DataFrame:
    """Variance, gradient and the split decision of each block of a fixed grid."""
    cut = lambda c: (F.floor(F.col(c) / block) * block).cast("int")
    p = with_steps(plane).join(image_sizes(plane), "image_id").withColumns({"bx": cut("x"), "by": cut("y")})
    p = p.withColumns({"bw": F.least(F.lit(block), F.col("w") - F.col("bx")), "bh": F.least(F.lit(block), F.col("h") - F.col("by"))})
    out = p.groupBy("image_id", *RECT).agg(*node_activity(p))
    split = (F.col("bw") > min_block) & (F.col("bh") > min_block) & ((F.col("var") >= var_threshold) | (F.col("grad") >= grad_threshold))
    return out.withColumn("split", split)
