"""Pixel operators on the long layout pixels(image_id, y, x, c, v FLOAT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions.scalars import clip01, psnr_unit

KEYS = ["image_id", "y", "x"]


def planes(pixels: DataFrame, names: str = "rgb") -> DataFrame:
    """One row per pixel with a column per channel."""
    return pixels.groupBy(*KEYS).agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).cast("double").alias(n) for k, n in enumerate(names)])


def to_ycc(r: Column, g: Column, b: Column) -> list[Column]:
    """BT.601 luma and offset chroma."""
    return [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 0.5, 0.5 * r - 0.418688 * g - 0.081312 * b + 0.5]


def to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    u, v = cb - 0.5, cr - 0.5
    return [y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u]


def ycc_planes(pixels: DataFrame) -> DataFrame:
    parts = to_ycc(F.col("r"), F.col("g"), F.col("b"))
    return planes(pixels).select(*KEYS, *[p.alias(n) for p, n in zip(parts, ("luma", "cb", "cr"), strict=True)])


def luma(pixels: DataFrame) -> DataFrame:
    """pixels(image_id, y, x, v) of unclipped luma."""
    return ycc_planes(pixels).select(*KEYS, F.col("luma").alias("v"))


def quantize(v: Column, step: int | Column) -> Column:
    """Half-to-even levels of v * 255 / step, in single precision as stored."""
    step = F.lit(step) if isinstance(step, int) else step
    scaled = (v.cast("float") * F.lit(255.0).cast("float")).cast("float")
    return F.rint((scaled.cast("double") / F.greatest(step, F.lit(1))).cast("float")).cast("smallint")


def dequantize(level: Column, step: int | Column) -> Column:
    return (level.cast("double") * step / 255.0).cast("float")


def coarse(pixels: DataFrame, step: int) -> DataFrame:
    """Pixels with `level` and their reconstruction `coarse`."""
    return pixels.withColumn("level", quantize(F.col("v"), step)).withColumn("coarse", dequantize(F.col("level"), step))


def error(a: Column, b: Column) -> Column:
    """Mean square error of two columns clipped to 0..1."""
    d = clip01(a.cast("double")) - clip01(b.cast("double"))
    return F.avg(d * d)


def psnr_by_image(pixels: DataFrame, step: int) -> DataFrame:
    """Mean square error and PSNR of quantisation, per image."""
    return coarse(pixels, step).groupBy("image_id").agg(error(F.col("coarse"), F.col("v")).alias("mse")).withColumn("psnr", psnr_unit(F.col("mse")))


def to_bytes(v: Column) -> Column:
    """8-bit values as an image file stores them: v * 255 + 0.5 in the precision of v, cut to 0..255 and truncated."""
    scaled = v * F.lit(255.0).cast("float") + F.lit(0.5).cast("float")
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int")


def downsample2(plane: DataFrame) -> DataFrame:
    """2 x 2 box means of (image_id, y, x, v); an odd last row or column is dropped, a side under 2 is left."""
    size = plane.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    p = plane.join(size, "image_id")
    small = (F.col("h") < 2) | (F.col("w") < 2)
    inside = (F.col("y") < F.floor(F.col("h") / 2) * 2) & (F.col("x") < F.floor(F.col("w") / 2) * 2)
    half = lambda c: F.when(small, F.col(c)).otherwise(F.floor(F.col(c) / 2)).cast("int").alias(c)
    return p.filter(small | inside).select("image_id", half("y"), half("x"), "v").groupBy(*KEYS).agg(F.avg("v").alias("v"))


#: Kind -> (new y, new x) of pixel (y, x) in an image of h rows and w columns.
AUGMENTATIONS = {
    "hflip": lambda y, x, h, w: (y, w - 1 - x),
    "vflip": lambda y, x, h, w: (h - 1 - y, x),
    "rot90": lambda y, x, h, w: (w - 1 - x, y),
    "rot180": lambda y, x, h, w: (h - 1 - y, w - 1 - x),
    "rot270": lambda y, x, h, w: (x, h - 1 - y),
}


def augment(pixels: DataFrame, per_image: int = len(AUGMENTATIONS)) -> DataFrame:
    """Each image under the first `per_image` kinds, in fixed order; one pass, no join of pixels."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    kinds = []
    for name, f in list(AUGMENTATIONS.items())[:per_image]:
        y, x = f(F.col("y"), F.col("x"), F.col("h"), F.col("w"))
        kinds.append(F.struct(F.lit(name).alias("kind"), y.cast("int").alias("y"), x.cast("int").alias("x")))
    return pixels.join(size, "image_id").select("image_id", "c", "v", F.explode(F.array(*kinds)).alias("k")).select("image_id", "k.kind", "k.y", "k.x", "c", "v")
