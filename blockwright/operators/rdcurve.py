"""Rate-distortion curves: interpolation by key, summaries, sweeps, axes and plot feeds."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import finite, rate_axis
from blockwright.session import checkpointed

KEY_NAMES = ["image", "img", "file", "filename", "name", "path", "id"]
RATE_NAMES = ["bpp", "jpeg_bpp", "bits_per_pixel"]
PSNR_NAMES = ["psnr", "jpeg_psnr"]


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """An exact name, else one equal but for case, both in candidate order; else the first column that contains a candidate."""
    low = {}
    for c in columns:
        low.setdefault(c.lower(), c)
    exact = next((c for c in candidates if c in columns), None)
    alike = next((low[c.lower()] for c in candidates if c.lower() in low), None)
    return exact or alike or next((c for c in columns if any(k in c.lower() for k in candidates)), None)


def interpolate(points: DataFrame, x: str, y: str, at: float, key: str | None = None, name: str = "value") -> DataFrame:
    """y at x = `at` on each key's piecewise linear curve; null outside its range or with under two points.

    The two knots around `at` come from one aggregate, so no curve is collected. Rows without a key are left out.
    """
    p = points.select(*([key] if key else []), finite(F.col(x).cast("double")).alias("_x"), finite(F.col(y).cast("double")).alias("_y")).dropna(subset=["_x", "_y"])
    if key:
        p = p.filter(F.col(key).isNotNull())
    knot = F.struct("_x", "_y")
    below, above = F.col("_x") <= at, F.col("_x") >= at
    agg = [F.count("*").alias("_n"), F.max(F.when(below, knot)).alias("_lo"), F.min(F.when(above, knot)).alias("_hi")]
    g = p.groupBy(key).agg(*agg) if key else p.agg(*agg)
    lo, hi = F.col("_lo"), F.col("_hi")
    line = lo["_y"] + (hi["_y"] - lo["_y"]) * (F.lit(at) - lo["_x"]) / (hi["_x"] - lo["_x"])
    value = F.when((F.col("_n") < 2) | lo.isNull() | hi.isNull(), None).when(hi["_x"] == lo["_x"], lo["_y"]).otherwise(line)
    return g.select(*([key] if key else []), value.alias(name))


def summarize(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """Median, population deviation and count of what isn't null."""
    return values.agg(F.median(column).alias(f"{prefix}_median"), F.stddev_pop(column).alias(f"{prefix}_std"), F.count(column).alias(f"{prefix}_n"))


def median_summary(df: DataFrame, source: str = "", target_bpp: float = 0.4, target_psnr: float = 34.48) -> DataFrame:
    """One row: PSNR at a rate and rate at a PSNR over all images, of a table whose columns are found by name."""
    key, rate, psnr = (pick_column(df.columns, n) for n in (KEY_NAMES, RATE_NAMES, PSNR_NAMES))
    if rate is None or psnr is None:
        raise KeyError(f"no rate or PSNR column in {df.columns}")
    parts = []
    for x, y, at, prefix in ((rate, psnr, target_bpp, f"psnr@{target_bpp}"), (psnr, rate, target_psnr, f"bpp@{int(target_psnr)}db")):
        parts.append(summarize(interpolate(df, x, y, at, key), "value", prefix))
    names = [F.lit(v).cast("string").alias(n) for n, v in (("source", source), ("key_col", key), ("bpp_col", rate), ("psnr_col", psnr))]
    return parts[0].crossJoin(parts[1]).select(*names, "*")  # one row each


def five_number_table(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """min, quartiles and max (linear interpolation, zeros where there is no value) of columns by key, as arrays.

    Exact at any size: values are counted, dealt out in ranges of (key, column, value), and those at the wanted
    places are picked by running counts, so no task holds the values of a key. NaN is the greatest value.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_v")) for n, c in columns.items()])).alias("_e")
    by = [*keys, "_name"]
    counts = df.select(*keys, each).select(*keys, "_e.*").groupBy(*by, "_v").agg(F.count("_v").alias("_n"))
    ranged = checkpointed(counts.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_s"))
    key = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum("_s").over(key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_p"]], ahead.alias("_ahead"), F.sum("_s").over(key).alias("_total"))
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_p"]])
    upto = F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("_upto", upto).join(sums, same).withColumn("_end", F.col("_ahead") + F.col("_upto"))
    places = [(F.col("_total") - 1) * q for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
    at = lambda place: F.max(F.when((F.col("_end") > place) & (F.col("_end") - F.col("_n") <= place), F.col("_v")))
    picked = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *[at(f(p)).alias(f"_{side}{i}") for i, p in enumerate(places) for side, f in (("low", F.floor), ("high", F.ceil))])
    value = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_low{i}")).otherwise((F.ceil(p) - p) * F.col(f"_low{i}") + (p - F.floor(p)) * F.col(f"_high{i}"))
    five = F.array(*[F.coalesce(value(i, p), F.lit(0.0)) for i, p in enumerate(places)])
    five = picked.select(*by, five.alias("_five"))
    return five.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_five"))).alias(n) for n in columns])


def quality_sweep(points: DataFrame, quality: str, bpp: str, psnr: str) -> DataFrame:
    """Five-number summaries of rate and PSNR at each quality."""
    g = five_number_table(points, [quality], {"_b": F.col(bpp), "_p": F.col(psnr)})
    return g.select(quality, *[F.col(c)[i].alias(f"{n}_{q}") for c, n in (("_b", "bpp"), ("_p", "psnr")) for i, q in enumerate(("min", "q1", "med", "q3", "max"))])


def seeded_sample(files: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, the same for the same seed."""
    return files.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(k)


def axis_limits(values: DataFrame, series: list[str], value: str, pad: float = 0.05) -> DataFrame:
    """Padded finite range of each series; an empty range gets 1e-6."""
    low, high = F.min(finite(F.col(value))), F.max(finite(F.col(value)))
    g = values.groupBy(*series).agg(low.alias("_l"), high.alias("_h"))
    top = F.when(F.col("_h") <= F.col("_l"), F.col("_l") + 1e-6).otherwise(F.col("_h"))
    return g.select(*series, (F.col("_l") - pad * (top - F.col("_l"))).alias("low"), (top + pad * (top - F.col("_l"))).alias("high"))


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))


def normalised(points: DataFrame, column: str, name: str = "norm") -> DataFrame:
    """Min-max normalised column: the range is one aggregated row, joined to all, so rows aren't gathered in one window."""
    limits = points.agg(F.min(column).alias("_l"), F.max(column).alias("_h"))
    return points.crossJoin(F.broadcast(limits)).withColumn(name, min_max(F.col(column), F.col("_l"), F.col("_h"))).drop("_l", "_h")


def plot_feed(batches: DataFrame, epoch: int | None = None, phases: list[str] | None = None, log2: bool = False) -> DataFrame:
    """The frame behind a plot: batches of an epoch and phases with their rate axis and epoch:batch label."""
    b = batches
    if epoch is not None:
        b = b.filter(F.col("epoch") == epoch)
    if phases:
        b = b.filter(F.lower(F.trim("phase")).isin(phases))
    return b.select("epoch", "phase", "batch", F.concat_ws(":", "epoch", "batch").alias("label"), rate_axis(F.col("bpp_med"), log2).alias("rate"), "psnr_med")


def overlay_norm(points: DataFrame, series: list[str], column: str) -> DataFrame:
    """Min-max normalised within each series, for overlays."""
    w = Window.partitionBy(*series)
    return points.withColumn("norm", min_max(F.col(column), F.min(column).over(w), F.max(column).over(w)))
