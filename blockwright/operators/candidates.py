"""Candidate bank, ranking and block policies in the long layout (image_id, leaf, y, x, c, v, coarse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import clip01
from blockwright.operators.features import NAMES

BANK = ("same", "blur", "sharpen", "contrast_up", "contrast_down", "edge_boost")


def _wrapped(axis: str, step: int, value: str) -> Column:
    """The neighbour `step` along an axis, with the block wrapping around."""
    others = ["x", "c"] if axis == "y" else ["y", "c"]
    part = Window.partitionBy("image_id", "leaf", *others)
    w = part.orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if step > 0:
        return F.coalesce(F.lag(value).over(w), F.last(value).over(whole))
    return F.coalesce(F.lead(value).over(w), F.first(value).over(whole))


def blur(value: str = "v") -> Column:
    """Mean of a pixel and its four wrapped neighbours."""
    total = F.col(value)
    for axis in ("y", "x"):
        for step in (1, -1):
            total = total + _wrapped(axis, step, value)
    return total / 5.0


def bank(blocks: DataFrame, value: str = "coarse") -> DataFrame:
    """Blocks with a double column for each kind of BANK, made from `value`."""
    v = F.col("_v")
    b = blocks.withColumn("_v", F.col(value).cast("double"))
    b = b.withColumns({"_b": blur("_v"), "_m": F.avg("_v").over(Window.partitionBy("image_id", "leaf", "c"))})
    edge, away = v - F.col("_b"), v - F.col("_m")
    kinds = {"same": v, "blur": F.col("_b"), "sharpen": clip01(v + 0.5 * edge), "contrast_up": clip01(away * 1.08 + F.col("_m")), "contrast_down": clip01(away * 0.92 + F.col("_m")), "edge_boost": clip01(v + 0.35 * edge)}
    return b.withColumns(kinds).drop("_v", "_b", "_m")


def candidate_scores(blocks: DataFrame, k: int = 5, value: str = "coarse", truth: str | None = None) -> DataFrame:
    """(image_id, leaf, bank_no, kind, score[, mse]) of the first k kinds: score is minus the error to `value`, mse that to `truth`.

    One aggregate has the sums of all kinds, and only its few rows are unpivoted.
    """
    b = bank(blocks, value)
    sums = []
    for n, kind in enumerate(BANK[: max(1, min(k, len(BANK)))]):
        d = F.col(kind) - F.col(value).cast("double")
        parts = [F.lit(n).alias("bank_no"), F.lit(kind).alias("kind"), (-F.avg(d * d)).alias("score")]
        if truth:
            e = clip01(F.col(kind)) - clip01(F.col(truth).cast("double"))
            parts.append(F.avg(e * e).alias("mse"))
        sums.append(F.struct(*parts))
    return b.groupBy("image_id", "leaf").agg(F.array(*sums).alias("k")).select("image_id", "leaf", F.inline("k"))


def ranked(scores: DataFrame) -> DataFrame:
    """With rank from 0: best score first, bank order among scores equal to 12 digits (the two contrasts are mirror images)."""
    w = Window.partitionBy("image_id", "leaf").orderBy(F.round("score", 12).desc(), "bank_no")
    return scores.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def best(scores: DataFrame) -> DataFrame:
    """The candidate of least error to the truth, the better ranked among equals."""
    r = ranked(scores)
    return r.groupBy("image_id", "leaf").agg(F.min_by(F.struct("bank_no", "kind", "rank", "mse"), F.struct(F.round("mse", 12), "rank")).alias("b")).select("image_id", "leaf", "b.*")


def margin_policy(scores: DataFrame, tau: float = 0.06, high: int = 8, low: int = 0) -> DataFrame:
    """H of each block: low if the best score leads by tau or there is no second."""
    two = ranked(scores).groupBy("image_id", "leaf").agg(F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("s0"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"))
    margin = F.col("s0") - F.col("s1")
    return two.select("image_id", "leaf", margin.alias("margin"), F.when(F.col("s1").isNull() | (margin >= tau), low).otherwise(high).alias("h_bits"))


def quantile_of(values: Column, q: float) -> Column:
    """Linear quantile of an array of numbers."""
    s = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.get(s, low) + (F.get(s, high) - F.get(s, low)) * (at - low)


def budget_policy(features: DataFrame, q_bounds: tuple[int, int] = (10, 20), k_bounds: tuple[int, int] = (3, 6)) -> DataFrame:
    """q and K from the complexity of a block's features: finer steps and more candidates for busier blocks."""
    a = F.array(*[F.abs(F.coalesce(F.nanvl(F.col(n), F.lit(0.0)), F.lit(0.0))) for n in NAMES])
    f = features.select("image_id", "leaf", a.alias("a"))
    p50, p90 = quantile_of(F.col("a"), 0.5), quantile_of(F.col("a"), 0.9)
    f = f.select("image_id", "leaf", clip01(1 - F.exp(-3 * (0.7 * p90 + 0.3 * p50))).alias("complexity"))
    between = lambda v, lo, hi: F.least(F.greatest(F.rint(v).cast("int"), F.lit(lo)), F.lit(hi))
    (q_lo, q_hi), (k_lo, k_hi) = q_bounds, k_bounds
    c = F.col("complexity")
    return f.select("image_id", "leaf", "complexity", between(q_hi - c * max(1, q_hi - q_lo), q_lo, q_hi).alias("q"), between(k_lo + c * (k_hi - k_lo), k_lo, k_hi).alias("k"))


def survivors(candidates: DataFrame) -> DataFrame:
    """Of candidates(image_id, leaf, rank, hp, target): the flag and place that lets a decoder pick the target among equal prefixes."""
    w = Window.partitionBy("image_id", "leaf")
    c = candidates.withColumn("t_hp", F.max(F.when(F.col("target"), F.col("hp"))).over(w)).filter(F.col("hp") == F.col("t_hp"))
    place = F.row_number().over(w.orderBy("rank")) - 1
    return c.withColumns({"n": F.count("*").over(w), "place": place}).filter("target").select("image_id", "leaf", (F.col("n") > 1).cast("int").alias("refine_flag"), F.when(F.col("n") > 1, F.col("place")).cast("int").alias("refine_idx"))


def decoder_choice(candidates: DataFrame) -> DataFrame:
    """The rank a decoder takes from candidates(image_id, leaf, rank, hp, h_bits, want_hp, refine_idx)."""
    alive = F.when((F.col("hp") == F.col("want_hp")) & (F.col("h_bits") > 0), F.col("rank"))
    g = candidates.groupBy("image_id", "leaf").agg(F.sort_array(F.collect_list(alive)).alias("s"), F.max("refine_idx").alias("i"))
    return g.select("image_id", "leaf", F.when(F.size("s") == 0, 0).when(F.size("s") == 1, F.col("s")[0]).otherwise(F.coalesce(F.get("s", F.col("i")), F.col("s")[0])).alias("rank"))
