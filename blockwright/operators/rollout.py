"""Roll-out statistics: advantages, normalisation, early stopping, batch rewards, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.session import checkpointed


#: A block holds 2**BLOCK_BITS time steps of one environment.
BLOCK_BITS = 12
_SCANNED = "run long, block long, env_id int, t long, val double, a double, c double, head boolean"


def gae(rollout: DataFrame, gamma: float = 0.99, lam: float = 0.95, order: str = "env") -> DataFrame:
    """Advantages of rollout(env_id, t, rew, val, done): a scan over each environment's steps, from the last.

    order='interleaved' runs over all environments' steps as one sequence by (t, env_id), as a flat buffer does.
    An advantage is linear in what follows its block (value and advantage of the next step), so blocks of 4096
    steps (interleaved: ranges) are scanned side by side, one row of each is chained, and a join adds the rest.
    """
    live = F.when(F.col("done"), 0.0).otherwise(1.0)
    steps = rollout.select(F.col("env_id").cast("int").alias("env_id"), F.col("t").cast("long").alias("t"), F.col("rew").cast("double").alias("rew"), F.col("val").cast("double").alias("val"), live.alias("live"))
    if order == "env":
        steps = steps.withColumns({"run": F.col("env_id").cast("long"), "block": F.shiftright("t", BLOCK_BITS)})
    else:
        steps = checkpointed(steps.repartitionByRange("t", "env_id").withColumns({"run": F.lit(0).cast("long"), "block": F.spark_partition_id().cast("long")}))
    scanned = checkpointed(steps.groupBy("run", "block").applyInArrow(_scan(gamma, lam), _SCANNED))
    after = scanned.filter("head").select("run", "block", "val", "a", "c").groupBy("run").applyInArrow(_chain(lam), "run long, block long, x double")
    x = F.coalesce("x", F.lit(0.0))
    advantage = F.col("a") + F.col("c") * x
    after = after.select(F.col("run").alias("_run"), F.col("block").alias("_block"), "x")
    return scanned.join(after, F.col("run").eqNullSafe(F.col("_run")) & F.col("block").eqNullSafe(F.col("_block")), "left").select("env_id", "t", advantage.alias("advantage"), (advantage + F.col("val")).alias("ret"))


def _scan(gamma: float, lam: float):
    """Of one block: advantages (a) as if nothing followed, and the factor (c) of value + lam * advantage of the step after it.

    The recurrence a[i] = d[i] + k[i] * a[i + 1] is solved by doubling: log2(n) passes over arrays.
    """

    def scan(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.take(pc.sort_indices(t, [("t", "ascending"), ("env_id", "ascending")]))
        rew, val, live = (t[c].to_numpy() for c in ("rew", "val", "live"))
        a, c = rew + gamma * live * np.append(val[1:], 0.0) - val, gamma * lam * live
        c[-1] = gamma * live[-1]
        width = 1
        while width < len(a):
            a[:-width] = a[:-width] + c[:-width] * a[width:]
            c[:-width] = c[:-width] * c[width:]
            width *= 2
        head = np.arange(len(a)) == 0
        return pa.table([t["run"], t["block"], t["env_id"], t["t"], t["val"], pa.array(a), pa.array(c), pa.array(head)], ["run", "block", "env_id", "t", "val", "a", "c", "head"])

    return scan


def _chain(lam: float):
    """Of the first rows of a run's blocks: what follows each block, value + lam * advantage of the next step."""

    def chain(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.take(pc.sort_indices(t, [("block", "descending")]))
        x, out = 0.0, []
        for val, a, c in zip(*(t[n].to_pylist() for n in ("val", "a", "c")), strict=True):
            out.append(x)
            x = val + lam * (a + c * x)
        return pa.table([t["run"], t["block"], pa.array(out, pa.float64())], ["run", "block", "x"])

    return chain


def normalised_advantage(df: DataFrame, column: str, name: str = "norm") -> DataFrame:
    """(x - mean) / (sample deviation + 1e-8) over all rows: one aggregated row, joined to all."""
    m = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return df.crossJoin(F.broadcast(m)).withColumn(name, (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")


def early_stop(epochs: DataFrame, run: str, patience: int, min_delta_bpp: float = 0.0, min_delta_db: float = 0.0, start_after: int = 0, enabled: bool = True) -> DataFrame:
    """The stopper's state after each epoch of epochs(run, epoch, bpp, db): a fold, as bests move only by enough.

    A null or NaN improves nothing. A run is one task's, as its fold is sequential.
    """

    def fold(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("epoch", "bpp", "db")], null_placement="at_start"))
        best_bpp, best_db, wait, out = float("inf"), float("-inf"), 0, []
        for epoch, bpp, db in zip(*(t[c].to_pylist() for c in ("epoch", "bpp", "db")), strict=True):
            warm = not enabled or (epoch is not None and epoch < start_after)
            rate = bpp is not None and (bpp < best_bpp if warm else best_bpp - bpp >= min_delta_bpp)
            more = db is not None and (db > best_db if warm else db - best_db >= min_delta_db)
            best_bpp, best_db = bpp if rate else best_bpp, db if more else best_db
            wait = 0 if warm or rate or more else wait + 1
            out.append((best_bpp, best_db, wait, not warm and wait >= patience))
        kinds = (pa.float64(), pa.float64(), pa.int32(), pa.bool_())
        return pa.table([t[run], t["epoch"], *(pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))], [run, "epoch", "best_bpp", "best_db", "wait", "stop"])

    rows = epochs.select(run, F.col("epoch").cast("int").alias("epoch"), F.col("bpp").cast("double").alias("bpp"), F.col("db").cast("double").alias("db"))
    return rows.groupBy(run).applyInArrow(fold, f"`{run}` {rows.schema[run].dataType.simpleString()}, epoch int, best_bpp double, best_db double, wait int, stop boolean")


def batch_reward(steps: DataFrame, keys: list[str], alpha_bpp: float = 1.0, alpha_psnr: float = 1.0, alpha_msssim: float = 1.0, min_psnr_db: float | None = None, psnr_margin_db: float = 0.5, mss_required: float = 0.0) -> DataFrame:
    """A batch's reward from the means of its steps; without a floor the PSNR asked for is the batch's median less a margin."""
    need = F.lit(min_psnr_db) if min_psnr_db is not None else F.median("psnr") - psnr_margin_db
    short = F.greatest(F.lit(0.0), F.coalesce(need - F.avg("psnr"), F.lit(0.0)))
    loss = alpha_bpp * F.avg("bpp") + alpha_psnr * short + alpha_msssim * F.greatest(F.lit(0.0), mss_required - F.avg("msssim"))
    return steps.groupBy(*keys).agg((-loss).alias("reward"))


def soft_weights(x: Column, low: Column, mid: Column, high: Column, eps: float = 1e-6) -> list[Column]:
    """Triangular memberships (low, mid, high) of x about the median, adding up to 1; (0, 1, 0) where all vanish."""
    left, right = F.greatest(mid - low, F.lit(eps)), F.greatest(high - mid, F.lit(eps))
    under = x <= mid
    parts = [F.when(under, F.greatest(F.lit(0.0), (mid - x) / left)).otherwise(0.0), F.when(under, F.greatest(F.lit(0.0), 1 - (mid - x) / left)).otherwise(F.greatest(F.lit(0.0), 1 - (x - mid) / right)), F.when(under, 0.0).otherwise(F.greatest(F.lit(0.0), (x - mid) / right))]
    total = parts[0] + parts[1] + parts[2]
    return [F.when(total <= eps, default).otherwise(p / total) for p, default in zip(parts, (0.0, 1.0, 0.0), strict=True)]


def soft_weight(x: Column, low: Column, mid: Column, high: Column, w_low: float, w_mid: float, w_high: float, invert: bool = False, eps: float = 1e-6) -> Column:
    """The three weights mixed by the memberships of x; invert: the outer memberships change places."""
    a, b, c = soft_weights(x, low, mid, high, eps)
    return (c if invert else a) * w_low + b * w_mid + (a if invert else c) * w_high


def batches(items: DataFrame, order: str, n_bytes: str, per_batch: int) -> DataFrame:
    """Items in order with the batch that a fixed count puts them in and their running size.

    Order over all items is taken in ranges: range sums first, then windows within a range, so no task holds all items.
    """
    ranged = checkpointed(items.select(order, n_bytes).repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(n_bytes).alias("_b"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy(order)
    placed = ranged.join(F.broadcast(base), "_p")
    number = F.row_number().over(w) - 1 + F.col("_n")
    return placed.select(order, F.floor(number / per_batch).cast("int").alias("batch_no"), (F.sum(n_bytes).over(w) + F.col("_b")).cast("long").alias("running_bytes"))
