"""Batching, shuffling and assignment of items to environments."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwright.session import checkpointed


def shuffled(items: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation that depends on the keys and the seed alone."""
    return items.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def _next_cuts(sums: np.ndarray, budget: int) -> np.ndarray:
    """For a batch that starts at each item the item that starts the next one; sums: running sizes from 0."""
    first = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    # an item beyond the budget still joins a batch that holds nothing
    first += sums[np.minimum(first, len(sums) - 1)] <= sums[:-1]
    return np.minimum(first, len(sums) - 1)


def _range_steps(t: pa.Table, budget: int) -> pa.Table:
    """What a range makes of the bytes held before it: steps (at, over, cuts, held after it, total) in order.

    Step -1 holds where nothing is held before; else the first step with `over` below what is held, and
    if there is none the range makes no cut. Sizes are no less than 0.
    """
    sums = np.concatenate([[0], np.cumsum(t["size"].to_numpy())])
    n, after = len(sums) - 1, _next_cuts(sums, budget)
    cuts, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(n - 1, -1, -1):
        m = after[j]
        cuts[j], held[j] = (cuts[m] + 1, held[m]) if m < n else (0, sums[n] - sums[j])
    # with more than `over` bytes held the first cut is at an item or before it; further cuts follow from there
    over = budget - sums[1:]
    new = np.ones(n, bool)
    new[:-1] = (cuts[1:] != cuts[:-1]) | (held[1:] != held[:-1])
    keep = np.flatnonzero(new)
    # the first that any byte held exceeds is the last one needed
    keep = keep[: int(np.searchsorted(-over[keep], 0)) + 1]
    rows = [(-1, 0, int(cuts[0]), int(held[0]))] + [(int(k), int(over[k]), int(cuts[k]) + 1, int(held[k])) for k in keep]
    p = t["_p"][0].as_py()
    return pa.table({"_p": pa.array([p] * len(rows), pa.int32()), **{c: [r[k] for r in rows] for k, c in enumerate(("at", "over", "cuts", "held"))}, "total": [int(sums[n])] * len(rows)})


def memory_batches(items: DataFrame, order: str, n_bytes: str, budget: int) -> DataFrame:
    """Items in order, cut greedily where the next one would exceed the budget; an item beyond it is a batch of its own.

    The order is taken in ranges. Each range tells, as a short list of steps, how many cuts it makes and what
    it leaves held for any number of bytes held before it; one task follows those lists from range to range,
    and then all ranges cut their items side by side. Ties in the order are taken by size; null sizes count 0, a null order is last.
    """
    size = F.coalesce(F.col(n_bytes).cast("long"), F.lit(0)).alias("size")
    ranged = checkpointed(items.select(order, n_bytes, size).repartitionByRange(F.col(order).asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    by = [(order, "ascending"), ("size", "ascending")]

    def steps(t: pa.Table) -> pa.Table:
        return _range_steps(t.take(pc.sort_indices(t, by, null_placement="at_end")), budget)

    def follow(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True))
        held, batch, out = 0, 0, []
        for p, own in itertools.groupby(rows, key=lambda r: r[0]):
            own = list(own)
            out.append((p, held, batch))
            if held == 0:
                cuts, held = own[0][3:5]
            else:
                cuts, held = next((r[3:5] for r in own[1:] if held > r[2]), (0, held + own[0][5]))
            batch += cuts
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], ["_p", "held", "batch"])

    def cut(a: pa.Table, t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, by, null_placement="at_end"))
        held, batch, out = a["held"][0].as_py(), a["batch"][0].as_py(), []
        for n in t["size"].to_pylist():
            if held and held + n > budget:
                held, batch = 0, batch + 1
            held += n
            out.append(batch)
        return pa.table([t[order], t[n_bytes], pa.array(out, pa.int64())], [order, n_bytes, "batch"])

    kinds = dict(items.dtypes)
    told = ranged.groupBy("_p").applyInArrow(steps, "_p int, at long, over long, cuts long, held long, total long")
    entries = told.coalesce(1).mapInArrow(follow, "_p int, held long, batch long")
    return entries.groupBy("_p").cogroup(ranged.groupBy("_p")).applyInArrow(cut, f"{order} {kinds[order]}, {n_bytes} {kinds[n_bytes]}, batch long")


def estimated_batches(items: DataFrame, n_bytes: str, budget: int, count: int, sample: int = 16, order: str | None = None) -> int:
    """How many batches of `budget` bytes `count` items will make, from the mean of the first few in order, by all columns if none is named."""
    first = items.orderBy(*([order] if order else items.columns)).limit(sample)
    mean = first.agg(F.avg(n_bytes)).first()[0] or 1
    return max(1, math.ceil(count / max(1, budget // max(1, mean))))


def environments(items: DataFrame, order: str, n_envs: int) -> DataFrame:
    """(env_id, item): the first n_envs items in order, taken round where there are fewer."""
    first = items.orderBy(order).limit(n_envs).select(F.col(order).alias("item"))
    numbered = first.select("item", (F.row_number().over(Window.orderBy("item")) - 1).alias("n"))  # n_envs rows at most
    held = numbered.withColumn("held", F.count("*").over(Window.partitionBy()).cast("int"))
    return held.select(F.explode(F.sequence(F.col("n").cast("int"), F.lit(n_envs - 1), F.col("held"))).alias("env_id"), "item")


def within_budget(items: DataFrame, run: str, order: str, bits: str, budget: int) -> DataFrame:
    """Items of each run that fit into its bits in order; what doesn't fit is passed over and the next is tried. A run is one task's."""

    def take(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(order, "ascending"), (bits, "ascending")], null_placement="at_start"))
        room, kept, left = budget, [], []
        for k, n in enumerate(t[bits].to_pylist()):
            if n is not None and n <= room:
                room -= n
                kept.append(k)
                left.append(room)
        t = t.take(pa.array(kept, pa.int64()))
        return pa.table([t[run], t[order], t[bits], pa.array(left, pa.int64())], [run, order, bits, "left"])

    rows = items.select(run, order, F.col(bits).cast("long").alias(bits))
    kinds = dict(rows.dtypes)
    return rows.groupBy(run).applyInArrow(take, f"`{run}` {kinds[run]}, `{order}` {kinds[order]}, `{bits}` bigint, left long")


def progress_ticks(runs: DataFrame, total: str, step: float) -> DataFrame:
    """runs with the percentages at which progress is told and the units done by then."""
    ticks = F.sequence(F.lit(1), F.floor(F.lit(100.0 / step)).cast("int"))
    t = runs.select("*", F.explode(ticks).alias("_k"))
    pct = F.col("_k") * step
    return t.withColumn("pct", pct.cast("double")).withColumn("done", F.ceil(F.col(total) * pct / 100).cast("long")).drop("_k")
