"""Training-log ETL: lines(file, file_no, line_no, line) to batch, epoch and progress facts.

Order-bearing steps key on (file_no, line_no) and a run, whose columns are `run`. What a line takes from the
lines before it is carried by blocks of a file's lines: a window within each block, and one over the blocks'
own last values, a row for 65,536 lines. So neither a log nor many in one run gather in one task.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import duration_seconds, five_numbers, fixed_text, once, relative, row_class, to_bool

NUMBER = r"[-+]?[\d\.eE]+"
TIME = r"[\dhms\.]+"
_EPOCH = r"^\[Epoch\s+(\d+)/(\d+)\]\s+"
_MIDDLE = rf"\s+\(min=({NUMBER}),\s+q1=({NUMBER}),\s+q3=({NUMBER}),\s+max=({NUMBER})\)\s+"
_SUMMARY = rf"\s+iter\s+(\d+)/(\d+)\s+bpp_med=({NUMBER})" + _MIDDLE + rf"PSNR_med=({NUMBER})\s+dB" + _MIDDLE + rf"MS-SSIM_avg=({NUMBER})\s+Wtotal=({NUMBER})\s+"
#: Fixed values of the log grammar, in the order in which a line is tried.
PATTERNS = {
    "batch": _EPOCH + r"Batch\s+(\d+)/(~?\d+)\s*$",
    "val": _EPOCH + r"VAL\s+(\d+)/(~?\d+)",
    "progress": r"^\[PROGRESS\]\s+(.+?)\s+(\d+)%\s+\((\d+)/(\d+)\)\s+elapsed=([\d\.]+)s",
    "metrics": _EPOCH + rf"(\d+)/(~?\d+)\s+(BATCH|VAL-BATCH|TOTAL)\s+bpp=\[([^\]]+)\]\s+PSNR=\[([^\]]+)\]\s+MS=(\S+)\s+R~=({NUMBER})",
    "elapsed": _EPOCH + rf"(TRAIN-BATCH|VAL-BATCH)\s+(\d+)\s+elapsed=({TIME})\s*$",
    "time": _EPOCH + rf"(\d+)/(~?\d+)\s+TIME\s+elapsed=({TIME})\s+avg/batch=({TIME})\s+est_epoch=({TIME})\s+eta_epoch=({TIME})",
    "train_summary": r"^\[RL\]" + _SUMMARY + rf"TRAIN_epoch_elapsed=({TIME})\s+alpha_bpp=({NUMBER})\s+alpha_psnr=({NUMBER})",
    "val_summary": r"^\[VAL\]" + _SUMMARY + rf"VAL_epoch_elapsed=({TIME})",
    "early": r"^\[RL\]\s+\(val-based\)\s+improved:\s+val_bpp_med=(\w+),\s+val_psnr_med=(\w+),\s+wait=(\d+)/(\d+)",
    "saved": r"^\[RL\]\s+saved epoch checkpoint -> (.+)$",
}
FIVE = ("min", "q1", "med", "q3", "max")


def group(kind: str, n: int) -> Column:
    return F.regexp_extract("line", PATTERNS[kind], n)


def number(kind: str, n: int) -> Column:
    return group(kind, n).try_cast("double")


def whole(kind: str, n: int) -> Column:
    return group(kind, n).try_cast("int")


def with_kind(lines: DataFrame) -> DataFrame:
    """Each line's kind by the first pattern that fits; a progress line before any header counts all the same."""
    kind = F.lit("other")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    return once(lines, kind=kind)


#: A block holds 2**BLOCK_BITS line numbers of one file.
BLOCK_BITS = 16


def _carried(rows: DataFrame, run: list[str], last: dict[str, Column], greatest: dict[str, Column] | None = None) -> DataFrame:
    """rows with the last value that isn't null, or the greatest, of all lines of the run up to each."""
    greatest = greatest or {}
    at = [*run, "file_no", "_block"]
    rows = rows.withColumns({"_block": F.shiftright(F.col("line_no").cast("long"), BLOCK_BITS)} | {f"_{n}": c for n, c in (last | greatest).items()})
    heads = rows.groupBy(*at).agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line_no"))).alias(f"_{n}") for n in last], *[F.max(f"_{n}").alias(f"_{n}") for n in greatest])
    before = Window.partitionBy(*(run or [F.lit(0)])).orderBy("file_no", "_block").rowsBetween(Window.unboundedPreceding, -1)
    known = {n: F.last(f"_{n}", True) for n in last} | {n: F.max(f"_{n}") for n in greatest}
    heads = heads.select(*[F.col(c).alias(f"_of_{c}") for c in at], *[c.over(before).alias(f"_before_{n}") for n, c in known.items()])
    within = Window.partitionBy(*at).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({f"_{n}": c.over(within) for n, c in known.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in at]
    joined = own.join(heads, functools.reduce(operator.and_, same), "left")
    now = {n: F.coalesce(f"_{n}", f"_before_{n}") for n in last} | {n: F.greatest(f"_{n}", f"_before_{n}") for n in greatest}
    return joined.withColumns(now).drop("_block", *[f"_of_{c}" for c in at], *[f"{p}{n}" for n in known for p in ("_", "_before_")])


def with_context(kinded: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Lines with the epoch, phase and batch of the last header; files of a run carry on where the one before ended."""
    header = F.when(F.col("kind") == "batch", F.struct(whole("batch", 1).alias("epoch"), F.lit("train").alias("phase"), whole("batch", 3).alias("batch")))
    header = header.when(F.col("kind") == "val", F.struct(whole("val", 1).alias("epoch"), F.lit("val").alias("phase"), whole("val", 3).alias("batch")))
    return _carried(kinded, run or [], {"context": header})


def progress(lines: DataFrame, run: list[str] | None = None) -> DataFrame:
    run = run or []
    k = with_kind(lines).filter("kind IN ('batch', 'val', 'progress')")
    c = with_context(k, run).filter("kind = 'progress' AND context IS NOT NULL")
    return c.select(*run, "file", "file_no", "line_no", "context.*", group("progress", 1).alias("label"), whole("progress", 2).alias("pct"), whole("progress", 3).alias("done"), whole("progress", 4).alias("total"), number("progress", 5).alias("elapsed_s"))


def latest_progress(facts: DataFrame, run: list[str] | None = None) -> DataFrame:
    """The furthest progress of each label; the longer elapsed among equals (none counts as -1), then the later line."""
    run = run or []
    elapsed = F.when(F.coalesce("elapsed_s", F.lit(0.0)) == 0, -1.0).otherwise(F.col("elapsed_s"))
    keys = [*run, "phase", "epoch", "batch", "label"]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct("pct", "done", "total", "elapsed_s"), F.struct("pct", elapsed, "file_no", "line_no")).alias("p"))
    return best.select(*keys, "p.*")


def _phase(label: Column) -> Column:
    return F.when(label.isin("BATCH", "TOTAL", "TRAIN-BATCH"), "train").otherwise("val")


def per_batch(lines: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Batch metrics, each with the elapsed time that a later line of its batch gave it.

    An elapsed line fills the latest row of its key that has none yet, as a stack would. With +1 for rows
    and -1 for times (those on an empty stack ignored) a row and the time that fills it are neighbours at
    one depth, so the match is two windows.
    """
    run = run or []
    k = with_kind(lines).filter(F.col("kind").isin("metrics", "elapsed"))
    is_row = F.col("kind") == "metrics"
    either = lambda m, e: F.when(is_row, m).otherwise(e)
    k = k.withColumns({"epoch": either(whole("metrics", 1), whole("elapsed", 1)), "phase": _phase(either(group("metrics", 5), group("elapsed", 3))), "batch": either(whole("metrics", 3), whole("elapsed", 4))})
    key = [*run, "epoch", "phase", "batch"]
    up_to = Window.partitionBy(*key).orderBy("file_no", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = k.withColumn("_s", F.sum(F.when(is_row, 1).otherwise(-1)).over(up_to))
    k = k.withColumn("_low", F.least(F.lit(0), F.min("_s").over(up_to)))
    before = F.coalesce(F.lag("_low").over(Window.partitionBy(*key).orderBy("file_no", "line_no")), F.lit(0))
    k = k.withColumns({"_ignored": ~is_row & (F.col("_low") < before), "_depth": F.col("_s") - F.col("_low")}).filter("NOT _ignored")
    level = Window.partitionBy(*key, F.when(is_row, F.col("_depth")).otherwise(F.col("_depth") + 1)).orderBy("file_no", "line_no")
    k = k.withColumn("_t", F.lead(F.when(~is_row, duration_seconds(group("elapsed", 5)))).over(level)).filter(is_row)
    lists = {name: five_numbers(group("metrics", n)) for name, n in (("bpp", 6), ("psnr", 7))}
    k = once(k, **{f"_{n}": c for n, c in lists.items()})
    return k.select(
        *run, "file", "file_no", "line_no", "epoch", whole("metrics", 2).alias("epochs_total"), "phase", "batch", group("metrics", 4).alias("nbatch"),
        *[F.col(f"_{n}")[i].alias(f"{n}_{q}") for n in lists for i, q in enumerate(FIVE)], number("metrics", 8).alias("ms"), number("metrics", 9).alias("R"), F.col("_t").alias("batch_elapsed_s"),
    )


_SUMMARY_COLUMNS = {3: "bpp_med", 4: "bpp_min", 5: "bpp_q1", 6: "bpp_q3", 7: "bpp_max", 8: "psnr_med", 9: "psnr_min", 10: "psnr_q1", 11: "psnr_q3", 12: "psnr_max", 13: "ms_avg", 14: "Wtotal"}


def per_epoch(lines: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Train and validation summaries merged by epoch, the last of each winning, with early stopping and checkpoints.

    Early-stop and checkpoint lines belong to the epoch of the last metrics row before them, or else to the
    greatest epoch known so far; a checkpoint alone makes no row.
    """
    run = run or []
    k = with_kind(lines)

    def summary(kind: str, prefix: str, more: dict[str, Column]) -> DataFrame:
        values = {f"{prefix}_{c}": number(kind, n) for n, c in _SUMMARY_COLUMNS.items()} | {f"{prefix}_epoch_elapsed_s": duration_seconds(group(kind, 15))} | more
        s = k.filter(F.col("kind") == kind).select(*run, whole(kind, 1).alias("epoch"), F.struct("file_no", "line_no").alias("at"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("v"))
        return s.groupBy(*run, "epoch").agg(F.max_by("v", "at").alias("v")).select(*run, "epoch", "v.*")

    train = summary("train_summary", "train", {"epochs_total": whole("train_summary", 2), "alpha_bpp": number("train_summary", 16), "alpha_psnr": number("train_summary", 17)})
    val = summary("val_summary", "val", {})
    metric = F.when(F.col("kind") == "metrics", whole("metrics", 1))
    known = F.when(F.col("kind") == "train_summary", whole("train_summary", 1)).when(F.col("kind") == "val_summary", whole("val_summary", 1))
    told = _carried(k.filter(~F.col("kind").isin("other", "progress", "time")), run, {"metric": metric}, {"known": known})
    attached = told.filter("kind IN ('early', 'saved')").withColumn("epoch", F.coalesce("metric", "known")).filter("epoch IS NOT NULL")
    at = F.struct("file_no", "line_no")
    early = attached.filter("kind = 'early'").groupBy(*run, "epoch").agg(F.max_by(F.struct(to_bool(group("early", 1)).alias("improved_bpp"), to_bool(group("early", 2)).alias("improved_psnr"), whole("early", 3).alias("early_wait"), whole("early", 4).alias("early_patience")), at).alias("v")).select(*run, "epoch", "v.*")
    saved = attached.filter("kind = 'saved'").groupBy(*run, "epoch").agg(F.max_by(F.trim(group("saved", 1)), at).alias("checkpoint"))
    keys = [*run, "epoch"]
    return train.join(val, keys, "full").join(early, keys, "full").join(saved, keys, "left")


def totals(batches: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Means of an epoch's rows per phase, missing values left out, with the mean and sum of batch times."""
    run = run or []
    mean = lambda c: F.avg(F.nullif(F.col(c), F.lit(float("nan"))))
    lists = [f"{n}_{q}" for n in ("bpp", "psnr") for q in FIVE]
    return batches.groupBy(*run, "epoch", "phase").agg(*[mean(c).alias(c) for c in [*lists, "ms"]], F.coalesce(mean("R"), F.lit(0.0)).alias("R"), mean("batch_elapsed_s").alias("dt_avg"), F.sum(F.nullif(F.col("batch_elapsed_s"), F.lit(float("nan")))).alias("dt_total"), F.count("*").alias("n"))


def reward_classes(batches: DataFrame, blue_above: float | None = None, run: list[str] | None = None, epochs: DataFrame | None = None) -> DataFrame:
    """Each batch's reward against its epoch's: the epoch's own total if it is given and not 0, else the mean of its rows."""
    run = run or []
    mean = F.avg("R").over(Window.partitionBy(*run, "epoch", "phase"))
    if epochs is not None:
        own = epochs.select(*run, "epoch", F.explode(F.array(F.struct(F.lit("train").alias("phase"), F.col("train_Wtotal").alias("w")), F.struct(F.lit("val").alias("phase"), F.col("val_Wtotal").alias("w")))).alias("e")).select(*run, "epoch", "e.*")
        batches, base = batches.withColumn("_mean", mean).join(own, [*run, "epoch", "phase"], "left"), F.coalesce(F.nullif(F.col("w"), F.lit(0.0)), F.col("_mean"))
    else:
        base = mean
    b = batches.withColumn("_base", base)
    return b.select(*run, "epoch", "phase", "batch", relative(F.col("R"), F.col("_base")).alias("r_rel"), row_class(F.col("R"), F.col("_base"), blue_above, True).alias("class"))


def report(lines: DataFrame, run: list[str] | None = None) -> DataFrame:
    """The rows of the epoch tables in one relation: batch rows, their latest progress, and totals, by section."""
    run = run or []
    batches, latest = per_batch(lines, run), latest_progress(progress(lines, run), run)
    keys = [*run, "epoch", "phase"]
    rows = batches.select(*keys, F.lit(0).alias("section"), "batch", F.lit("ROW").alias("label"), F.col("R").alias("value"))
    nested = latest.join(batches.select(*keys, "batch").distinct(), [*keys, "batch"], "left_semi").select(*keys, F.lit(1), "batch", F.concat(F.lit("PROG "), "label"), F.col("pct").cast("double"))
    total = totals(batches, run).select(*keys, F.lit(2), F.lit(None).cast("int"), F.lit("TOTAL"), "R")
    return rows.unionAll(nested).unionAll(total)


def formatted(batches: DataFrame, run: list[str] | None = None) -> DataFrame:
    """The text cells of an epoch table: lists padded to the widest entry of their place in the epoch and phase."""
    run = run or []
    w = Window.partitionBy(*run, "epoch", "phase")
    out, lists = batches, {}
    for name, decimals in (("bpp", 3), ("psnr", 2)):
        cells = [fixed_text(F.col(f"{name}_{q}"), decimals) for q in FIVE]
        out = once(out, **{f"_{name}{i}": c for i, c in enumerate(cells)})
        lists[name] = F.concat(F.lit("["), F.concat_ws(", ", *[F.rpad(f"_{name}{i}", F.max(F.length(f"_{name}{i}")).over(w), F.lit(" ")) for i in range(5)]), F.lit("]"))
    out = out.select("*", *[c.alias(f"{n}_cell") for n, c in lists.items()])
    base = F.avg("R").over(w)
    signed = lambda c: F.concat(F.when(c >= 0, "+").otherwise(""), fixed_text(c, 3))
    took = F.when(F.col("batch_elapsed_s").isNull() | F.isnan("batch_elapsed_s"), "nan").otherwise(F.concat(fixed_text(F.col("batch_elapsed_s"), 1), F.lit("s")))
    return out.select(*run, "epoch", "phase", "batch", "bpp_cell", "psnr_cell", fixed_text(F.col("ms"), 3).alias("ms_cell"), signed(F.col("R")).alias("r_cell"), signed(relative(F.col("R"), base)).alias("r_rel_cell"), took.alias("dt_cell"))
