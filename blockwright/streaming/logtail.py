"""Log tailing with Structured Streaming: line kinds as they come, and a running context per file.

An extension of the batch ETL: the carry-forward of epoch, phase and batch becomes keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockwright.operators.trainlog import group, number, whole, with_kind

PROGRESS_SQL = "file string, line_no long, epoch int, phase string, batch int, label string, pct int, elapsed_s double"


def read_lines(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """lines(file, file_no, line_no, line) of JSON lines with those fields, as files arrive."""
    return spark.readStream.schema("file string, file_no int, line_no long, line string").option("maxFilesPerTrigger", per_trigger).json(folder)


def kind_counts(lines: DataFrame) -> DataFrame:
    return with_kind(lines).groupBy("file", "kind").agg(F.count("*").alias("n"))


def live_progress(lines: DataFrame) -> DataFrame:
    """Progress facts under the header last seen in their file; lines of one trigger are put in order by line_no."""
    k = with_kind(lines).filter("kind IN ('batch', 'val', 'progress')")
    parsed = k.select(
        "file", "line_no", "kind",
        F.when(F.col("kind") == "batch", whole("batch", 1)).otherwise(whole("val", 1)).alias("h_epoch"), F.when(F.col("kind") == "batch", whole("batch", 3)).otherwise(whole("val", 3)).alias("h_batch"),
        group("progress", 1).alias("label"), whole("progress", 2).alias("pct"), number("progress", 5).alias("elapsed_s"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, phase, batch = state.get if state.exists else (-1, "", -1)
        rows = []
        for r in pd.concat(list(frames)).sort_values("line_no").itertuples():
            if r.kind != "progress":
                epoch, phase, batch = int(r.h_epoch), "train" if r.kind == "batch" else "val", int(r.h_batch)
            elif phase:
                rows.append((key[0], r.line_no, epoch, phase, batch, r.label, int(r.pct), r.elapsed_s))
        state.update((epoch, phase, batch))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROGRESS_SQL.split(", ")])

    return parsed.groupBy("file").applyInPandasWithState(step, PROGRESS_SQL, "epoch int, phase string, batch int", "append", GroupStateTimeout.NoTimeout)
