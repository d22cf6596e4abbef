"""Session builder with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests.
DEFAULT_WORK = "/tmp/checkpoints/blockwright"


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, else DEFAULT_WORK."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or DEFAULT_WORK).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, with its partitions and their order."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def session(master: str | None = None, app: str = "blockwright", partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, Arrow on, AQE with skew handling; conf overrides with ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
