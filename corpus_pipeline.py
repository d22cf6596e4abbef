"""A training corpus in five stages: quality rules, line dedup, near-dedup, decontamination, packing.

All stages take an empty table to an empty result and keep extra columns of any name, which the last
one doesn't return. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm.best_fit import best_fit_pack
from blockwright.llm.decontaminate import drop_contaminated
from blockwright.llm.line_dedup import line_dedup
from blockwright.llm.near_dedup import near_dedup
from blockwright.llm.quality_rules import quality_rules
from blockwright.llm.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes; a null doc_id or language is no reason to go (an unknown
    language is judged by its letters alone); each of repeated rows is judged by itself, so all stay or go.
    """
    return quality_rules(docs).filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents that are left without any words by that.

    A null or empty text is kept as it is; lines of repeated rows at one place don't remove each other; a
    null doc_id sorts after all others.
    """
    return line_dedup(docs, carry=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component stays, once; rows without doc_id or words all stay.

    Of rows that share doc_id and text the one whose other columns come first, as JSON, stays. Only such
    rows are dealt out by doc_id and text.
    """
    kept = near_dedup(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id")
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    left = docs.join(kept, "doc_id", "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("one"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(one.select("one.*")).unionAll(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null text or item has no words and matches nothing; an item of fewer words than a window is one
    window; each of repeated rows is judged by itself; a null doc_id is no reason to go.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; a null doc_id stays null;
    pieces of equal length may swap places from run to run.
    """
    return best_fit_pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate components and packing plans are iterative; tests compare the stages with brute force.
ORACLE_SQL = None
