import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from compare import same
from fixtures import components, table
from test_dedup import lines_by_hand
from test_texts import hits_by_hand, plain_ids

from blockwright.llm.oracle import SQL
from blockwright.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_stages_against_plain_forms(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "near-duplicates", "benchmark decontamination", "best-fit packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = stages["quality rules"](spark, docs, sf)
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.schema == docs.schema and 0 < len(rows) < docs.count()
    good = spark.createDataFrame(good.collect(), docs.schema)
    kept, gone = lines_by_hand(list(rows.items()))
    lined = stages["line dedup"](spark, good, sf)
    want = {d: k for n, ((d, t), k) in enumerate(zip(rows.items(), kept, strict=True)) if k.split() or not any(m == n for m, _ in gone)}
    assert lined.schema == docs.schema and {r["doc_id"]: r["text"] for r in lined.collect()} == want
    lined = spark.createDataFrame(lined.collect(), docs.schema)
    near = stages["near-duplicates"](spark, lined, sf)
    roots = components(list(want.items()), 5, 80, 100)
    want = {d: t for d, t in want.items() if roots[d] == d}
    assert near.schema == docs.schema and {r["doc_id"]: r["text"] for r in near.collect()} == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, spark.createDataFrame(near.collect(), docs.schema), sf)
    want = {d: want[d] for d, *_, bad in hits_by_hand(list(want.items()), items) if not bad}
    assert clean.schema == docs.schema and {r["doc_id"]: r["text"] for r in clean.collect()} == want
    packed = stages["best-fit packing"](spark, spark.createDataFrame(clean.collect(), docs.schema), sf).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {d: len(plain_ids(t)) + 1 for d, t in want.items()}
    whole = P.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_on_a_hostile_table(spark, sf):
    import corpus_pipeline as P

    for rows in (None, []):
        for name, stage in P.STAGES:
            df = table(spark, rows)
            out = stage(spark, df, sf)
            assert name == P.STAGES[-1][0] or out.schema == df.schema
            assert (out.count() > 0) == (rows is None)
    near = P.near_duplicates(spark, table(spark), sf).collect()
    assert [r["doc_id"] for r in near].count(2) == 0 and sum(r["doc_id"] is None for r in near) == 2
