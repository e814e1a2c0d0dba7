"""Registered queries against their SQL, contracts and the pipeline."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from pointloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    key = [next(c for c in ("doc_id", "page_id", "vec_id") if c in cols)]
    a, b = (x[cols].sort_values(key, ignore_index=True) for x in (a, b))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df())


def test_all_queries_and_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name, label, least", [("op5_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas().merge(queries.table(spark, sf, "labels").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 20 and (held["predicted"] == held[label]).mean() >= least


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    before = docs
    for name, f in list(stage.items())[:-1]:
        after = f(spark, before, SF)
        assert after.columns == docs.columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()} and kept
        if name == "near-dedup":
            assert simhash.near_duplicates(after).where("doc_id <> component_id").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
