"""The registered text queries against SQL, and the pipeline stage by stage against brute force."""

import compare
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_components, brute_groups

from basketlens.llm import catalog
from basketlens.llm.common import saved


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, data, name):
    got = compare.spark_table(catalog.queries()[name](spark, data))
    assert got[1]
    assert compare.difference(got, compare.duck_table(compare.database(data), catalog.oracle_sql()[name])) is None


def test_every_query_has_a_row_per_document(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op3_pieces", "op4_personal_data", "op6_language_id", "op9_fingerprints", "op10_mixing"):
        assert catalog.queries()[name](spark, data).count() == n


def test_native_operators_run_no_python(spark, data):
    for name in ("op9_fingerprints", "op10_mixing"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("MapInArrow", "PythonUDF", "ArrowEval", "CartesianProduct", "BroadcastNestedLoop"))


def test_the_pipeline_stage_by_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    expected = [set(kept)]
    first = {keep for keep, _ in brute_groups(kept.items()).values()}
    expected.append(first)
    near = {c for i, _, c in brute_components([(i, kept[i]) for i in first])}
    expected.append(near)
    stages = dict(corpus_pipeline.STAGES)
    assert [name.split(" ")[0] for name in stages] == ["language", "exact", "n-gram", "mixing", "piece"]
    for k, stage in enumerate(stages.values()):
        before = docs
        docs = saved(stage(spark, docs, data), "stage")
        if k < 3:
            assert {r.doc_id for r in docs.select("doc_id").collect()} == expected[k]
        if k < 4:
            assert docs.columns == before.columns
        if k == 3:
            # Only text close to the toxic domain gives way.
            rates = catalog.mixing_rates(before, spark.read.parquet(f"{data}/labels.parquet"))
            gone = rates.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").collect()
            assert all(r.copies == 0 for r in gone) and all(r.p_toxic > 0.05 for r in gone)
            assert rates.agg(F.sum("copies")).first()[0] == docs.count()
    out = docs.collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out) and {r.doc_id for r in out} <= near


def test_mixing_keeps_every_clean_document(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rates = catalog.mixing_rates(docs, labels).collect()
    assert all(r.copies >= 1 and r.rate >= 1 for r in rates if r.p_toxic <= 0.5)
    assert any(r.rate > 1 for r in rates)
    clean = {r.doc_id for r in labels.filter("toxic = 0").join(docs, "doc_id").select("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.mixed(spark, docs, data).select("doc_id").collect()}
    assert clean and clean <= kept


def test_the_pipeline_of_edges(spark, edges, nothing, data):
    for df in (edges.drop("score", "row", "id"), nothing.drop("score", "row", "id")):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, data), "stage")
        assert docs.count() <= df.count()
