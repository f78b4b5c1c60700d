import os

import pytest
from pyspark.sql import functions as F

from basketlens.operators import predict
from basketlens.operators.report import SECTIONS
from basketlens.plans import catalog, pipeline
from basketlens.plans.features import add_features
from basketlens.schema import RETAIL
from basketlens.sources.files import from_display_names, read_csv, to_display_names, write_table
from basketlens.sources.shop import shop


def test_everything_is_written_and_the_source_is_not_touched(spark, data, tmp_path):
    before = {f: os.path.getmtime(f"{data}/{f}") for f in os.listdir(data)}
    table = shop(spark, data)
    paths = pipeline.run(table, str(tmp_path), segments=catalog.FROZEN)
    assert {f: os.path.getmtime(f"{data}/{f}") for f in os.listdir(data)} == before
    n = table.count()
    for name in ("demographic", "value", "purchase_behavior", "category", "seasonal", "preference", "all", "segmented"):
        assert spark.read.parquet(paths[name]).count() == n
    value = spark.read.parquet(paths["value"])
    assert value.columns == ["Customer ID", "Segment", "Cluster", "Value_Score", "Purchase Amount (USD)", "Previous Purchases"]
    assert value.where(F.col("Value_Score").isNull()).count() == 0
    report = "\n".join(r.value for r in spark.read.text(paths["report"]).collect())
    assert all(f"{title}:" in report for title in SECTIONS.values()) and "Segment 4" in report
    for name, flags, shown in (("category", "Prefers", "Category"), ("seasonal", "Shops", "Season")):
        flagged = spark.read.parquet(paths[name])
        known = flagged.where(F.col(shown).isNotNull())
        assert flagged.where(F.col(shown).isNull() & F.col(flags).isNotNull()).count() == 0
        assert known.where((F.size(flags) == 1) & (F.element_at(flags, F.replace(shown, F.lit(" "), F.lit("_"))) == 1)).count() == known.count() > 0


def test_thousands_of_categories_go_through(spark, data, tmp_path):
    table = shop(spark, data).withColumn("category", F.concat(F.lit("c."), F.col("row_key") % 5_000))
    paths = pipeline.run(table, str(tmp_path), segments=catalog.FROZEN, flags=False)
    shares = spark.read.parquet(paths["category_preferences"])
    assert shares.select("category").distinct().count() == table.where("review_rating is not null").select("category").distinct().count()
    sums = shares.groupBy("segment").agg(F.sum("preference").alias("s")).collect()
    assert len(sums) == 4 and all(abs(r.s - 1) < 1e-9 for r in sums)
    names = spark.read.parquet(paths["category_flag_names"])
    flags = spark.read.parquet(paths["category"]).select(F.explode("Prefers").alias("name", "flag"))
    assert names.count() == names.select("name").distinct().count() == flags.select("name").distinct().count() > 1000
    lines = [r.value for r in spark.read.text(paths["report"]).collect()]
    assert all(f"{title}:" in lines for title in SECTIONS.values())
    assert sum(x.startswith("c.") for x in lines) == shares.select("category").distinct().count()


def test_flags_are_for_named_values_only(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr("basketlens.plans.features.levels", lambda *a: pytest.fail("values go through the driver"))
    table = shop(spark, data)
    paths = pipeline.run(table, str(tmp_path / "long"), segments=catalog.FROZEN)
    assert {"category_preferences", "season_preferences"} <= set(paths)
    with pytest.raises(ValueError, match="season"):
        pipeline.run(table, str(tmp_path / "none"), segments=catalog.FROZEN, flags=True, values={"category": ["a"]})
    paths = pipeline.run(table, str(tmp_path / "wide"), segments=catalog.FROZEN, flags=True, values={"category": ["a", "b"], "season": ["Fall"]})
    assert len(spark.read.parquet(paths["category"]).columns) == len(spark.read.parquet(f"{tmp_path}/long/features/category_features").columns) + 1


def test_csv_output_and_fitted_segments(spark, data, tmp_path):
    table = shop(spark, data).drop("customer_id")
    paths = pipeline.run(table, str(tmp_path), k=3, restarts=1, fmt="csv")
    back = spark.read.option("header", True).csv(paths["demographic"])
    assert back.columns[:3] == ["ID", "Segment", "Cluster"]
    ids = back.agg(F.count_distinct("ID"), F.max(F.col("ID").cast("long"))).first()
    assert ids[0] == ids[1] == table.count()
    assert back.where("Segment is not null").select("Segment").distinct().count() == 3


def test_a_csv_with_display_names_goes_through_everything(spark, data, tmp_path):
    table = shop(spark, data, [f.name for f in RETAIL.fields])
    path = write_table(to_display_names(table), str(tmp_path / "in"), "csv", null_text="NA")
    back = from_display_names(read_csv(spark, path, null_text="NA"))
    assert back.columns == [f.name for f in RETAIL.fields]
    made = add_features(back)
    assert all(made.groups.values())
    assert made.df.where("age_group is not null and value_score is not null").count() > 0
    got = predict.predict_all_targets(back, targets=["gender"], key="customer_id", trees=3, depth=3)
    assert {r.metric for r in got.collect()} >= {"accuracy", "f1"}


def test_a_csv_is_preprocessed_and_modelled(spark, data, tmp_path):
    table = shop(spark, data, [f.name for f in RETAIL.fields])
    path = write_table(to_display_names(table), str(tmp_path / "in"), "csv", null_text="NA")
    back = from_display_names(read_csv(spark, path, null_text="NA"))
    paths = pipeline.preprocess(back, str(tmp_path / "pre"), "customer_id")
    assert set(paths) == {"shape", "head", "schema", "describe", "distinct", "missing", "train", "test"}
    counts = {name: read_csv(spark, paths[name]).count() for name in ("train", "test", "head", "schema")}
    assert counts["train"] + counts["test"] == table.count() and counts["train"] > 2 * counts["test"] > 0
    assert (counts["head"], counts["schema"]) == (10, len(RETAIL.fields))
    train = read_csv(spark, paths["train"])
    assert "review_rating_scaled" in train.columns and "review_rating" not in train.columns
    scores = pipeline.model(back, str(tmp_path / "model"), "customer_id", targets=["gender", "review_rating_scaled"], trees=3, depth=3)
    got = {(r.target, r.metric): r.value for r in read_csv(spark, scores["metrics"]).collect()}
    assert 0 <= got["gender", "accuracy"] <= 1 and got["review_rating_scaled", "rmse"] > 0
    assert got["gender", "n"] == counts["test"]
