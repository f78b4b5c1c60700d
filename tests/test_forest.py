"""Forests on packed codes against those of pyspark.ml, which are fitted on the vectors."""

import re

import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from basketlens.operators import forest, predict


def purchases(spark, n=2_000):
    """Attributes that depend on each other and on a digest; ``review_rating`` has more values than a feature has bins."""
    h = F.xxhash64("id")
    return spark.range(n).select(
        F.col("id").alias("row_key"),
        F.col("id").alias("customer_id"),
        F.pmod(h, F.lit(60)).cast("int").alias("age"),
        F.when(F.pmod(h, F.lit(3)) == 0, "Male").otherwise("Female").alias("gender"),
        F.concat(F.lit("c"), F.pmod(h, F.lit(7)).cast("string")).alias("color"),
        F.when(F.col("id") % 7 != 0, F.when(F.pmod(h, F.lit(5)) < 2, "Winter").otherwise("Fall")).alias("season"),
        F.when(F.col("id") % 11 != 0, (F.pmod(h, F.lit(997)) / 100.0 + F.pmod(h, F.lit(7)))).alias("review_rating"),
    )


def trees(model):
    """The trees as text, numbers to nine digits: sums of numeric labels are added up in another order."""
    return re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda x: f"{float(x[0]):.9g}", model.toDebugString.split("\n", 1)[1])


@pytest.fixture(scope="module", params=[False, True], ids=["slots", "first slot"])
def frame(request, spark):
    made = predict.model_frame(purchases(spark), flatten=request.param)
    yield made
    made.release()


@pytest.mark.parametrize("target", ["gender", "color", "review_rating_scaled"])
def test_trees_are_those_of_pyspark(spark, frame, target):
    features = [c for c in frame.targets if c != target]
    kind = RandomForestRegressor if target == frame.rating else RandomForestClassifier
    theirs = kind(labelCol=f"{target}_y", featuresCol="features", numTrees=6, maxDepth=4, seed=42).fit(
        predict.assemble(frame.train, features, f"{target}_y")
    )
    mine = predict.fit_target(frame, target, trees=6, depth=4)
    assert mine.numFeatures == theirs.numFeatures
    assert trees(mine.model) == trees(theirs)
    want = [predict.predict(x, frame, target).groupBy("label", "prediction").count() for x in (theirs, mine)]
    rounded = [sorted((round(r[0], 9), round(r[1], 9), r[2]) for r in x.collect()) for x in want]
    assert rounded[0] == rounded[1] and rounded[0]


def test_a_forest_is_kept_as_an_ordinary_model(spark, frame, tmp_path):
    mine = predict.fit_target(frame, "gender", trees=2, depth=2)
    mine.write().save(str(tmp_path / "kept"))
    kept = RandomForestClassificationModel.load(str(tmp_path / "kept"))
    assert kept.getMaxDepth() == 2 and kept.getLabelCol() == "gender_y"
    scores = [sorted(map(tuple, predict.predict(x, frame, "gender").collect())) for x in (mine, kept)]
    assert scores[0] == scores[1]


def test_a_row_is_a_few_bytes_and_one_copy_serves_all_attributes(frame):
    """Before, each fit kept a number per slot of each vector, in a copy of its own."""
    bags = [frame.bag(t, 6, 42) for t in ("gender", "color", "season")]
    assert bags[0] is bags[1] is bags[2]
    if not frame.flatten:
        sizes = bags[0].packs.map(lambda p: (p[0], len(p[1]))).collect()
        assert sum(n for n, _ in sizes) == bags[0].rows
        assert all(size == n * (len(bags[0].attributes) + 6) for n, size in sizes)


def test_equal_rows_are_merged_for_first_slots(spark, monkeypatch):
    """Four first slots and a rating of at most 32 bins: however many rows, few of them differ."""
    made = predict.model_frame(purchases(spark, 6_000), flatten=True)
    try:
        bag = made.bag("gender", 4, 42)
        assert bag.packs.map(lambda p: p[0]).sum() <= 2**4 * 32 < bag.rows
    finally:
        made.release()


def test_wide_attributes_are_counted_by_what_is_asked_for(frame, monkeypatch):
    want = [predict.fit_target(frame, t, trees=3, depth=3) for t in ("color", "review_rating_scaled")]
    monkeypatch.setattr(forest, "WIDEST", 20)
    monkeypatch.setattr(forest, "JOINT_CELLS", 1)
    for old, t in zip(want, ("color", "review_rating_scaled")):
        again = predict.fit_target(frame, t, trees=3, depth=3)
        assert trees(again.model) == trees(old.model)


def test_nan_as_rating_is_an_error(spark):
    made = predict.model_frame(purchases(spark, 200).withColumn("review_rating", F.when(F.col("row_key") == 3, F.lit(float("nan"))).otherwise(F.lit(1.0) + F.col("row_key") % 3)))
    try:
        with pytest.raises(ValueError, match="NaN"):
            predict.fit_target(made, "gender", trees=2, depth=2)
    finally:
        made.release()
