import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketlens.operators import predict


def pairs(spark):
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 4 + [(1.0, 0.0)] + [(2.0, 0.0)] * 3
    return spark.createDataFrame(rows, "label double, prediction double")


def test_metrics_equal_the_evaluators_with_a_class_never_predicted(spark):
    df = pairs(spark)
    got = predict.classification_metrics(df).first()
    for name, metric in {
        "accuracy": "accuracy",
        "f1": "f1",
        "weighted_precision": "weightedPrecision",
        "weighted_recall": "weightedRecall",
    }.items():
        want = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert got[name] == pytest.approx(want), name
    assert got.n == 15


def test_metrics_take_text_labels(spark):
    names = F.element_at(F.array(*[F.lit(x) for x in "abc"]), F.col("label").cast("int") + 1)
    guess = F.element_at(F.array(*[F.lit(x) for x in "abc"]), F.col("prediction").cast("int") + 1)
    df = pairs(spark).select(names.alias("label"), guess.alias("prediction"))
    assert predict.classification_metrics(df).first().accuracy == pytest.approx(0.6)


def test_rmse_equals_the_evaluator_and_skips_nulls(spark):
    df = pairs(spark)
    got = predict.regression_metrics(df.union(spark.createDataFrame([(None, 1.0)], df.schema))).first()
    assert got.rmse == pytest.approx(RegressionEvaluator(metricName="rmse").evaluate(df))
    assert got["n"] == 15


def purchases(spark, n=1_500):
    """``gender`` follows ``color``; ``review_rating`` follows ``season``; the rest is noise."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row_key"),
        (i % 50).alias("customer_id"),
        (F.lit(18) + i * 13 % 60).cast("int").alias("age"),
        F.when(i % 3 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(i % 3 == 0, "blue").otherwise(F.when(i % 3 == 1, "red").otherwise("green")).alias("color"),
        F.when(i % 7 != 0, F.when(i % 2 == 0, "Winter").otherwise("Fall")).alias("season"),
        F.when(i % 11 != 0, F.when(i % 2 == 0, 4.0).otherwise(2.0)).alias("review_rating"),
    )


def test_prepared_parts_share_their_columns_and_drop_the_originals(spark):
    made = predict.prepare(purchases(spark))
    assert made.train.columns == made.test.columns
    assert "customer_id" not in made.train.columns and "review_rating" not in made.train.columns
    assert "review_rating_scaled" in made.test.columns
    assert made.dictionary.columns == ["age", "gender", "color", "season"]
    assert made.train.count() + made.test.count() == 1_500
    width = made.train.select(F.size(vector_to_array("color"))).first()[0]
    assert width == 3


def test_forests_learn_what_can_be_learned(spark):
    got = {
        (r.target, r.metric): r.value
        for r in predict.predict_all_targets(purchases(spark), depth=4, trees=10).collect()
    }
    assert {t for t, _ in got} == {"age", "gender", "color", "season", "review_rating_scaled"}
    assert got["gender", "accuracy"] == pytest.approx(1.0)
    assert got["color", "accuracy"] > 0.6
    assert got["review_rating_scaled", "rmse"] < 0.7
    # Rows without a rating are no labels; a missing season is a class of its own.
    assert got["review_rating_scaled", "n"] < got["season", "n"]


def test_first_slot_labels_are_binary(spark):
    frame = predict.model_frame(purchases(spark), flatten=True)
    try:
        values = {r[0] for r in frame.train.select("color_y").distinct().collect()}
        assert values == {0.0, 1.0}
        got = predict.fit_and_score(frame, ["color"], trees=5, depth=3)
        accuracy = {r.metric: r.value for r in got.collect()}["accuracy"]
        majority = 2 / 3
        assert accuracy >= majority - 0.05
    finally:
        frame.release()


def test_metrics_do_not_depend_on_how_the_input_is_cut(spark):
    scores = [
        sorted(map(tuple, predict.predict_all_targets(purchases(spark, 400).repartition(n), targets=["season"], trees=3, depth=3).collect()))
        for n in (1, 4, 8)
    ]
    assert scores[0] == scores[1] == scores[2]


def test_caches_are_released(spark):
    predict.predict_all_targets(purchases(spark, 300), targets=["gender"], trees=2, depth=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_rows_of_a_forest_lie_in_as_many_pieces_as_they_need_and_without_vectors(spark, monkeypatch):
    """Neither the rows of a piece nor what is cached of a row grows with the table or with the width of its vectors."""
    monkeypatch.setattr(predict, "FOREST_ROWS", 20)
    frame = predict.model_frame(purchases(spark))
    try:
        n = frame.stored[0].count()
        assert frame.stored[0].rdd.getNumPartitions() == -(-n // 20) > predict.FOREST_PARTITIONS
        assert frame.stored[1].rdd.getNumPartitions() == max(32, -(-(1_500 - n) // 20))
        assert not any(t.startswith("vector") for _, t in frame.stored[0].dtypes)
        assert sum(t.startswith("vector") for _, t in frame.train.dtypes) == len(frame.categorical)
        slots = frame.train.select(F.array_position(vector_to_array("color"), 1.0) - 1, "color_y").distinct().collect()
        assert len(slots) == 3 and all(a == b for a, b in slots)
    finally:
        frame.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_fits_side_by_side_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Every fit keeps a copy of the rows, so large tables are fitted one at a time; the scores stay the same."""
    assert [predict.side_by_side(n, 4) for n in (0, 10, 2_000_000, 3_000_000, 8_000_000, 30_000_000)] == [4, 4, 4, 2, 1, 1]
    used, run = [], predict.run_parallel
    monkeypatch.setattr(predict, "run_parallel", lambda spark, jobs, threads: (used.append(threads), run(spark, jobs, threads))[1])
    scores = []
    for most in (predict.FITTED_ROWS, 100):
        monkeypatch.setattr(predict, "FITTED_ROWS", most)
        scores.append(sorted(map(tuple, predict.predict_all_targets(purchases(spark, 400), targets=["season", "color"], flatten=True, trees=2, depth=2).collect())))
    assert used == [4, 1] and scores[0] == scores[1]
