import math

import pytest
from pyspark.sql import functions as F

from basketlens.operators import segment

CORNERS = [(0.0, 0.0), (0.0, 50.0), (50.0, 0.0), (50.0, 50.0)]


def blobs(spark):
    rows = [
        (i, x + (i * 37 % 11) / 5.0, y + (i * 17 % 13) / 5.0)
        for i, (x, y) in ((j, CORNERS[j % 4]) for j in range(400))
    ]
    rows += [(400, None, 1.0), (401, 1.0, math.nan)]
    return spark.createDataFrame(rows, "row_key long, x double, y double")


def test_blobs_are_found_and_incomplete_rows_stay(spark):
    df = blobs(spark)
    model = segment.fit_segments(df, k=4, restarts=3)
    out = model.assign(df)
    assert out.count() == 402
    assert out.where("segment is null").count() == 2
    sizes = {r.segment: r["n"] for r in out.where("segment is not null").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    assert sizes == {f"Segment {i}": 100 for i in range(1, 5)}
    assert model.centres == sorted(model.centres)


def test_more_restarts_never_cost_more(spark):
    df = blobs(spark)
    costs = [segment.fit_segments(df, k=3, restarts=n).cost for n in (1, 4)]
    assert costs[1] <= costs[0] * (1 + 1e-9)


def test_centres_are_the_means_of_their_members_and_cost_adds_up(spark):
    df = blobs(spark)
    model = segment.fit_segments(df, k=4, restarts=4)
    by = segment.cost_by_segment(df, model).orderBy("segment").collect()
    for row, centre in zip(by, model.centres):
        for i, c in enumerate(model.columns):
            z = (row[f"mean_{c}"] - model.shift[i]) / model.scale[i]
            assert z == pytest.approx(centre[i], abs=1e-6)
    assert sum(r.cost for r in by) == pytest.approx(model.cost)


def test_every_fit_on_the_real_table_comes_to_rest(spark, data):
    from basketlens.sources.shop import shop

    columns = ["age", "purchase_amount", "review_rating", "previous_purchases"]
    df = shop(spark, data, ["row_key", *columns])
    model = segment.fit_segments(df, restarts=4)
    assert len(model.steps) == 4 and max(model.steps) > 10
    by = segment.cost_by_segment(df, model).orderBy("segment").collect()
    for row, centre in zip(by, model.centres):
        for i, c in enumerate(model.columns):
            assert (row[f"mean_{c}"] - model.shift[i]) / model.scale[i] == pytest.approx(centre[i], abs=1e-3)
    with pytest.raises(RuntimeError, match="come to rest"):
        segment.fit_segments(df, restarts=1, max_iter=3)


def test_dotted_columns_can_be_clustered(spark):
    df = blobs(spark).withColumnRenamed("x", "x.amount")
    assert segment.fit_segments(df, k=2, restarts=1).columns == ["x.amount", "y"]


def test_the_id_is_used_only_on_request(spark):
    df = blobs(spark).withColumn("customer_id", F.col("row_key"))
    assert segment.fit_segments(df, k=2, restarts=1).columns == ["x", "y"]
    with_id = segment.fit_segments(df, k=2, restarts=1, include_id=True)
    assert with_id.columns == ["x", "y", "customer_id"]


def test_ties_go_to_the_lowest_id_and_constants_are_harmless(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (-1.0, 5.0)], "x double, c double")
    model = segment.Segments(["x", "c"], [0.0, 5.0], [1.0, 0.0], [[-1.0, 0.0], [1.0, 0.0]])
    assert [r.cluster for r in model.assign(df).collect()] == [1, 2, 1]
    one = segment.Segments(["x"], [0.0], [1.0], [[0.0]])
    assert [r.cluster for r in one.assign(df).collect()] == [1, 1, 1]


def test_knowing_the_segment_is_only_a_null_check(spark):
    """Filters on the segment reach the scan as null checks on the inputs."""
    df = blobs(spark)
    model = segment.Segments(["x", "y"], [0.0, 0.0], [1.0, 1.0], [[0.0, 0.0], [1.0, 1.0]])
    plan = model.assign(df).where("segment is not null").select("row_key")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(x" in text and "concat" not in text


def test_a_step_equals_plain_arithmetic_for_all_sets_of_centres(spark):
    import numpy as np

    r = np.random.default_rng(3)
    points, centres = r.normal(size=(300, 3)), r.normal(size=(5, 4, 3))
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "z0 double, z1 double, z2 double").repartition(3)
    sums, counts, cost = segment._step(df, centres)
    far = ((points[None, :, None] - centres[:, None]) ** 2).sum(axis=3)
    for i in range(5):
        label = far[i].argmin(axis=1)
        assert counts[i].tolist() == [(label == j).sum() for j in range(4)]
        assert np.allclose(sums[i], [points[label == j].sum(axis=0) for j in range(4)])
        assert cost[i] == pytest.approx(far[i].min(axis=1).sum())


def test_starts_are_different_rows_whatever_the_order(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(1000)], "z0 double")
    assert sorted(segment._starting_rows(df, 50, 1)) == [(0.0,), (1.0,), (2.0,)]
    many = spark.range(5000).selectExpr("double(id) AS z0")
    assert segment._starting_rows(many.repartition(7), 20, 1) == segment._starting_rows(many.coalesce(1), 20, 1)
    # More segments than different rows: as many as there are.
    assert len(segment.fit_segments(df.withColumnRenamed("z0", "x"), k=5, restarts=2).centres) == 3


def test_a_centre_without_rows_stays(spark):
    import numpy as np

    df = spark.createDataFrame([(0.0,), (1.0,)], "z0 double")
    centres, steps = segment._at_rest(df, np.array([[[0.4], [99.0]]]), 1e-4, 10)
    assert centres.tolist() == [[[0.5], [99.0]]] and steps == [2]


@pytest.mark.parametrize("k", [33, 1000])
def test_many_centres_equal_brute_force(spark, k):
    import numpy as np

    r = np.random.default_rng(k)
    centres = r.normal(size=(k, 2)).round(2)
    centres[7] = centres[3]  # a tie, which the lower id takes
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([r.normal(size=(150, 2)) * 2, centres[:8]]))] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "row_key long, x double, y double")
    model = segment.Segments(["x", "y"], [0.5, -0.25], [2.0, 0.5], centres.tolist())
    got = model.assign(df, keep_distance=True)
    assert got.columns == ["row_key", "x", "y", "cluster", "segment", "distance"]
    found = {r.row_key: r for r in got.collect()}
    assert found[999].cluster is None and found[999].segment is None and found[999].distance is None
    for i, x, y in rows[:-1]:
        z = ((x - 0.5) / 2.0, (y + 0.25) / 0.5)
        far = (z[0] - centres[:, 0]) ** 2 + (z[1] - centres[:, 1]) ** 2
        assert found[i].cluster == int(far.argmin()) + 1 and found[i].distance == pytest.approx(far.min(), abs=1e-12)


def test_a_tie_counts_for_the_first_centre_alone_and_steps_read_packed_rows(spark):
    import numpy as np

    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (0.5, 1.0)] * 1_000, "z0 double, z1 double").coalesce(1)
    packed = segment._packed(df)
    assert sorted(map(len, packed.collect())) == [1_000 * 16, segment.PACK * 16]
    centres = np.array([[[0.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]])
    sums, counts, cost = segment._step(packed, centres)
    assert counts.tolist() == [[2_000, 1_000], [3_000, 0]]
    assert sums.tolist() == [[[500.0, 2_000.0], [1_000.0, 1_000.0]], [[1_500.0, 3_000.0], [0.0, 0.0]]]
    assert cost.tolist() == [250.0, 1_250.0]
