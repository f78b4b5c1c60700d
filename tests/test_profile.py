import math

from pyspark.sql import functions as F

from basketlens.operators import profile

NAN = math.nan


def frame(spark):
    rows = [("a", 1, 1.0), ("a", 2, NAN), (None, 2, None), ("b", None, 0.0), ("b", 3, -0.0)]
    return spark.createDataFrame(rows, "s string, i int, x double")


def test_shape_and_head(spark):
    df = frame(spark)
    assert tuple(profile.shape(df).first()) == (5, 3, "s,i,x")
    assert [r.i for r in profile.head(df, 2, ["i", "s", "x"]).collect()] == [None, 1]


def test_missing_counts_null_and_nan(spark):
    assert profile.missing_counts(frame(spark)).first().asDict() == {"s": 1, "i": 1, "x": 2}


def test_dotted_names(spark):
    df = frame(spark).withColumnRenamed("x", "x.y")
    assert profile.missing_counts(df).first().asDict() == {"s": 1, "i": 1, "x.y": 2}
    assert profile.complete_cases(df, ["i", "x.y"]).count() == 2
    assert {r["x.y"] for r in profile.value_counts(df, "x.y").collect()} >= {1.0, 0.0}


def test_missing_handles_text_without_casting(spark):
    df = spark.createDataFrame([("12abc",), (None,)], "s string")
    assert profile.missing_counts(df).first().asDict() == {"s": 1}


def test_distinct_counts_equal_the_builtin(spark):
    df = frame(spark)
    want = df.agg(*[F.count_distinct(c).alias(f"{c}_unique") for c in df.columns]).first().asDict()
    assert profile.distinct_counts(df).first().asDict() == want


def test_distinct_of_an_empty_table(spark):
    got = profile.distinct_counts(frame(spark).limit(0)).first().asDict()
    assert got == {"s_unique": 0, "i_unique": 0, "x_unique": 0}


def test_approximate_distinct_is_close(spark):
    df = spark.range(20_000).select((F.col("id") % 7_000).alias("k"), (F.col("id") / 3).alias("x"))
    got = profile.distinct_counts_approx(df).first()
    assert abs(got.k_unique - 7_000) < 350 and abs(got.x_unique - 20_000) < 1_000


def test_distinct_counts_shuffle_no_text_of_numbers(spark, tmp_path):
    spark.range(1_000).selectExpr("id", "id % 7 AS `few.x`", "cast(id % 5 AS string) AS s", "array(id % 3) AS a", "map(id % 4, 1) AS m", "if(id = 0, -0.0D, 0.0D) AS z").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = profile.distinct_counts(df, written=True)
    assert tuple(found.first()) == tuple(profile.distinct_counts(df).first()) == (1_000, 7, 5, 3, 4, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "cast(id" not in plan


def test_distinct_counts_read_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(0, 500, 1, 2).selectExpr("id % 9 AS a", "id % 11 AS b", "cast(NULL AS string) AS c").mapInArrow(seen, "a bigint, b bigint, c string")
    assert tuple(profile.distinct_counts(df).first()) == (9, 11, 0) and read.value == 500


def test_describe_matches_the_builtin(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "i int, s string")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    want = {r["summary"]: r for r in df.describe().collect()}
    assert got["i"]["mean"] == float(want["mean"]["i"])
    assert got["i"]["stddev"] == float(want["stddev"]["i"])
    assert (got["s"]["count"], got["s"]["min"], got["s"]["max"], got["s"]["mean"]) == (2, "a", "b", None)


def test_complete_cases(spark):
    assert profile.complete_cases(frame(spark), ["i", "x"]).count() == 2


def test_schema_and_values(spark):
    df = frame(spark)
    assert [tuple(r) for r in profile.schema_listing(df).collect()] == [
        (0, "s", "string", 4), (1, "i", "int", 4), (2, "x", "double", 4),
    ]
    assert {tuple(r) for r in profile.value_counts(df, "s").collect()} == {("a", 2), ("b", 2)}


def test_united_sketches_equal_one_over_the_whole(spark):
    df = spark.range(20_000).selectExpr("id", "id % 37 AS few", "cast(null AS string) AS `no.ne`", "double(id % 5) AS x")
    parts = profile.distinct_sketches(df, (F.col("id") % 11).alias("part"))
    united = profile.united_counts(parts, df.columns).first()
    whole = profile.distinct_counts_approx(df).first()
    exact = profile.distinct_counts(df).first()
    for c in ("id_unique", "few_unique", "no.ne_unique", "x_unique"):
        assert abs(united[c] - exact[c]) <= profile.SKETCH_ERROR * exact[c] >= abs(whole[c] - exact[c])
    assert united["few_unique"] == 37 and united["no.ne_unique"] == 0
