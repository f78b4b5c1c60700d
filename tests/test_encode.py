import math

import pytest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions import features
from basketlens.operators import encode, predict
from basketlens.sources.files import stringify_nested


def words(spark, n=300):
    return spark.range(n).select(
        "id",
        F.format_string("w%03d", F.col("id") * 7 % 101).alias("w"),
        F.when(F.col("id") % 5 != 0, F.format_string("g%d", F.col("id") % 3)).alias("g"),
    )


def test_unseen_and_null_become_zero_vectors(spark):
    train = spark.createDataFrame([("a", 1), ("b", 2)], "c string, k long")
    every = spark.createDataFrame([("a", 1), ("b", 2), ("new", 3), (None, 4)], "c string, k long")
    dictionary = encode.fit_dictionary(train, ["c"])
    out = dictionary.one_hot(every).select("k", vector_to_array("c").alias("v"))
    got = {r.k: list(r.v) for r in out.collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    index = {r.k: r.c_index for r in dictionary.index_int(every).collect()}
    assert index == {1: 0, 2: 1, 3: -1, 4: -1}


def test_null_can_be_a_category(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "c string, k long")
    dictionary = encode.fit_dictionary(df, ["c"], null_slot=True)
    every = df.union(spark.createDataFrame([("(missing)", 3)], df.schema))
    assert dictionary.widths == {"c": 2}
    assert {r.k: r.c_index for r in dictionary.index_int(every).collect()} == {1: 0, 2: 1, 3: -1}


def test_columns_of_different_width(spark):
    """The unseen index is each column's own width, whatever the widest column is."""
    df = words(spark)
    dictionary = encode.fit_dictionary(df.where("id < 90"), ["w", "g"])
    got = dictionary.index(df).agg(F.max("w_index"), F.max("g_index")).first()
    assert tuple(got) == (dictionary.widths["w"], dictionary.widths["g"]) == (90, 3)


def test_indexes_are_places_in_the_sorted_values(spark):
    df = words(spark)
    train = df.where("id < 250")
    dictionary = encode.fit_dictionary(train, ["w", "g"])
    places = {c: {v: i for i, v in enumerate(sorted({r[c] for r in train.collect()} - {None}))} for c in ("w", "g")}
    want = sorted((r.id, places["w"].get(r.w, -1), places["g"].get(r.g, -1)) for r in df.collect())
    assert sorted(map(tuple, dictionary.index_int(df).select("id", "w_index", "g_index").collect())) == want
    hot = dictionary.one_hot(df).select(F.sum(F.array_position(vector_to_array("w"), 1.0) - 1)).first()[0]
    assert hot == sum(i for _, i, _ in want if i >= 0)


def test_table_dictionary_survives_a_hot_value(spark, eager_skew_splits):
    """A third of all rows share one value and a third are null; nothing is lost."""
    df = spark.range(60_000).select(
        "id",
        F.sha1(F.col("id").cast("string")).alias("rest"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id")).alias("c"),
    )
    dictionary = encode.fit_dictionary(df, ["c"])
    out = dictionary.index_int(df)
    rows = out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == len({r.id for r in rows}) == 60_000 and dictionary.widths["c"] == 20_001
    assert sum(r.c_index == 0 for r in rows) == sum(r.c_index == -1 for r in rows) == 20_000


def test_split_is_complete_disjoint_and_stable(spark):
    df = spark.range(20_000)
    train, test = encode.split(df, "id")
    assert train.count() + test.count() == 20_000
    assert train.join(test, "id").count() == 0
    assert abs(train.count() / 20_000 - 0.8) < 0.01
    again, _ = encode.split(df.repartition(5), "id")
    assert again.exceptAll(train).count() == 0


@pytest.mark.parametrize("key", ["id * 2500", "id * 10000", "concat('C-', id)"])
def test_split_of_structured_and_text_keys(spark, key):
    df = spark.range(20_000).select(F.expr(key).alias("k.y"))
    train, _ = encode.split(df, "k.y")
    assert abs(train.count() / 20_000 - 0.8) < 0.01
    other, _ = encode.split(df, "k.y", seed=7)
    assert 0.6 < train.intersect(other).count() / 20_000 < 0.68
    half, _ = encode.split(df, "k.y", share=0.5)
    assert abs(half.count() / 20_000 - 0.5) < 0.015


def test_null_keys_are_not_lost_in_the_split(spark):
    df = spark.createDataFrame([(None,), (1,)], "id long")
    train, test = encode.split(df, "id")
    assert train.count() + test.count() == 2


def test_standardizer_matches_the_ml_scaler(spark):
    df = spark.range(100).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 7).alias("y"), F.lit(3.0).alias("k"))
    ours = encode.fit_standardizer(df, ["x", "y", "k"]).transform(df)
    vectors = VectorAssembler(inputCols=["x", "y", "k"], outputCol="v").transform(df)
    scaler = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(vectors)
    theirs = [list(r.s) for r in scaler.transform(vectors).select(vector_to_array("s").alias("s")).collect()]
    mine = [[r.x_scaled, r.y_scaled, r.k_scaled] for r in ours.collect()]
    for a, b in zip(mine, theirs):
        assert a == pytest.approx(b)
    assert all(r[2] == 0.0 for r in mine)


def test_standardizer_is_fitted_on_train_only_and_skips_nan(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,), (math.nan,)], "x double")
    standard = encode.fit_standardizer(train, ["x"])
    assert standard.means["x"] == 2.0 and standard.deviations["x"] == pytest.approx(math.sqrt(2))
    test = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert [r[0] for r in standard.replace(test).collect()] == [0.0, None]


def test_vectors_are_made_once_per_value_and_not_once_per_row(spark):
    """No vector is made or turned into text on the rows themselves, and each row still gets its own."""
    df = words(spark)
    train = df.where("id < 90")
    for null_slot in (False, True):
        dictionary = encode.fit_dictionary(train, ["w", "g"], null_slot)
        plain = dictionary.one_hot(df, "_y").collect()
        text = dictionary.one_hot(df, "_y", then=stringify_nested)
        assert [f.name for f in text.schema.fields] == ["id", "w_y", "g_y", "w", "g"]
        assert {r.id: (r.w_y, r.g_y, r.w, r.g) for r in text.collect()} == {
            r.id: (r.w_y, r.g_y, *[json_text(v) for v in (r.w, r.g)]) for r in plain
        }
        slots = dictionary.one_hot(df, then=predict.first_slots).collect()
        want = {r.id: tuple(float(v.toArray()[0]) if v.size else 0.0 for v in (r.w, r.g)) for r in plain}
        assert {r.id: (r.w, r.g) for r in slots} == want
        plan = text._jdf.queryExecution().optimizedPlan().toString()
        first_join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
        on_rows = "\n".join(line for line in plan.splitlines()[:first_join] if not line.lstrip().startswith(":"))
        assert "coalesce" in on_rows and "UDF" not in on_rows and "json" not in on_rows.lower()


def json_text(v):
    hot = ",".join(str(i) for i in v.indices), ",".join(str(float(x)) for x in v.values)
    return '{"type":0,"size":%d,"indices":[%s],"values":[%s]}' % (v.size, *hot)


def test_vector_head_of_sparse_dense_empty_and_null(spark):
    some = [Vectors.sparse(3, [0], [2.0]), Vectors.sparse(3, [2], [1.0]), Vectors.sparse(0, [], []), Vectors.dense([5.0, 6.0]), Vectors.dense([]), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(some)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", VectorUDT())]))
    got = {r.i: r.h for r in df.select("i", features.vector_head(F.col("v")).alias("h")).collect()}
    assert got == {0: [2.0], 1: [0.0], 2: [], 3: [5.0], 4: [], 5: None}
