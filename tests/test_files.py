import re

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from basketlens import session
from basketlens.schema import RETAIL
from basketlens.sources import files


def test_csv_null_text(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('s,n\nNA,1\n"",2\nx,NA\n')
    df = files.read_csv(spark, str(path), null_text="NA")
    assert dict(df.dtypes)["n"] == "int"
    assert [r.n for r in df.collect()] == [1, 2, None]
    assert df.where("s is null and n = 1").count() == 1
    plain = files.read_csv(spark, str(path))
    assert dict(plain.dtypes)["n"] == "string"


def test_csv_with_a_schema(spark, tmp_path):
    path = tmp_path / "shop.csv"
    header = [f.name for f in RETAIL.fields]
    path.write_text(",".join(header) + "\n" + ",".join(["1", "30"] + ["x"] * 3 + ["20.5"] + ["x"] * 4 + ["3.5"] + ["x"] * 5 + ["4", "x"]) + "\n")
    row = files.read_csv(spark, str(path), RETAIL).first()
    assert (row.customer_id, row.age, row.purchase_amount, row.review_rating, row.previous_purchases) == (1, 30, 20.5, 3.5, 4)


def test_row_ids_are_consecutive_over_many_files(spark):
    df = spark.range(0, 10_007, 1, 13).select((F.col("id") * 7 % 11).alias("v"))
    got = files.with_row_id(df).agg(
        F.count("id"), F.count_distinct("id"), F.min("id"), F.max("id"), F.sum("v")
    ).first()
    assert tuple(got)[:4] == (10_007, 10_007, 1, 10_007)
    assert got[4] == df.agg(F.sum("v")).first()[0]


def test_row_ids_do_not_change_between_reads(spark):
    df = files.with_row_id(spark.range(0, 1_000, 1, 7).withColumnRenamed("id", "v"))
    first = {r.v: r.id for r in df.collect()}
    assert first == {r.v: r.id for r in df.repartition(3).collect()}


def test_positions_follow_the_numbers_of_the_files_and_foreign_names_are_refused(spark, tmp_path):
    for folder, names in (("a", ["part-100000-u-c000", "part-99999-u-c001", "part-99999-u-c000"]), ("b", ["rows"])):
        (tmp_path / folder).mkdir()
        for i, name in enumerate(names):
            spark.range(10 * i, 10 * i + 3).coalesce(1).write.parquet(str(tmp_path / folder / f"w{i}"))
            part = next((tmp_path / folder / f"w{i}").glob("part-*.parquet"))
            (tmp_path / f"{folder}-out").mkdir(exist_ok=True)
            (tmp_path / f"{folder}-out" / f"{name}.parquet").write_bytes(part.read_bytes())
    got = files.written_positions(spark, str(tmp_path / "a-out")).orderBy("position").collect()
    assert [r.id for r in got] == [20, 21, 22, 10, 11, 12, 0, 1, 2] and [r.position for r in got] == list(range(9))
    with pytest.raises(Exception, match="no place in the name"):
        files.written_positions(spark, str(tmp_path / "b-out")).collect()


def test_row_ids_over_thousands_of_files(spark):
    df = spark.range(0, 6_000, 1, 2_000)
    got = files.with_row_id(df.withColumnRenamed("id", "v.x")).agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (6_000, 1, 6_000)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Purchase.Amount..USD.", "Customer.ID", "a b"])
    cleaned, mapping = files.clean_names(df)
    assert cleaned.columns == ["Purchase Amount  USD ", "Customer ID", "a b"]
    assert mapping["Customer.ID"] == "Customer ID"


def test_display_names_round_trip_and_collision(spark):
    df = spark.createDataFrame([(1, 2.0, 1, 0, 1)], "customer_id int, purchase_amount double, category_SMALL int, size_small int, season_Fall int")
    shown = files.to_display_names(df)
    assert shown.columns == ["Customer ID", "Purchase Amount (USD)", "category_SMALL", "Prefers_Small", "Shops_Fall"]
    assert files.from_display_names(shown).columns[:2] == ["customer_id", "purchase_amount"]


def test_nested_columns_become_text(spark, tmp_path):
    rows = [(1, [1, 0], Vectors.sparse(3, [1], [1.0])), (2, [], Vectors.sparse(3, [], []))]
    df = spark.createDataFrame(rows, ["k", "a", "v"])
    path = files.write_table(df, str(tmp_path / "out"), "csv")
    rows = {r.k: r for r in files.read_csv(spark, path).collect()}
    assert rows[1].a == "[1,0]"
    assert rows[1].v == '{"type":0,"size":3,"indices":[1],"values":[1.0]}'
    assert rows[2].v == '{"type":0,"size":3,"indices":[],"values":[]}'
    with pytest.raises(ValueError):
        files.write_table(df, str(tmp_path / "x"), "xls")


def test_feature_set_without_customer_gets_ids(spark):
    df = spark.range(5).select(F.col("id").alias("age"), F.lit("Segment 1").alias("segment"))
    got = files.feature_set(df, ["age"])
    assert got.columns == ["id", "segment", "age"]
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5]


class Cluster:
    """The parts of a session that choosing the work folder looks at."""

    def __init__(self, **settings):
        self.conf, self.sparkContext = settings, self
        self.master = "spark://head:7077"


def test_work_folder_is_named_by_the_session():
    cluster = Cluster(**{"spark.checkpoint.dir": "hdfs://store/work"})
    assert session.work_path(cluster, "t").startswith("hdfs://store/work/t-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_path(Cluster(), "t")


def test_positions_over_thousands_of_files_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of tasks are summed apart, so no window runs over all files."""
    monkeypatch.setattr(files, "FILE_BLOCK", 100)
    path = str(tmp_path / "many")
    spark.range(0, 4000, 1, 2000).write.option("maxRecordsPerFile", 1).parquet(path)
    got = files.written_positions(spark, path)
    assert got.where("position != id").count() == 0 and got.count() == 4000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_block" in plan and "windowspecdefinition(_place" not in plan


def test_a_job_id_may_look_like_the_number_of_a_file(spark, tmp_path):
    """A task with several files, and a job id with a group that begins with c and digits."""
    spark.range(0, 40, 1, 2).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "many"))
    for f in (tmp_path / "many").glob("*part-*"):
        f.rename(f.with_name(re.sub(r"(part-\d+-).*(-c\d+)", r"\g<1>8f14e45f-c123-4a5b-9c3d-c99988877766\2", f.name)))
    got = files.written_positions(spark, str(tmp_path / "many"))
    assert got.where("position != id").count() == 0 and got.count() == 40


def test_encoded_rows_take_little_room_as_csv(spark, tmp_path):
    """One-hot vectors repeat the same text in every row: compressed, they are read back as they were."""
    hot = spark.range(0, 4_000, 1, 2).select("id", F.array(F.lit(5.0), (F.col("id") % 7).cast("double")).alias("v"))
    size = {}
    for codec in (None, "gzip"):
        path = tmp_path / str(codec)
        back = files.read_csv(spark, files.write_table(hot, str(path), "csv", compression=codec), files.stringify_nested(hot).schema)
        assert back.exceptAll(files.stringify_nested(hot)).count() == 0 and back.count() == 4_000
        size[codec] = sum(f.stat().st_size for f in path.iterdir())
    assert size["gzip"] * 3 < size[None]
