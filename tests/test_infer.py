import pytest
from pyspark.sql import functions as F

from basketlens.sources import files, infer
from basketlens.sources.infer import column_types, read_inferred

CASES = {
    "int": ["1", "-2", "+3", None],
    "bigint": ["1", "3000000000"],
    "double": ["1", "2.5", "1e9", ".5", "NaN"],
    "date": ["2024-02-29", "1999-12-31"],
    "timestamp": ["2024-02-29", "2024-02-29 10:11:12.5", "2024-02-29T10:11:12Z"],
    "boolean": ["true", "FALSE", None],
    "string": ["1", "x"],
    "none": [None],
    "day of no month": ["2024-02-30"],
    "long number": ["99999999999999999999"],
    "odd.name": ["Yes", "No"],
}
WANT = {"none": "string", "day of no month": "string", "long number": "double", "odd.name": "string"}


def texts(spark, cases=CASES):
    n = max(map(len, cases.values()))
    rows = [tuple(v[i] if i < len(v) else v[-1] for v in cases.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cases))


def test_the_narrowest_type_that_holds_all_cells(spark):
    got = {r.column: r for r in column_types(texts(spark)).collect()}
    assert {c: r.type for c, r in got.items()} == {c: WANT.get(c, c) for c in CASES}
    assert got["none"].n == 0 and all(r.n_unfit == 0 for r in got.values())


@pytest.mark.parametrize("parts", [1, 4])
def test_a_share_of_cells_may_not_fit_and_is_counted(spark, parts, tmp_path):
    df = spark.range(200).select(F.when(F.col("id") % 50 == 0, "-").otherwise(F.col("id").cast("string")).alias("a b"), F.lit("NA").alias("c"))
    path = files.write_table(df.repartition(parts), str(tmp_path / "x"), "csv")
    table, found = read_inferred(spark, path, "NA", most_unfit=0.02)
    assert [(r.column, r.type, r.n, r.n_unfit) for r in found.orderBy("place").collect()] == [("a b", "int", 200, 4), ("c", "string", 0, 0)]
    assert table.schema.simpleString() == "struct<a b:int,c:string>"
    assert table.where("`a b` is null").count() == 4
    assert read_inferred(spark, path, "NA")[0].schema["a b"].dataType.simpleString() == "string"


def test_types_need_one_scan(spark):
    plan = column_types(texts(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Window" not in plan


def test_no_rows(spark):
    assert {r.type for r in column_types(texts(spark).limit(0)).collect()} == {"string"}


def test_the_types_that_were_found_are_not_searched_for_again(spark, tmp_path):
    """The table of types is read off the rows that typed the table, without another scan of the files."""
    path = files.write_table(texts(spark), str(tmp_path / "x"), "csv")
    found = read_inferred(spark, path)[1]
    assert "csv" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_odd_cells_fit_as_their_own_tests_say(spark):
    """Counts of the cells each type holds, one type at a time, beside the class of each cell."""
    cells = ["", " 1", "1 ", "1\n", "+", "-1", "1.", ".", ".5", "1e5", "Infinity", "-Infinity", "NaN", "nan", "0x1", "2147483648", "9" * 19, "9" * 18,
             "2024-01-01", "2024-13-01", "2024-01-01 10:00", "2024-01-01T25:00", "0000-01-01", "10000-01-01", "TRUE", "tRue", "t", "false ", "Fall", "Next", "٣", None]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    c = F.col("cell")
    whole = c.rlike(r"^[+-]?\d+$")
    fits = {
        "int": whole & c.try_cast("int").isNotNull(),
        "bigint": whole & c.try_cast("bigint").isNotNull(),
        "double": c.rlike(infer._NUMBER),
        "date": c.rlike(infer._DAY) & c.try_cast("date").isNotNull(),
        "timestamp": (c.rlike(infer._DAY) | c.rlike(infer._MOMENT)) & c.try_cast("timestamp").isNotNull(),
        "boolean": F.lower(c).isin("true", "false"),
    }
    for r in df.where("cell is not null").select("cell", infer._narrowest(c).alias("kind"), *[x.alias(k) for k, x in fits.items()]).collect():
        kind = infer._KINDS[r.kind] if r.kind < len(infer._KINDS) else None
        assert {k for k in fits if r[k]} == {k for k, held in infer._HOLDS.items() if kind in held}, r.cell
