from pyspark.sql import functions as F

from basketlens.operators import report, summary
from basketlens.plans.features import add_features, flag_table
from test_report import small


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_every_section_equals_the_report_made_of_columns(spark):
    wide = add_features(small(spark)).df
    want = report.segment_report(wide)
    got = summary.sections(summary.facts(add_features(small(spark), sparse=True).df))
    assert list(got) == list(want)
    for title in ("counts", "profile", "size"):
        name = report.SECTIONS[title]
        columns = want[name].columns
        assert rows(got[name].select(columns)) == rows(want[name])
    for title, family in (("category", "category"), ("season", "season")):
        turned = {(s, r[family]): r[s] for r in got[report.SECTIONS[title]].collect() for s in ("Segment 1", "Segment 3")}
        plain = {(r.segment, c): r[c] for r in want[report.SECTIONS[title]].collect() for c in r.asDict() if c != "segment"}
        assert turned == plain


def test_one_scan_of_the_data(spark, data):
    df = spark.read.parquet(f"{data}/customer.parquet").select(
        F.lit("Segment 1").alias("segment"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("string").alias("season")
    )
    found = summary.facts(df)
    for table in summary.sections(found).values():
        assert "customer.parquet" not in table._jdf.queryExecution().toString()
    assert found.agg(F.sum("n")).first()[0] == df.count()


def test_lines_are_in_order_and_whole(spark):
    got = [r.value for r in summary.lines(summary.sections(summary.facts(small(spark)))).collect()]
    titles = [x for x in got if x.endswith(":")]
    assert titles == [f"{t}:" for t in report.SECTIONS.values()]
    at = got.index("CATEGORY PREFERENCES BY SEGMENT:")
    assert got[at + 1].split("  ")[0] == "category" and got[at + 2].startswith("Clothing") and got[at + 3].startswith("Shoes")


def test_no_rows_and_no_segments(spark):
    empty = summary.sections(summary.facts(small(spark).limit(0)))
    assert [len(t.collect()) for t in empty.values()] == [4, 0, 0, 0, 0]
    assert len(summary.lines(empty).collect()) == 5 * 3 + 4


def test_sparse_flags_never_share_a_name(spark):
    values = ["a b", "a_b", "a%5Fb", "a%b", "Small", "SMALL", "", None]
    df = spark.createDataFrame([(v,) for v in values], "category string")
    made = add_features(df, sparse=True)
    flags = [r.flags_category for r in made.df.collect()]
    assert flags[-1] is None and all(list(f.values()) == [1] for f in flags[:-1])
    assert len({k for f in flags[:-1] for k in f}) == 7
    assert "a_b" in flags[0] and made.groups["category"] == ["flags_category", "category"]
    assert {r.name: r.n for r in flag_table(df, "category").collect()} == {k: 1 for f in flags[:-1] for k in f}
