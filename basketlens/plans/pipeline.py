"""End to end, from a flat table: segments with features and a report (``run``), encoded training and test rows
(``preprocess``), and forests for every attribute (``model``)."""

from pyspark.sql import DataFrame, SparkSession

from basketlens.operators import predict, profile, summary
from basketlens.operators.report import report_text, segment_report, shares_any
from basketlens.operators.segment import Segments, fit_segments
from basketlens.plans.features import add_features, flag_table
from basketlens.schema import has
from basketlens.sources.files import save_feature_sets, stringify_nested, to_display_names, write_table


def run(
    df: DataFrame,
    out_dir: str,
    k: int = 4,
    restarts: int = 25,
    segments: Segments | None = None,
    fmt: str = "parquet",
    flags: bool = False,
    values: dict[str, list[str]] | None = None,
) -> dict[str, str]:
    """Segment, derive features, write everything under ``out_dir``; returns the paths.

    The segmented base table is written first and everything later reads it back, so
    the joins behind ``df`` run once for the model and once for the table.  The input
    is never written over.  For any number of categories and seasons, their flags are one map per
    family (``{family}_flag_names`` lists the names), their shares are tables in long form, and the
    report has all five sections, with a line per value.  ``flags`` makes one column per value
    instead, for callers who name the values: ``values`` has a list each for ``category`` and ``season``.
    """
    spark: SparkSession = df.sparkSession
    named = values or {}
    if flags and (unnamed := [c for c in ("category", "season") if has(df, c) and c not in named]):
        raise ValueError(f"flags need the values of {', '.join(unnamed)}")
    model = segments or fit_segments(df, k=k, restarts=restarts)
    groups = len(model.centres)
    base_path = write_table(model.assign(df), f"{out_dir}/segmented")
    base = spark.read.parquet(base_path)
    featured = add_features(base, named.get("category"), named.get("season"), sparse=not flags)
    paths = save_feature_sets(featured.df, featured.groups, f"{out_dir}/features", fmt)
    if fmt == "csv":
        paths["segmented_csv"] = write_table(to_display_names(base), f"{out_dir}/segmented_csv", "csv")
    summary_path = f"{out_dir}/segment_summary"
    if flags:
        text = report_text(segment_report(featured.df, groups))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(summary_path)
        return paths | {"segmented": base_path, "report": summary_path}
    found = summary.facts(featured.df)
    for column in [c for c in ("category", "season") if has(base, c)]:
        paths[f"{column}_preferences"] = write_table(shares_any(base, column, groups), f"{out_dir}/{column}_preferences", fmt)
        paths[f"{column}_flag_names"] = write_table(flag_table(base, column), f"{out_dir}/{column}_flag_names", fmt)
    summary.lines(summary.sections(found, groups)).select("value").write.mode("overwrite").text(summary_path)
    return paths | {"segmented": base_path, "report": summary_path}


def preprocess(df: DataFrame, out_dir: str, key: str, fmt: str = "csv", preview: int = 10) -> dict[str, str]:
    """Profile the table, then bin, split, encode and standardise it; writes everything, returns the paths.

    ``key`` is the column whose value decides between training and test rows.  The profile has the shape, first
    rows, schema, description, distinct and missing counts, a table each.
    """
    tables = {
        "shape": profile.shape(df),
        "head": profile.head(df, preview, df.columns),
        "schema": profile.schema_listing(df),
        "describe": profile.describe(df),
        "distinct": profile.distinct_counts(df),
        "missing": profile.missing_counts(df),
    }
    paths = {name: write_table(table, f"{out_dir}/profile/{name}", fmt) for name, table in tables.items()}
    made = predict.prepare(df, key, then=stringify_nested if fmt == "csv" else None)
    parts = {"train": made.train, "test": made.test}
    return paths | {name: write_table(part, f"{out_dir}/{name}", fmt) for name, part in parts.items()}


def model(
    df: DataFrame, out_dir: str, key: str, targets: list[str] | None = None, flatten: bool = True, fmt: str = "csv", **forest
) -> dict[str, str]:
    """One forest per attribute on all others, scored on the test rows; writes (target, metric, value).

    By default an attribute stands for its first slot ("is it category 0?"), as a feature and as
    a label; ``flatten=False`` predicts the category itself from whole vectors.
    """
    scores = predict.predict_all_targets(df, targets, key, flatten, **forest)
    return {"metrics": write_table(scores, f"{out_dir}/metrics", fmt)}
