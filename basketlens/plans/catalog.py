"""Registered queries: each takes (spark, folder of tables) and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions import bins, features
from basketlens.operators import encode, predict, profile, report, segment, summary
from basketlens.plans import pipeline
from basketlens.plans.features import add_features, add_flags, add_value_score, flag_table, levels
from basketlens.schema import (
    CATEGORY_FLAG,
    DISPLAY_NAMES,
    RETAIL,
    ROW_KEY,
    SEASON_FLAG,
    SEGMENT,
    numeric_columns,
)
from basketlens.session import work_path
from basketlens.sources.files import (
    clean_names,
    feature_set,
    materialised,
    read_csv,
    stringify_nested,
    with_row_id,
    write_table,
)
from basketlens.sources.infer import read_inferred
from basketlens.sources.shop import shop

Query = Callable[[SparkSession, str], DataFrame]

# Reference centres, so that segment reports can be compared exactly.
FROZEN = segment.Segments(
    columns=["age", "purchase_amount", "review_rating", "previous_purchases"],
    shift=[47.0, 53.0, 3.0, 5.0],
    scale=[19.0, 30.0, 1.2, 4.0],
    centres=[
        [-0.83, -0.71, 0.11, -0.07],
        [0.79, -0.87, -0.13, 0.19],
        [-0.77, 0.91, 0.05, 0.23],
        [0.89, 0.73, -0.17, -0.29],
    ],
)

CATEGORICAL = [f.name for f in RETAIL.fields if f.name not in ("customer_id", "review_rating")]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _shop(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return shop(spark, d, [ROW_KEY, *columns] if columns else None)


def _segmented(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows with their segment by the fixed centres, and the columns asked for."""
    needed = list(dict.fromkeys([*FROZEN.columns, *columns]))
    return FROZEN.assign(_shop(spark, d, *needed))


# --- sources and sinks ----------------------------------------------------------------


@query
def src_csv_roundtrip(spark, d):
    table = _shop(spark, d)
    path = write_table(table, work_path(spark, "csv"), "csv", null_text="NA")
    return read_csv(spark, path, table.schema, null_text="NA")


@query
def src_csv_inferred(spark, d):
    """A CSV without a given schema: the types come from its cells."""
    path = write_table(_shop(spark, d), work_path(spark, "csv"), "csv", null_text="NA")
    return read_inferred(spark, path, null_text="NA")[0]


@query
def csv_types(spark, d):
    """The types found, where one cell in a hundred may not fit; the age has some."""
    odd = F.when(F.col(ROW_KEY) % 211 == 0, F.lit("n. a.")).otherwise(F.col("age").cast("string"))
    path = write_table(_shop(spark, d).withColumn("age", odd), work_path(spark, "csv"), "csv", null_text="NA")
    return read_inferred(spark, path, null_text="NA", most_unfit=0.01)[1].drop("place")


@query
def row_id_generated(spark, d):
    no_id = shop(spark, d, [f.name for f in RETAIL.fields if f.name != "customer_id"])
    return with_row_id(no_id).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_distinct"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )


# The columns each feature group is made from.
GROUP_INPUTS = {
    "demographic": ["age", "gender", "location"],
    "value": ["purchase_amount", "previous_purchases"],
    "purchase_behavior": [
        "frequency_of_purchases", "discount_applied", "promo_code_used",
        "subscription_status", "review_rating",
    ],
    "category": ["category", "item_purchased"],
    "seasonal": ["season"],
    "preference": ["payment_method", "shipping_type", "size_label", "color"],
}


def _feature_set(group: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        inputs = GROUP_INPUTS[group]
        table = _segmented(spark, d, "customer_id", *inputs)
        if group == "value":
            made = add_features(table)
        else:
            made = add_features(table.drop(*[c for c in FROZEN.columns if c not in inputs]))
        out = feature_set(made.df, made.groups[group])
        return _round(out, "value_score") if group == "value" else out

    run.__name__ = f"feature_set_{group}"
    return query(run)


for _group in GROUP_INPUTS:
    _feature_set(_group)


@query
def features_all(spark, d):
    made = add_features(_segmented(spark, d, *[f.name for f in RETAIL.fields]))
    path = write_table(_round(made.df, "value_score"), work_path(spark, "features"))
    return spark.read.parquet(path)


@query
def features_missing_cols(spark, d):
    columns = [c for c in (f.name for f in RETAIL.fields) if c not in ("age", "discount_applied")]
    made = add_features(_shop(spark, d, *columns))
    kept = [c for group in made.groups.values() for c in group]
    return _round(made.df.select(ROW_KEY, *kept), "value_score")


@query
def split_export(spark, d):
    """Encoded train and test rows written as CSV, then counted from the files."""
    made = predict.prepare(_shop(spark, d), then=stringify_nested)
    out = None
    for name, part in (("train", made.train), ("test", made.test)):
        path = write_table(part, work_path(spark, name), "csv", compression="gzip")
        back = read_csv(spark, path, stringify_nested(part).schema)
        hot = sum(
            (F.when(F.col(c).contains("[1.0]"), 1).otherwise(0) for c in CATEGORICAL), F.lit(0)
        )
        counted = back.agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("n"),
            F.sum(hot).alias("hot_slots"),
            F.round(F.avg(F.abs("review_rating_scaled")), 6).alias("mean_abs_scaled_rating"),
        )
        out = counted if out is None else out.unionByName(counted)
    return out


# --- profile --------------------------------------------------------------------------


@query
def profile_shape(spark, d):
    return profile.shape(_shop(spark, d))


@query
def profile_head(spark, d):
    table = _shop(spark, d)
    return profile.head(table, 10, table.columns)


@query
def profile_schema(spark, d):
    return profile.schema_listing(_shop(spark, d))


@query
def profile_describe(spark, d):
    return _round(profile.describe(_shop(spark, d)), "mean", "stddev")


@query
def profile_distinct(spark, d):
    return profile.distinct_counts(_shop(spark, d))


@query
def profile_distinct_approx(spark, d):
    return profile.distinct_counts_approx(_shop(spark, d))


@query
def profile_distinct_within(spark, d):
    """Sketches of parts, written and united: whether each estimate is within the stated error of the exact number."""
    table = materialised(_shop(spark, d), "profiled")
    parts = materialised(profile.distinct_sketches(table, (F.col(ROW_KEY) % 7).alias("part")), "sketches")
    united = profile.united_counts(parts, table.columns)
    exact = profile.distinct_counts(table, written=True)
    both = united.select(F.struct("*").alias("near"), exact.select(F.struct("*")).scalar().alias("true"))
    off = {c: F.abs(F.col(f"near.{c}_unique") - F.col(f"true.{c}_unique")) for c in table.columns}
    rows = [F.struct(F.lit(c).alias("column"), (x <= profile.SKETCH_ERROR * F.col(f"true.{c}_unique")).alias("within_error")) for c, x in off.items()]
    return both.select(F.inline(F.array(*rows)))


@query
def profile_nulls(spark, d):
    return profile.missing_counts(_shop(spark, d))


@query
def profile_values(spark, d):
    return profile.value_counts(_shop(spark, d, "category"), "category")


# --- schema edits and filters ---------------------------------------------------------


@query
def clean_names_mapping(spark, d):
    """Dotted header names cleaned; the counts come from the renamed table."""
    table = shop(spark, d, [f.name for f in RETAIL.fields])
    dotted = table.toDF(*[DISPLAY_NAMES[c].translate(str.maketrans(" ()", "...")) for c in table.columns])
    renamed, mapping = clean_names(dotted)
    back = F.create_map(*[F.lit(x) for original, clean in mapping.items() for x in (clean, original)])
    return profile.schema_listing(renamed).select(
        F.element_at(back, F.col("column")).alias("original"), F.col("column").alias("clean"), "non_null"
    )


@query
def filter_complete_cases(spark, d):
    return profile.complete_cases(_shop(spark, d, *FROZEN.columns), FROZEN.columns)


# --- bins and scalar features ---------------------------------------------------------


@query
def bin_generic(spark, d):
    ranges, names = [(0, 25), (30, 60.5), (80, 200)], ["a", "b", "c"]
    binned = bins.closed_bins(F.col("purchase_amount"), ranges, names, invalid="none")
    return _shop(spark, d, "purchase_amount").withColumn("bin", binned)


@query
def bin_age(spark, d):
    return _shop(spark, d, "age").withColumn("bin", bins.age_bin(F.col("age")))


@query
def bin_purchase_amount(spark, d):
    binned = bins.purchase_amount_bin(F.col("purchase_amount"))
    return _shop(spark, d, "purchase_amount").withColumn("bin", binned)


@query
def bin_previous_purchases(spark, d):
    binned = bins.previous_purchases_bin(F.col("previous_purchases"))
    return _shop(spark, d, "previous_purchases").withColumn("bin", binned)


@query
def bin_all(spark, d):
    return predict.bin_columns(_shop(spark, d, *predict.BINS))


@query
def age_group_cut(spark, d):
    group = bins.age_group(F.col("age"))
    return _shop(spark, d, "age").withColumns(
        {"age_group": group, "age_group_order": bins.age_group_order(group)}
    )


@query
def value_score(spark, d):
    return _round(add_value_score(_shop(spark, d, "purchase_amount", "previous_purchases")), "value_score")


@query
def category_flags(spark, d):
    table = _shop(spark, d, "category")
    return add_flags(table, "category", CATEGORY_FLAG, levels(table, "category")["category"])


@query
def category_flags_similar_names(spark, d):
    """Values whose plain flag names would meet: each keeps a flag of its own."""
    similar = F.element_at(F.array(*[F.lit(v) for v in ("a b", "a_b", "Small", "SMALL")]), (F.col(ROW_KEY) % 4 + 1).cast("int"))
    table = _shop(spark, d, "category").withColumn("category", F.when(F.col("category").isNotNull(), similar))
    return add_flags(table, "category", CATEGORY_FLAG, levels(table, "category")["category"])


@query
def season_flags(spark, d):
    table = _shop(spark, d, "season")
    return add_flags(table, "season", SEASON_FLAG, levels(table, "season")["season"])


@query
def flags_sparse(spark, d):
    """The flags of both families as the default run writes them, one row per flag that is 1."""
    table = _shop(spark, d, "category", "season").withColumn("category", F.when(F.col(ROW_KEY) % 3 == 0, "a_b %").otherwise(F.col("category")))
    made = add_features(table, sparse=True).df
    return made.select(ROW_KEY, F.explode(F.map_concat(*[F.coalesce(c, F.create_map().cast("map<string,int>")) for c in ("flags_category", "flags_season")])).alias("name", "flag"))


@query
def flag_names(spark, d):
    table = _shop(spark, d, "category", "season")
    parts = [flag_table(table, c).select(F.lit(c).alias("family"), "name", "value", "n") for c in ("category", "season")]
    return parts[0].unionByName(parts[1])


@query
def purchase_frequency(spark, d):
    yearly = features.purchases_per_year(F.col("frequency_of_purchases"))
    return _shop(spark, d, "frequency_of_purchases").withColumn("purchase_frequency_num", yearly)


@query
def yes_no_encode(spark, d):
    columns = ["subscription_status", "discount_applied", "promo_code_used"]
    return _shop(spark, d, *columns).withColumns({c: features.yes_no(F.col(c)) for c in columns})


@query
def discount_sensitivity(spark, d):
    made = add_features(_shop(spark, d, "discount_applied", "promo_code_used"))
    return made.df.select(ROW_KEY, "discount_applied", "promo_code_used", "discount_sensitivity")


@query
def payment_pref(spark, d):
    flag = features.member_flag(F.col("payment_method"), features.DIGITAL_PAYMENTS)
    return _shop(spark, d, "payment_method").withColumn("digital_payment_pref", flag)


@query
def shipping_pref(spark, d):
    flag = features.member_flag(F.col("shipping_type"), features.FAST_SHIPPING)
    return _shop(spark, d, "shipping_type").withColumn("fast_shipping_pref", flag)


@query
def size_flags(spark, d):
    return _shop(spark, d, "size_label").withColumns(
        {
            "size_small": features.member_flag(F.col("size_label"), features.SMALL_SIZES),
            "size_large": features.member_flag(F.col("size_label"), features.LARGE_SIZES),
        }
    )


# --- encoding, split, scaling ---------------------------------------------------------


def _fitted(spark: SparkSession, d: str, null_slot: bool = False) -> tuple[DataFrame, encode.CategoryDictionary]:
    table = materialised(predict.bin_columns(_shop(spark, d, *CATEGORICAL)), "binned")
    train, _ = encode.split(table, ROW_KEY)
    return table, encode.fit_dictionary(train, CATEGORICAL, null_slot)


@query
def encode_index(spark, d):
    table, dictionary = _fitted(spark, d)
    return dictionary.index_int(table).drop(*CATEGORICAL)


@query
def encode_index_with_null(spark, d):
    """Null as the last category of every column, in the training rows or not."""
    table, dictionary = _fitted(spark, d, null_slot=True)
    return dictionary.index_int(table).drop(*CATEGORICAL)


@query
def encode_onehot(spark, d):
    table, dictionary = _fitted(spark, d)
    return dictionary.one_hot(table, then=stringify_nested)


@query
def first_slot(spark, d):
    table, dictionary = _fitted(spark, d)
    return dictionary.one_hot(table, then=predict.first_slots).select(ROW_KEY, *CATEGORICAL)


@query
def split_counts(spark, d):
    part = F.when(encode.in_train(F.col(ROW_KEY)), "train").otherwise("test").alias("part")
    return _shop(spark, d).groupBy(part).agg(F.count(F.lit(1)).alias("n"))


@query
def scale_rating(spark, d):
    table = _shop(spark, d, "review_rating")
    train, test = encode.split(table, ROW_KEY)
    standard = encode.fit_standardizer(train, ["review_rating"])
    part = F.when(encode.in_train(F.col(ROW_KEY)), "train").otherwise("test")
    return _round(standard.replace(table.withColumn("part", part)), "review_rating_scaled")


@query
def scale_numeric(spark, d):
    table = _shop(spark, d, *FROZEN.columns)
    columns = numeric_columns(table, exclude=(ROW_KEY,))
    complete = profile.complete_cases(table, columns)
    standard = encode.fit_standardizer(complete, columns)
    return _round(standard.replace(complete), *[f"{c}_scaled" for c in columns])


# --- segmentation and prediction ------------------------------------------------------


@query
def kmeans_segments(spark, d):
    table = _shop(spark, d, *FROZEN.columns)
    model = segment.fit_segments(table, k=4, restarts=25, seed=42)
    return report.segment_sizes(model.assign(table)).withColumn("cost", F.lit(model.cost))


@query
def kmeans_invariants(spark, d):
    """What must hold for any solution at rest, from all 25 restarts: every complete row labelled, k segments,
    centres that are the means of their members, a cost that is the sum of the squared distances and
    not above that of the fixed centres on the same rows."""
    return _kmeans_facts(_shop(spark, d, *FROZEN.columns), FROZEN.columns)


@query
def kmeans_with_id_invariants(spark, d):
    """The same with the customer id among the columns."""
    return _kmeans_facts(_shop(spark, d, "customer_id", *FROZEN.columns), None, include_id=True)


def _kmeans_facts(table: DataFrame, columns: list[str] | None, include_id: bool = False) -> DataFrame:
    table = materialised(table, "segment-input")
    model = segment.fit_segments(table, k=4, restarts=25, seed=42, columns=columns, include_id=include_id)
    by = segment.cost_by_segment(table, model).orderBy(SEGMENT).collect()  # k rows
    gaps = [
        abs((row[f"mean_{c}"] - model.shift[i]) / model.scale[i] - centre[i])
        for row, centre in zip(by, model.centres)
        for i, c in enumerate(model.columns)
    ]
    # The fixed centres in the standardised space of the fit; a column they lack stands at its mean.
    fixed = {c: (FROZEN.shift[i], FROZEN.scale[i], i) for i, c in enumerate(FROZEN.columns)}
    centres = [
        [(fixed[c][0] + fixed[c][1] * z[fixed[c][2]] - m) / s if c in fixed else 0.0 for c, m, s in zip(model.columns, model.shift, model.scale)]
        for z in FROZEN.centres
    ]
    frozen = segment.Segments(model.columns, model.shift, model.scale, centres)
    frozen_cost = sum(r.cost for r in segment.cost_by_segment(table, frozen).collect())
    cost = sum(r.cost for r in by)
    return model.assign(table).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(SEGMENT).isNotNull()).alias("n_labelled"),
        F.count_distinct(SEGMENT).alias("n_segments"),
        F.lit(len(model.steps)).alias("n_fits_at_rest"),
        F.lit(max(gaps) <= 1e-3).alias("centres_are_means"),
        F.lit(abs(cost - model.cost) <= 1e-3 * cost).alias("cost_adds_up"),
        F.lit(cost <= frozen_cost).alias("not_above_fixed_centres"),
    )


@query
def segment_assign(spark, d):
    return _segmented(spark, d).select(ROW_KEY, "cluster", SEGMENT)


@query
def kmeans_cost(spark, d):
    table = _shop(spark, d, *FROZEN.columns)
    out = segment.cost_by_segment(table, FROZEN)
    return _round(out, *[f"mean_{c}" for c in FROZEN.columns], "cost")


@query
def predict_all_targets(spark, d):
    return predict.predict_all_targets(_shop(spark, d))


@query
def predict_all_first_slot(spark, d):
    return predict.predict_all_targets(_shop(spark, d), flatten=True)


@query
def rf_classify(spark, d):
    return predict.predict_all_targets(_shop(spark, d), targets=["discount_applied"])


@query
def rf_regress(spark, d):
    return predict.predict_all_targets(_shop(spark, d), targets=["review_rating_scaled"])


@query
def rf_invariants(spark, d):
    """What must hold for any seed: every labelled test row is predicted, no worse than a constant."""
    frame = predict.model_frame(_shop(spark, d))
    try:
        guessed = predict.predict(predict.fit_target(frame, "discount_applied"), frame, "discount_applied")
        share = predict.classification_metrics(guessed).first()
        majority = profile.value_counts(guessed, "label").agg(F.max("n")).first()[0] / share["n"]
        rated = predict.predict(predict.fit_target(frame, frame.rating), frame, frame.rating)
        error = predict.regression_metrics(rated).first()
        constant = predict.regression_metrics(rated.withColumn("prediction", F.lit(0.0))).first()
    finally:
        frame.release()
    rows = [
        ("discount_applied", share["n"], share["accuracy"] >= majority),
        ("review_rating", error["n"], error["rmse"] <= 1.05 * constant["rmse"]),
    ]
    return spark.createDataFrame(rows, "target string, n_test long, no_worse boolean")


@query
def metric_classification(spark, d):
    """Spend tier guessed by a fixed rule that never says Invalid."""
    table = _shop(spark, d, "purchase_amount", "discount_applied", "subscription_status")
    guess = (
        F.when((F.col("discount_applied") == "Yes") & (F.col("subscription_status") == "Yes"), "Low")
        .when(F.col("discount_applied") == "Yes", "Medium")
        .otherwise("High")
    )
    truth = bins.purchase_amount_bin(F.col("purchase_amount"))
    scored = predict.classification_metrics(table.select(truth.alias("label"), guess.alias("prediction")))
    return _round(scored, "accuracy", "f1", "weighted_precision", "weighted_recall")


@query
def metric_rmse(spark, d):
    table = _shop(spark, d, "review_rating", "previous_purchases")
    guess = F.lit(2.5) + F.lit(0.05) * F.col("previous_purchases")
    pairs = table.select(F.col("review_rating").alias("label"), guess.alias("prediction"))
    return _round(predict.regression_metrics(pairs), "rmse")


# --- segment report -------------------------------------------------------------------


@query
def segment_counts(spark, d):
    return report.segment_counts(_segmented(spark, d))


@query
def segment_sizes(spark, d):
    return report.segment_sizes(_segmented(spark, d))


@query
def segment_profile(spark, d):
    table = _segmented(
        spark, d,
        "subscription_status", "discount_applied", "promo_code_used",
        "frequency_of_purchases", "payment_method", "shipping_type",
    )
    return report.segment_profile(add_features(table).df)


@query
def category_preferences(spark, d):
    table = _segmented(spark, d, "category")
    return report.category_preferences(
        add_flags(table, "category", CATEGORY_FLAG, levels(_shop(spark, d, "category"), "category")["category"])
    )


@query
def category_and_size_preferences(spark, d):
    """The category table with the size flags beside it, as the published report has it."""
    made = add_features(_segmented(spark, d, "category", "size_label").drop("season"))
    return report.category_preferences(made.df, with_sizes=True)


@query
def season_preferences(spark, d):
    return report.season_preferences(add_features(_segmented(spark, d, "season")).df)


@query
def size_preferences(spark, d):
    return report.size_preferences(add_features(_segmented(spark, d, "size_label")).df)


@query
def category_pref_long(spark, d):
    table = _segmented(spark, d, "category")
    flagged = add_flags(table, "category", CATEGORY_FLAG, levels(_shop(spark, d, "category"), "category")["category"])
    return _round(report.category_shares_long(flagged), "preference")


@query
def category_pref_any(spark, d):
    return _round(report.category_shares_any(_segmented(spark, d, "category")), "preference")


@query
def report_one_pass(spark, d):
    """All five sections from one aggregation, in long form."""
    made = add_features(_segmented(spark, d, *[f.name for f in RETAIL.fields]), sparse=True)
    return summary.long_form(summary.sections(summary.facts(made.df)))


@query
def report_lines(spark, d):
    """Lines of the report that the default run writes, by section."""
    table = _shop(spark, d, *[f.name for f in RETAIL.fields])
    paths = pipeline.run(table, work_path(spark, "run"), segments=FROZEN)
    lines = spark.read.text(paths["report"]).select(F.rtrim(F.regexp_replace("value", "  .*", "")).alias("first"))
    return lines.where("first <> ''").groupBy("first").agg(F.count(F.lit(1)).alias("n"))


def _box(df: DataFrame, value: str) -> DataFrame:
    return _round(report.box_stats(df, value), "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def box_age(spark, d):
    return _box(_segmented(spark, d), "age")


@query
def box_value_score(spark, d):
    return _box(add_value_score(_segmented(spark, d)), "value_score")


@query
def box_purchase_frequency(spark, d):
    table = _segmented(spark, d, "frequency_of_purchases")
    yearly = features.purchases_per_year(F.col("frequency_of_purchases"))
    return _box(table.withColumn("purchase_frequency_num", yearly), "purchase_frequency_num")
