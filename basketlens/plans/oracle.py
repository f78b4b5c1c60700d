"""The registered queries as SQL over the same tables, for an independent engine."""

from basketlens.operators.predict import BINS
from basketlens.operators.report import SECTIONS
from basketlens.plans.catalog import CATEGORICAL, FROZEN
from basketlens.schema import DISPLAY_NAMES, RETAIL

# Category and season values of the given tables; the value lists and groups below are fixed as well.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEASONS = ["Fall", "Spring", "Summer", "Winter"]
DIGITS = 6

SHOP = """
hist AS (
  SELECT o_orderkey, o_custkey, o_orderpriority,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS previous_purchases
  FROM orders),
shop AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_key,
    c_custkey AS customer_id,
    CAST(15 + (c_custkey * 37) % 66 AS INTEGER) AS age,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    p_name AS item_purchased,
    CASE WHEN p_partkey % 97 <> 0 THEN p_type END AS category,
    l_extendedprice / CAST(1000 AS DOUBLE) AS purchase_amount,
    n_name AS location,
    CASE WHEN p_partkey % 89 = 0 THEN NULL WHEN p_size <= 6 THEN 'XS' WHEN p_size <= 15 THEN 'S'
      WHEN p_size <= 32 THEN 'M' WHEN p_size <= 44 THEN 'L' ELSE 'XL' END AS size_label,
    split_part(p_name, ' ', 1) AS color,
    CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) <= 5 THEN 'Spring'
      WHEN month(l_shipdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
    CASE WHEN l_orderkey % 101 <> 0 THEN CAST(1 AS DOUBLE) + l_tax * CAST(50 AS DOUBLE) END AS review_rating,
    CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'Yes' ELSE 'No' END AS subscription_status,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'PayPal' WHEN 'AO' THEN 'Venmo' WHEN 'NF' THEN 'Cash'
      WHEN 'NO' THEN 'Credit Card' WHEN 'RF' THEN 'Apple Pay' WHEN 'RO' THEN 'Debit Card' END AS payment_method,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Next Day Air' WHEN '2-HIGH' THEN 'Express'
      WHEN '3-MEDIUM' THEN 'Standard' WHEN '5-LOW' THEN 'Store Pickup' END AS shipping_type,
    CASE WHEN l_discount > CAST(0.045 AS DOUBLE) THEN 'Yes' ELSE 'No' END AS discount_applied,
    CASE WHEN l_discount > CAST(0.075 AS DOUBLE) THEN 'Yes' ELSE 'No' END AS promo_code_used,
    previous_purchases,
    CASE c_custkey % 8 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Fortnightly' WHEN 2 THEN 'Monthly' WHEN 3 THEN 'Quarterly'
      WHEN 4 THEN 'Bi-Annually' WHEN 5 THEN 'Annually' WHEN 6 THEN 'Every 2 Years' ELSE 'Every 3 Months' END AS frequency_of_purchases
  FROM lineitem JOIN hist ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey)"""

TRAIN = "CAST('0x' || substr(md5('42:' || CAST(row_key AS VARCHAR)), 1, 7) AS BIGINT) % 10000 < 8000"


def _flag(column: str, value: str, name: str) -> str:
    return f'CAST({column} = \'{value}\' AS INTEGER) AS "{name}"'


def _member(column: str, values: list[str], name: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN {column} IN ({listed}) THEN 1 ELSE 0 END AS {name}"


CATEGORY_FLAGS = ", ".join(_flag("category", v, f"category_{v}") for v in CATEGORIES)
SEASON_FLAGS = ", ".join(_flag("season", v, f"season_{v}") for v in SEASONS)
SMALL = _member("size_label", ["S", "XS"], "size_small")
LARGE = _member("size_label", ["L", "XL"], "size_large")
DIGITAL = _member("payment_method", ["PayPal", "Venmo", "Apple Pay"], "digital_payment_pref")
FAST = _member("shipping_type", ["Express", "Next Day Air"], "fast_shipping_pref")
YEARLY = """CASE frequency_of_purchases WHEN 'Weekly' THEN CAST(52 AS DOUBLE) WHEN 'Fortnightly' THEN CAST(26 AS DOUBLE)
  WHEN 'Monthly' THEN CAST(12 AS DOUBLE) WHEN 'Quarterly' THEN CAST(4 AS DOUBLE) WHEN 'Bi-Annually' THEN CAST(2 AS DOUBLE)
  WHEN 'Annually' THEN CAST(1 AS DOUBLE) WHEN 'Every 2 Years' THEN CAST(0.5 AS DOUBLE) END AS purchase_frequency_num"""
AGE_GROUP = """CASE WHEN age > 17 AND age <= 25 THEN '18-25' WHEN age > 25 AND age <= 35 THEN '26-35'
  WHEN age > 35 AND age <= 50 THEN '36-50' WHEN age > 50 AND age <= 70 THEN '51-70' WHEN age > 70 THEN '>70' END AS age_group"""
SCORE = """purchase_amount / (SELECT max(purchase_amount) FROM shop) * CAST(0.6 AS DOUBLE)
  + CAST(previous_purchases AS DOUBLE) / (SELECT max(previous_purchases) FROM shop) * CAST(0.4 AS DOUBLE)"""
DISCOUNT = "CAST(discount_applied = 'Yes' AS INTEGER)"
PROMO = "CAST(promo_code_used = 'Yes' AS INTEGER)"


def _ranges(column: str, ranges: list[tuple], names: list[str], invalid: str = "Invalid") -> str:
    arms = " ".join(
        f"WHEN {column} >= {low}" + (f" AND {column} <= {high}" if high != float("inf") else "") + f" THEN '{name}'"
        for (low, high), name in zip(ranges, names)
    )
    return f"CASE WHEN {column} IS NULL THEN NULL {arms} ELSE '{invalid}' END"


AGE_BIN = _ranges("age", [(18, 25), (26, 35), (36, 50), (51, 70), (71, float("inf"))], ["18-25", "26-35", "36-50", "51-70", ">70"])
AMOUNT_BIN = _ranges("purchase_amount", [(20, 40), (41, 70), (71, 100)], ["Low", "Medium", "High"])
PREVIOUS_BIN = _ranges(
    "previous_purchases",
    [(0, 5), (6, 10), (11, 15), (16, 20), (21, 25), (26, 30), (31, 35), (36, 40), (41, 45), (46, 50)],
    ["0-5", "6-10", "11-15", "16-20", "21-25", "26-30", "31-35", "36-40", "41-45", "46-50"],
)


def _zscores() -> str:
    return ", ".join(
        f"(CAST({c} AS DOUBLE) - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE) AS z{i}"
        for i, (c, m, s) in enumerate(zip(FROZEN.columns, FROZEN.shift, FROZEN.scale))
    )


def _distance(centre: list[float]) -> str:
    return " + ".join(
        f"(z{i} - CAST({x} AS DOUBLE)) * (z{i} - CAST({x} AS DOUBLE))" for i, x in enumerate(centre)
    )


SEGMENTED = f"""
zed AS (SELECT *, {_zscores()} FROM shop),
far AS (SELECT *, {", ".join(f"{_distance(c)} AS d{j}" for j, c in enumerate(FROZEN.centres, 1))} FROM zed),
near AS (SELECT *, CASE WHEN d1 IS NULL THEN NULL WHEN d1 <= d2 AND d1 <= d3 AND d1 <= d4 THEN 1
  WHEN d2 <= d3 AND d2 <= d4 THEN 2 WHEN d3 <= d4 THEN 3 ELSE 4 END AS cluster FROM far),
seg AS (SELECT *, 'Segment ' || cluster AS segment, least(d1, d2, d3, d4) AS distance FROM near)"""

FEATURED = f"""{SEGMENTED},
feat AS (SELECT * REPLACE ({DISCOUNT} AS discount_applied, {PROMO} AS promo_code_used),
  round({SCORE}, {DIGITS}) AS value_score, {SCORE} AS raw_score, {AGE_GROUP}, {YEARLY},
  {DISCOUNT} + {PROMO} AS discount_sensitivity, {DIGITAL}, {FAST}, {SMALL}, {LARGE},
  {CATEGORY_FLAGS}, {SEASON_FLAGS} FROM seg)"""

COLUMNS = [f.name for f in RETAIL.fields]
ALL = ["row_key", *COLUMNS]

GROUPS = {
    "demographic": ["age", "age_group", "gender", "location"],
    "value": ["value_score", "purchase_amount", "previous_purchases"],
    "purchase_behavior": [
        "purchase_frequency_num", "frequency_of_purchases", "discount_sensitivity", "discount_applied",
        "promo_code_used", "subscription_status", "review_rating",
    ],
    "category": [*[f"category_{v}" for v in CATEGORIES], "category", "item_purchased"],
    "seasonal": [*[f"season_{v}" for v in SEASONS], "season"],
    "preference": [
        "digital_payment_pref", "payment_method", "fast_shipping_pref", "shipping_type",
        "size_small", "size_large", "size_label", "color",
    ],
}
DERIVED = [
    "cluster", "segment", "value_score", "age_group", "purchase_frequency_num", "discount_sensitivity",
    "digital_payment_pref", "fast_shipping_pref", "size_small", "size_large",
    *[f"category_{v}" for v in CATEGORIES], *[f"season_{v}" for v in SEASONS],
]


def _over_shop(select: str) -> str:
    return f"WITH {SHOP}\n{select}"


def _over_seg(select: str) -> str:
    return f"WITH {SHOP}, {SEGMENTED}\n{select}"


def _over_feat(select: str) -> str:
    return f"WITH {SHOP}, {FEATURED}\n{select}"


def _quoted(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


BINNED = f"""binned AS (SELECT * REPLACE ({AGE_BIN} AS age, {AMOUNT_BIN} AS purchase_amount,
  {PREVIOUS_BIN} AS previous_purchases), {TRAIN} AS in_train FROM shop)"""


def _dictionaries() -> str:
    tables = [
        f"""dict_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot, count(*) OVER () AS width
  FROM (SELECT DISTINCT {c} AS v FROM binned WHERE in_train AND {c} IS NOT NULL))"""
        for c in CATEGORICAL
    ]
    return f"WITH {SHOP}, {BINNED}, " + ",\n".join(tables)


def _encoded(expr: str, extra: str = "") -> str:
    """Every categorical column through ``expr``, which may use {c}, the column's name."""
    picked = ", ".join(expr.replace("{c}", c) for c in CATEGORICAL)
    joins = " ".join(f"LEFT JOIN dict_{c} ON binned.{c} = dict_{c}.v" for c in CATEGORICAL)
    return f"{_dictionaries()}\nSELECT row_key, {picked}{extra} FROM binned {joins}"


VECTOR = """CASE WHEN dict_{c}.slot IS NULL
  THEN '{"type":0,"size":' || (SELECT count(*) FROM dict_{c}) || ',"indices":[],"values":[]}'
  ELSE '{"type":0,"size":' || dict_{c}.width || ',"indices":[' || dict_{c}.slot || '],"values":[1.0]}' END AS {c}"""


def _share(flag: str, digits: int = 1) -> str:
    return f"round(CAST(100 AS DOUBLE) * sum({flag}) / count({flag}), {digits})"


def _box(value: str, source: str) -> str:
    """Quartiles by interpolation, then whiskers and outliers against them."""
    return f"""q AS (SELECT segment, quantile_cont(v, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(v, CAST(0.5 AS DOUBLE)) AS median,
    quantile_cont(v, CAST(0.75 AS DOUBLE)) AS q3 FROM vals GROUP BY segment),
j AS (SELECT vals.segment, v, q1, median, q3, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi
    FROM vals JOIN q ON vals.segment = q.segment)
SELECT segment, count(*) AS n, round(q1, {DIGITS}) AS q1, round(median, {DIGITS}) AS median, round(q3, {DIGITS}) AS q3,
  round(min(CASE WHEN v >= lo THEN v END), {DIGITS}) AS whisker_low, round(max(CASE WHEN v <= hi THEN v END), {DIGITS}) AS whisker_high,
  CAST(sum(CASE WHEN v < lo OR v > hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM j GROUP BY segment, q1, median, q3"""


def _box_query(value: str) -> str:
    vals = f"vals AS (SELECT segment, CAST({value} AS DOUBLE) AS v FROM feat WHERE segment IS NOT NULL AND {value} IS NOT NULL)"
    return f"WITH {SHOP}, {FEATURED}, {vals}, {_box(value, 'feat')}"


def _describe() -> str:
    parts = []
    for f in RETAIL.fields:
        number = f.dataType.typeName() != "string"
        mean = f"round(avg({f.name}), {DIGITS})" if number else "CAST(NULL AS DOUBLE)"
        sd = f"round(stddev_samp({f.name}), {DIGITS})" if number else "CAST(NULL AS DOUBLE)"
        parts.append((f.name, mean, sd))
    key = ("row_key", f"round(avg(row_key), {DIGITS})", f"round(stddev_samp(row_key), {DIGITS})")
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {mean} AS mean, {sd} AS stddev,
  CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM shop"""
        for c, mean, sd in [key, *parts]
    )


def _schema() -> str:
    types = [("row_key", "bigint"), *[(f.name, f.dataType.simpleString()) for f in RETAIL.fields]]
    return " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS place, '{c}' AS "column", '{t}' AS type, count({c}) AS non_null FROM shop"""
        for i, (c, t) in enumerate(types)
    )


def _csv_types() -> str:
    kinds = {"row_key": "int"} | {f.name: f.dataType.simpleString() for f in RETAIL.fields} | {"customer_id": "int"}
    unfit = "count(*) FILTER (row_key % 211 = 0)"
    counted = {"age": f"count(age) + count(*) FILTER (age IS NULL AND row_key % 211 = 0) AS n, {unfit} AS n_unfit"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, {counted.get(c, f'count({c}) AS n, CAST(0 AS BIGINT) AS n_unfit')} FROM shop"""
        for c, t in kinds.items()
    )


def _clean_names() -> str:
    rows = []
    for c in COLUMNS:
        dotted = DISPLAY_NAMES[c].replace(" ", ".").replace("(", ".").replace(")", ".")
        rows.append(
            f"SELECT '{dotted}' AS original, '{dotted.replace('.', ' ')}' AS clean, count({c}) AS non_null FROM shop"
        )
    return " UNION ALL ".join(rows)


def _missing_cols() -> str:
    kept = [
        "gender", "location", "value_score", "purchase_amount", "previous_purchases", "purchase_frequency_num",
        "frequency_of_purchases", "promo_code_used", "subscription_status", "review_rating",
        *GROUPS["category"], *GROUPS["seasonal"], *GROUPS["preference"],
    ]
    return f"""WITH {SHOP}, made AS (SELECT *, round({SCORE}, {DIGITS}) AS value_score, {YEARLY}, {DIGITAL}, {FAST}, {SMALL}, {LARGE},
  {CATEGORY_FLAGS}, {SEASON_FLAGS} FROM shop)
SELECT row_key, {_quoted(kept)} FROM made"""


def _split_export() -> str:
    hot = " + ".join(f"CASE WHEN dict_{c}.slot IS NULL THEN 0 ELSE 1 END" for c in CATEGORICAL)
    joins = " ".join(f"LEFT JOIN dict_{c} ON binned.{c} = dict_{c}.v" for c in CATEGORICAL)
    return f"""{_dictionaries()},
fit AS (SELECT avg(review_rating) AS m, stddev_samp(review_rating) AS s FROM binned WHERE in_train),
hot AS (SELECT in_train, {hot} AS h, (review_rating - (SELECT m FROM fit)) / (SELECT s FROM fit) AS z FROM binned {joins})
SELECT CASE WHEN in_train THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(h) AS BIGINT) AS hot_slots,
  round(avg(abs(z)), {DIGITS}) AS mean_abs_scaled_rating FROM hot GROUP BY in_train"""


def _scale_numeric() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in FROZEN.columns)
    fit = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(FROZEN.columns))
    out = ", ".join(
        f"round(({c} - (SELECT m{i} FROM fit)) / (SELECT s{i} FROM fit), {DIGITS}) AS {c}_scaled"
        for i, c in enumerate(FROZEN.columns)
    )
    return f"WITH {SHOP}, whole AS (SELECT * FROM shop WHERE {complete}), fit AS (SELECT {fit} FROM whole) SELECT row_key, {out} FROM whole"


METRICS = f"""WITH {SHOP}, pairs AS (SELECT {AMOUNT_BIN} AS label,
  CASE WHEN discount_applied = 'Yes' AND subscription_status = 'Yes' THEN 'Low' WHEN discount_applied = 'Yes' THEN 'Medium' ELSE 'High' END AS prediction
  FROM shop),
support AS (SELECT label, count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS tp FROM pairs GROUP BY label),
guessed AS (SELECT prediction, count(*) AS n FROM pairs GROUP BY prediction),
scored AS (SELECT support.n AS n, tp, CAST(tp AS DOUBLE) / support.n AS r, coalesce(CAST(tp AS DOUBLE) / guessed.n, CAST(0 AS DOUBLE)) AS p
  FROM support LEFT JOIN guessed ON support.label = guessed.prediction),
with_f AS (SELECT *, CASE WHEN p + r > 0 THEN CAST(2 AS DOUBLE) * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END AS f FROM scored)
SELECT CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(tp) AS DOUBLE) / sum(n), {DIGITS}) AS accuracy, round(sum(n * f) / sum(n), {DIGITS}) AS f1,
  round(sum(n * p) / sum(n), {DIGITS}) AS weighted_precision, round(sum(n * r) / sum(n), {DIGITS}) AS weighted_recall FROM with_f"""


MEANS = {
    "avg_age": ("age", 1), "avg_previous": ("previous_purchases", 1), "value_score": ("raw_score", 3),
    "purchase_frequency": ("purchase_frequency_num", 1), "discount_sensitivity": ("discount_sensitivity", 2),
}
RATES = {
    "discount_rate": "discount_applied", "subscription_rate": "CAST(subscription_status = 'Yes' AS INTEGER)",
    "digital_payment": "digital_payment_pref", "fast_shipping": "fast_shipping_pref",
}


def _one_pass() -> str:
    """The five sections of the report, a row per number."""
    known = "FROM feat WHERE segment IS NOT NULL"

    def rows(section: str, item: str, number: str, tail: str = f"{known} GROUP BY segment", row: str = "segment") -> str:
        return f"""SELECT '{section}' AS section, {row} AS "row", '{item}' AS item, CAST({number} AS DOUBLE) AS number {tail}"""

    parts = [
        rows("IDENTIFIED CUSTOMER SEGMENTS", "count", "count(*)"),
        rows("IDENTIFIED CUSTOMER SEGMENTS", "pct_of_all", "round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM feat), 1)"),
        rows("SEGMENT CHARACTERISTICS", "count", "count(*)"),
        rows("SEGMENT CHARACTERISTICS", "pct", f"round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) {known}), 1)"),
        *[rows("SEGMENT CHARACTERISTICS", m, f"round(avg({c}), {digits})") for m, (c, digits) in MEANS.items()],
        *[rows("SEGMENT CHARACTERISTICS", m, _share(c)) for m, c in RATES.items()],
        rows("SIZE PREFERENCES BY SEGMENT", "small", _share("size_small")),
        rows("SIZE PREFERENCES BY SEGMENT", "large", _share("size_large")),
        rows("SIZE PREFERENCES BY SEGMENT", "medium", _share("1 - size_small - size_large")),
    ]
    for title, family in (("CATEGORY PREFERENCES BY SEGMENT", "category"), ("SEASONAL PREFERENCES BY SEGMENT", "season")):
        for i in range(1, 5):
            whole = f"(SELECT count({family}) {known} AND cluster = {i})"
            share = f"round(CAST(100 AS DOUBLE) * sum(CASE WHEN cluster = {i} THEN 1 ELSE 0 END) / {whole}, 1)"
            parts.append(rows(title, f"Segment {i}", share, f"{known} AND {family} IS NOT NULL GROUP BY {family}", family))
    return " UNION ALL ".join(parts)


def _report_lines() -> str:
    titles = " UNION ALL ".join(f"SELECT '{t}:' AS first, 1 AS n" for t in SECTIONS.values())
    return f"""SELECT first, CAST(sum(n) AS BIGINT) AS n FROM ({titles}
  UNION ALL SELECT 'segment', 3 UNION ALL SELECT 'category', 1 UNION ALL SELECT 'season', 1
  UNION ALL SELECT 'Segment ' || i, 3 FROM range(1, 5) AS r(i)
  UNION ALL SELECT DISTINCT category, 1 FROM seg WHERE segment IS NOT NULL AND category IS NOT NULL
  UNION ALL SELECT DISTINCT season, 1 FROM seg WHERE segment IS NOT NULL) GROUP BY first"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "flags_sparse": _over_shop(
            """SELECT row_key, CASE WHEN row_key % 3 = 0 THEN 'a%5Fb_%25' ELSE replace(category, ' ', '_') END AS name, CAST(1 AS INTEGER) AS flag
  FROM shop WHERE row_key % 3 = 0 OR category IS NOT NULL UNION ALL SELECT row_key, season, CAST(1 AS INTEGER) FROM shop"""
        ),
        "flag_names": _over_shop(
            """SELECT 'category' AS family, replace(category, ' ', '_') AS name, category AS value, count(*) AS n FROM shop
  WHERE category IS NOT NULL GROUP BY category UNION ALL SELECT 'season', season, season, count(*) FROM shop GROUP BY season"""
        ),
        "report_one_pass": _over_feat(_one_pass()),
        "report_lines": _over_seg(_report_lines()),
        "src_csv_roundtrip": _over_shop("SELECT * FROM shop"),
        "src_csv_inferred": _over_shop(
            "SELECT * REPLACE (CAST(row_key AS INTEGER) AS row_key, CAST(customer_id AS INTEGER) AS customer_id) FROM shop"
        ),
        "csv_types": _over_shop(_csv_types()),
        "row_id_generated": _over_shop(
            "SELECT count(*) AS n, count(*) AS n_distinct, CAST(1 AS BIGINT) AS min_id, count(*) AS max_id FROM shop"
        ),
        "features_all": _over_feat(f"SELECT {_quoted(ALL + DERIVED)} FROM feat"),
        "features_missing_cols": _missing_cols(),
        "split_export": _split_export(),
        "profile_shape": _over_shop(
            f"SELECT count(*) AS n_rows, CAST({len(ALL)} AS INTEGER) AS n_columns, '{','.join(ALL)}' AS column_names FROM shop"
        ),
        "profile_head": _over_shop(
            f"SELECT * FROM shop ORDER BY {', '.join(f'{c} ASC NULLS FIRST' for c in ALL)} LIMIT 10"
        ),
        "profile_schema": _over_shop(_schema()),
        "profile_describe": _over_shop(_describe()),
        "profile_distinct": _over_shop(
            f"SELECT {', '.join(f'count(DISTINCT {c}) AS {c}_unique' for c in ALL)} FROM shop"
        ),
        "profile_distinct_within": " UNION ALL ".join(f"""SELECT '{c}' AS "column", true AS within_error""" for c in ALL),
        "profile_nulls": _over_shop(
            f"SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in ALL)} FROM shop"
        ),
        "profile_values": _over_shop(
            "SELECT category, count(*) AS n FROM shop WHERE category IS NOT NULL GROUP BY category"
        ),
        "clean_names_mapping": _over_shop(_clean_names()),
        "filter_complete_cases": _over_shop(
            f"SELECT row_key, {', '.join(FROZEN.columns)} FROM shop WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in FROZEN.columns)
        ),
        "bin_generic": _over_shop(
            "SELECT row_key, purchase_amount, "
            + _ranges("purchase_amount", [(0, 25), (30, 60.5), (80, 200)], ["a", "b", "c"], "none")
            + " AS bin FROM shop"
        ),
        "bin_age": _over_shop(f"SELECT row_key, age, {AGE_BIN} AS bin FROM shop"),
        "bin_purchase_amount": _over_shop(f"SELECT row_key, purchase_amount, {AMOUNT_BIN} AS bin FROM shop"),
        "bin_previous_purchases": _over_shop(
            f"SELECT row_key, previous_purchases, {PREVIOUS_BIN} AS bin FROM shop"
        ),
        "bin_all": f"WITH {SHOP}, {BINNED} SELECT row_key, {', '.join(BINS)} FROM binned",
        "age_group_cut": _over_shop(
            f"""SELECT row_key, age, {AGE_GROUP}, CAST(CASE WHEN age <= 17 THEN NULL WHEN age <= 25 THEN 0 WHEN age <= 35 THEN 1
  WHEN age <= 50 THEN 2 WHEN age <= 70 THEN 3 ELSE 4 END AS INTEGER) AS age_group_order FROM shop"""
        ),
        "value_score": _over_shop(
            f"SELECT row_key, purchase_amount, previous_purchases, round({SCORE}, {DIGITS}) AS value_score FROM shop"
        ),
        "category_flags": _over_shop(f"SELECT row_key, category, {CATEGORY_FLAGS} FROM shop"),
        "category_flags_similar_names": f"""WITH {SHOP}, renamed AS (SELECT row_key,
  CASE WHEN category IS NULL THEN NULL WHEN row_key % 4 = 0 THEN 'a b' WHEN row_key % 4 = 1 THEN 'a_b'
    WHEN row_key % 4 = 2 THEN 'Small' ELSE 'SMALL' END AS category FROM shop)
SELECT row_key, category, {_flag("category", "a b", "category_a%20b")}, {_flag("category", "a_b", "category_a%5Fb")},
  {_flag("category", "Small", "category_%53mall")}, {_flag("category", "SMALL", "category_%53%4D%41%4C%4C")} FROM renamed""",
        "season_flags": _over_shop(f"SELECT row_key, season, {SEASON_FLAGS} FROM shop"),
        "purchase_frequency": _over_shop(f"SELECT row_key, frequency_of_purchases, {YEARLY} FROM shop"),
        "yes_no_encode": _over_shop(
            f"""SELECT row_key, CAST(subscription_status = 'Yes' AS INTEGER) AS subscription_status,
  {DISCOUNT} AS discount_applied, {PROMO} AS promo_code_used FROM shop"""
        ),
        "discount_sensitivity": _over_shop(
            f"SELECT row_key, {DISCOUNT} AS discount_applied, {PROMO} AS promo_code_used, {DISCOUNT} + {PROMO} AS discount_sensitivity FROM shop"
        ),
        "payment_pref": _over_shop(f"SELECT row_key, payment_method, {DIGITAL} FROM shop"),
        "shipping_pref": _over_shop(f"SELECT row_key, shipping_type, {FAST} FROM shop"),
        "size_flags": _over_shop(f"SELECT row_key, size_label, {SMALL}, {LARGE} FROM shop"),
        "encode_index": _encoded("CAST(coalesce(dict_{c}.slot, -1) AS INTEGER) AS {c}_index"),
        "encode_index_with_null": _encoded(
            "CAST(CASE WHEN binned.{c} IS NULL THEN (SELECT count(*) FROM dict_{c}) ELSE coalesce(dict_{c}.slot, -1) END AS INTEGER) AS {c}_index"
        ),
        "encode_onehot": _encoded(VECTOR),
        "first_slot": _encoded(
            "CASE WHEN dict_{c}.slot = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {c}"
        ),
        "split_counts": _over_shop(
            f"SELECT CASE WHEN {TRAIN} THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM shop GROUP BY 1"
        ),
        "scale_rating": f"""WITH {SHOP}, fit AS (SELECT avg(review_rating) AS m, stddev_samp(review_rating) AS s FROM shop WHERE {TRAIN})
SELECT row_key, CASE WHEN {TRAIN} THEN 'train' ELSE 'test' END AS part,
  round((review_rating - (SELECT m FROM fit)) / (SELECT s FROM fit), {DIGITS}) AS review_rating_scaled FROM shop""",
        "scale_numeric": _scale_numeric(),
        **{
            name: _over_shop(
                "SELECT count(*) AS n_rows, count(CASE WHEN "
                + " AND ".join(f"{c} IS NOT NULL" for c in FROZEN.columns)
                + " THEN 1 END) AS n_labelled, CAST(4 AS BIGINT) AS n_segments, CAST(25 AS INTEGER) AS n_fits_at_rest,"
                + " TRUE AS centres_are_means, TRUE AS cost_adds_up, TRUE AS not_above_fixed_centres FROM shop"
            )
            for name in ("kmeans_invariants", "kmeans_with_id_invariants")
        },
        "segment_assign": _over_seg("SELECT row_key, cluster, segment FROM seg"),
        "kmeans_cost": _over_seg(
            f"""SELECT segment, count(*) AS n, {', '.join(f'round(avg({c}), {DIGITS}) AS mean_{c}' for c in FROZEN.columns)},
  round(sum(distance), {DIGITS}) AS cost FROM seg WHERE segment IS NOT NULL GROUP BY segment"""
        ),
        "rf_invariants": _over_shop(
            f"""SELECT 'discount_applied' AS target, count(discount_applied) AS n_test, TRUE AS no_worse FROM shop WHERE NOT ({TRAIN})
UNION ALL SELECT 'review_rating' AS target, count(review_rating) AS n_test, TRUE AS no_worse FROM shop WHERE NOT ({TRAIN})"""
        ),
        "metric_classification": METRICS,
        "metric_rmse": _over_shop(
            f"""SELECT count(e) AS n, round(sqrt(avg(e * e)), {DIGITS}) AS rmse FROM (
  SELECT review_rating - (CAST(2.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * previous_purchases) AS e FROM shop)"""
        ),
        "segment_counts": f"""WITH {SHOP}, {SEGMENTED}, names AS (SELECT 'Segment ' || i AS segment FROM range(1, 5) AS r(i))
SELECT names.segment AS segment, count(seg.segment) AS count,
  round(CAST(100 AS DOUBLE) * count(seg.segment) / (SELECT count(*) FROM seg), 1) AS pct_of_all
FROM names LEFT JOIN seg ON names.segment = seg.segment GROUP BY names.segment""",
        "segment_sizes": _over_seg(
            "SELECT segment, count(*) AS count FROM seg WHERE segment IS NOT NULL GROUP BY segment"
        ),
        "segment_profile": _over_feat(
            f"""SELECT segment, count(*) AS count,
  round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(segment) FROM feat), 1) AS pct,
  round(avg(age), 1) AS avg_age, round(avg(previous_purchases), 1) AS avg_previous,
  {_share('discount_applied')} AS discount_rate,
  {_share("CAST(subscription_status = 'Yes' AS INTEGER)")} AS subscription_rate,
  round(avg(raw_score), 3) AS value_score, round(avg(purchase_frequency_num), 1) AS purchase_frequency,
  round(avg(discount_sensitivity), 2) AS discount_sensitivity,
  {_share('digital_payment_pref')} AS digital_payment, {_share('fast_shipping_pref')} AS fast_shipping
FROM feat WHERE segment IS NOT NULL GROUP BY segment"""
        ),
        "size_preferences": _over_feat(
            f"""SELECT segment, {_share('size_small')} AS small,
  round(CAST(100 AS DOUBLE) * (count(*) - sum(size_small) - sum(size_large)) / count(*), 1) AS medium,
  {_share('size_large')} AS large FROM feat WHERE segment IS NOT NULL GROUP BY segment"""
        ),
        "season_preferences": _over_feat(
            "SELECT segment, "
            + ", ".join(f'{_share(f"season_{v}")} AS "{v}"' for v in SEASONS)
            + " FROM feat WHERE segment IS NOT NULL GROUP BY segment"
        ),
    }
    shares = ", ".join(f'{_share(f"category_{v}")} AS "{v}"' for v in CATEGORIES)
    sql["category_preferences"] = _over_feat(
        f"SELECT segment, {shares} FROM feat WHERE segment IS NOT NULL GROUP BY segment"
    )
    sql["category_and_size_preferences"] = _over_feat(
        f"""SELECT segment, {shares}, {_share('size_small')} AS "size small", {_share('size_large')} AS "size large"
FROM feat WHERE segment IS NOT NULL GROUP BY segment"""
    )
    sql["category_pref_long"] = sql["category_pref_any"] = _over_feat(
        " UNION ALL ".join(
            f"""SELECT segment, '{v}' AS category, round(avg("category_{v}"), {DIGITS}) AS preference
  FROM feat WHERE segment IS NOT NULL GROUP BY segment"""
            for v in CATEGORIES
        )
    )
    for column in ("age", "purchase_frequency_num"):
        sql["box_age" if column == "age" else "box_purchase_frequency"] = _box_query(column)
    sql["box_value_score"] = _box_query("raw_score")
    for group, columns in GROUPS.items():
        picked = _quoted(["customer_id", "segment", "cluster", *columns])
        sql[f"feature_set_{group}"] = _over_feat(f"SELECT {picked} FROM feat")
    return sql
