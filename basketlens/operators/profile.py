"""Table profile: shape, preview, schema, summary, distinct and missing values."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.schema import is_floating, is_numeric
from basketlens.sources.files import materialised


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


def missing(df: DataFrame, column: str) -> Column:
    """True for null, and for NaN where the type has one."""
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if is_floating(df, column) else c.isNull()


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-n per task, then a merge)."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: place, name, type, and how many values are not null."""
    counts = df.agg(*[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)])
    return counts.select(
        _rows(
            [
                F.struct(
                    F.lit(i).alias("place"),
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                    F.col(f"_{i}").alias("non_null"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
    )


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum of every column, in one pass.

    Text columns have no mean or deviation.  Extremes are given as text.
    """
    none = F.lit(None).cast("double")
    aggs, rows = [], []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        aggs += [F.count(col).alias(f"n{i}"), F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}")]
        number = is_numeric(df, c)
        if number:
            aggs += [F.avg(col).alias(f"avg{i}"), F.stddev_samp(col).alias(f"sd{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                (F.col(f"avg{i}") if number else none).alias("mean"),
                (F.col(f"sd{i}") if number else none).alias("stddev"),
                F.col(f"lo{i}").cast("string").alias("min"),
                F.col(f"hi{i}").cast("string").alias("max"),
            )
        )
    return df.agg(*aggs).select(_rows(rows))


def _cells(df: DataFrame) -> DataFrame:
    """Long form: one (column index, value as text) row per non-null cell."""

    def text(i: int, c: str) -> Column:
        col = F.col(f"`{c}`")
        if is_floating(df, c):
            col = col + F.lit(0.0)  # -0.0 and 0.0 are one value
        return F.struct(F.lit(i).alias("place"), col.cast("string").alias("value"))

    cells = df.select(_rows([text(i, c) for i, c in enumerate(df.columns)]))
    return cells.where(F.col("value").isNotNull())


def _comparable(df: DataFrame, column: str) -> Column:
    """The column by which its values are told apart: itself, or its text where the type cannot be grouped."""
    col = F.col(f"`{column}`")
    if is_floating(df, column):
        return col + F.lit(0.0)  # -0.0 and 0.0 are one value
    plain = isinstance(df.schema[column].dataType, T.AtomicType) and not isinstance(df.schema[column].dataType, T.VariantType)
    return col if plain else col.cast("string")


def distinct_counts(df: DataFrame, written: bool = False) -> DataFrame:
    """Exact number of distinct non-null values per column, as ``{column}_unique``.

    Every column is read and grouped by itself, in its own type, after duplicates were dropped in each task: no cell
    becomes a row of text.  The table is written first, so that what is behind it runs once and a column is
    read alone; ``written`` tells that ``df`` is the scan of a written table.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    values = plain.select(*[_comparable(plain, c).alias(c) for c in plain.columns])
    table = values if written else materialised(values, "cells")
    counts = [table.select(c).distinct().agg(F.count(c).alias("n")).select(F.lit(i).alias("place"), "n") for i, c in enumerate(table.columns)]
    return reduce(DataFrame.unionAll, counts).agg(
        *[F.coalesce(F.sum(F.when(F.col("place") == i, F.col("n"))), F.lit(0)).alias(f"{c}_unique") for i, c in enumerate(names)]
    )


#: Slots of a distinct sketch as a power of two, and the share of the true number by which an estimate
#: may be off: three standard errors of 1.04 / sqrt(slots), rounded up.
SKETCH_PRECISION, SKETCH_ERROR = 12, 0.05


def distinct_sketches(df: DataFrame, *parts: Column, precision: int = SKETCH_PRECISION) -> DataFrame:
    """A sketch of the distinct values of every column, for each part of the rows: one small binary cell each.

    Sketches of parts are kept and united later (``united_counts``): a new part is
    sketched alone, and rows that were sketched are never read again.
    """

    def sketch(c: str) -> Column:
        col = F.col(f"`{c}`")
        if is_floating(df, c):
            col = (col + F.lit(0.0)).cast("string")
        return F.hll_sketch_agg(col, F.lit(precision)).alias(c)

    return df.groupBy(*parts).agg(*[sketch(c) for c in df.columns])


def united_counts(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """Approximate number of distinct values per column, as ``{column}_unique``, over all parts that were sketched."""
    united = [F.hll_sketch_estimate(F.hll_union_agg(f"`{c}`")) for c in columns]
    return sketches.agg(*[F.coalesce(x, F.lit(0)).alias(f"{c}_unique") for c, x in zip(columns, united)])


def distinct_counts_approx(df: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """As ``distinct_counts`` from one sketch per column: one pass, no wide shuffle (1.6 % standard error at 12)."""
    return united_counts(distinct_sketches(df, precision=precision), df.columns)


def missing_counts(df: DataFrame) -> DataFrame:
    """Number of null or NaN values per column, one row."""
    return df.agg(*[F.sum(missing(df, c).cast("long")).alias(c) for c in df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column with their counts."""
    value = F.col(f"`{column}`")
    return df.where(value.isNotNull()).groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with no null or NaN in the given columns."""
    return df.where(~reduce(lambda a, b: a | b, [missing(df, c) for c in columns]))
