"""Column types of text files, found in one mergeable aggregation over the cells."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.files import read_csv

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?Infinity$|^NaN$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"


# The types from narrow to wide; a cell counts for the first that holds it.
_KINDS = ["int", "bigint", "double", "date", "timestamp", "boolean"]
# The types that hold every cell of a type.
_HOLDS = {
    "int": ["int"],
    "bigint": ["int", "bigint"],
    "double": ["int", "bigint", "double"],
    "date": ["date"],
    "timestamp": ["date", "timestamp"],
    "boolean": ["boolean"],
}
# How numbers and times, numbers in letters, and truth values begin.
_FIGURES, _LETTERS, _TRUTHS = list("+-.0123456789"), ["I", "N"], list("tTfF")


def _narrowest(cell: Column) -> Column:
    """Place in ``_KINDS`` of the first type that holds a cell, their number where none does.

    Most cells of a text column are told by their first character.
    """
    whole, day = cell.rlike(r"^[+-]?\d+$"), cell.rlike(_DAY)
    moment = (day | cell.rlike(_MOMENT)) & cell.try_cast("timestamp").isNotNull()
    figures = (
        F.when(whole, F.when(cell.try_cast("int").isNotNull(), 0).when(cell.try_cast("bigint").isNotNull(), 1).otherwise(2))
        .when(cell.rlike(_NUMBER), 2)
        .when(day & cell.try_cast("date").isNotNull(), 3)
        .when(moment, 4)
        .otherwise(len(_KINDS))
    )
    first = F.substring(cell, 1, 1)
    return (
        F.when(first.isin(_FIGURES), figures)
        .when(first.isin(_TRUTHS) & F.lower(cell).isin("true", "false"), 5)
        .when(first.isin(_LETTERS) & cell.rlike(_NUMBER), 2)
        .otherwise(len(_KINDS))
    )


def column_types(texts: DataFrame, most_unfit: float = 0.0) -> DataFrame:
    """(place, column, type, n, n_unfit) of a table whose columns are all text; one scan, a few rows per task and column.

    The type of a column is the first of int, bigint, double, date, timestamp and boolean that holds all
    its cells but a share of ``most_unfit``, else string.  ``n`` counts the cells that are not null,
    ``n_unfit`` those the type does not hold.  A column without cells is a string.
    """
    cells = texts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").alias("cell")) for i, c in enumerate(texts.columns)])))
    kinds = cells.where(F.col("cell").isNotNull()).select("place", _narrowest(F.col("cell")).alias("kind"))
    counted = kinds.groupBy("place", "kind").agg(F.count(F.lit(1)).alias("n"))

    def of(i: int, *more: Column) -> Column:
        here = reduce(lambda a, b: a & b, more, F.col("place") == i)
        return F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0))

    counts = []
    for i in range(len(texts.columns)):
        counts.append(of(i).alias(f"n{i}"))
        counts += [of(i, F.col("kind").isin([_KINDS.index(k) for k in held])).alias(f"{kind}{i}") for kind, held in _HOLDS.items()]
    rows = []
    for i, c in enumerate(texts.columns):
        n = F.col(f"n{i}")
        kind, unfit = F.lit("string"), F.lit(0).cast("long")
        for k in reversed(_KINDS):
            missed = n - F.col(f"{k}{i}")
            enough = (n > 0) & (missed <= most_unfit * n)
            kind, unfit = F.when(enough, F.lit(k)).otherwise(kind), F.when(enough, missed).otherwise(unfit)
        rows.append(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), kind.alias("type"), n.alias("n"), unfit.alias("n_unfit")))
    return counted.agg(*counts).select(F.inline(F.array(*rows)))


def read_inferred(
    spark: SparkSession, path: str, null_text: str | None = None, most_unfit: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """A CSV with a header, typed by its cells, and the table of types; cells that do not fit are null."""
    header = spark.read.option("header", True).csv(path)  # reads one line
    texts = read_csv(spark, path, header.schema, null_text)
    typed = column_types(texts, most_unfit)
    rows = typed.collect()  # a row per column
    found = spark.createDataFrame(rows, typed.schema)
    types = {r["column"]: r["type"] for r in rows}
    return texts.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) for c in texts.columns]), found
