"""Split, category dictionaries, one-hot vectors and standardisation.

Everything is fitted on the training rows only and applied to any frame.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.operators.profile import _cells
from basketlens.schema import numeric_columns
from basketlens.session import work_path
from basketlens.sources.files import materialised, written_positions

# Parts in which the share of the training rows is stated.
SPLIT_SCALE = 10_000


def in_train(key: Column, share: float = 0.8, seed: int = 42) -> Column:
    """True for rows of the training part: by a digest of the seed and the key's text, for any type of key.

    ``randomSplit`` depends on the partitioning of its input; this depends on the key alone.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    place = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")
    return place % SPLIT_SCALE < round(share * SPLIT_SCALE)


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, disjoint and together complete (null keys go to test)."""
    train = F.coalesce(in_train(F.col(f"`{key}`"), share, seed), F.lit(False))
    return df.where(train), df.where(~train)


@dataclass
class CategoryDictionary:
    """Alphabetical 0-based index per value and column, as seen in the training rows.

    With ``null_slot`` null has the slot after the values, which no text can equal.
    """

    columns: list[str]
    widths: dict[str, int]
    tables: dict[str, DataFrame]
    null_slot: bool = False

    def index(self, df: DataFrame, suffix: str = "_index") -> DataFrame:
        """Add ``{column}{suffix}``: the index as a double, the width for unseen (and null without a slot).

        The column carries its number of categories, so the ML stages need no extra pass.
        """
        return self._looked_up(df, suffix, self._values)

    def _values(self, c: str) -> DataFrame:
        """The dictionary of a column as (text, slot), under the names that ``_looked_up`` joins by."""
        return self.tables[c].select(F.col("value").alias(f"_t_{c}"), F.col("slot").alias(f"_s_{c}"))

    def _looked_up(self, df: DataFrame, suffix: str, values: Callable[[str], DataFrame]) -> DataFrame:
        """Join each column's ``values`` to the rows and make its index; what else ``values`` holds stays.

        One projection before the joins and one after them: the plan is long enough as it is.
        """
        out = df.withColumns({f"_t_{c}": F.col(f"`{c}`").cast("string") for c in self.columns})
        for c in self.columns:
            # No hint: Spark's own threshold decides.  A hot value makes a hot partition of
            # the left side only, which adaptive execution splits.
            out = out.join(values(c), f"_t_{c}", "left")

        def slot(c: str) -> Column:
            found = F.coalesce(F.col(f"`_s_{c}`"), F.lit(self.widths[c]))
            if self.null_slot:
                found = F.when(F.col(f"`_t_{c}`").isNull(), F.lit(self.widths[c] - 1)).otherwise(found)
            return self.stated(found, c, suffix)

        own = {f"{kind}{c}" for c in self.columns for kind in ("_t_", "_s_")}
        found = {c + suffix for c in self.columns}
        extra = [x for x in out.columns if x not in own and x not in found and x not in df.columns]
        kept = [f"`{x}`" for x in df.columns if x not in found] + [f"`{x}`" for x in extra]
        return out.select(*kept, *[slot(c) for c in self.columns])

    def stated(self, slot: Column, c: str, suffix: str) -> Column:
        """A slot as index column: a double that carries its number of categories."""
        attribute = {"ml_attr": {"type": "nominal", "name": c + suffix, "num_vals": self.widths[c] + 1}}
        return slot.cast("double").alias(c + suffix, metadata=attribute)

    def index_int(self, df: DataFrame, suffix: str = "_index") -> DataFrame:
        """As ``index``, with an int and -1 for unseen or null."""
        out = self.index(df, suffix)
        return out.withColumns(
            {
                c + suffix: F.when(F.col(c + suffix) < self.widths[c], F.col(c + suffix).cast("int"))
                .otherwise(F.lit(-1))
                for c in self.columns
            }
        )

    def one_hot(
        self, df: DataFrame, keep_index: str | None = None, then: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """Replace each column by its one-hot vector, one slot per known value.

        The index of unseen values is one past the known ones, and the encoder drops
        the last slot, so unseen and null become the zero vector.  With ``keep_index``
        the index stays beside it under that suffix.  A vector is made once per value of the
        dictionary and joined to the rows.  ``then`` changes vector columns of any frame row by row
        (to text, say) and is likewise done once per value.
        """
        suffix = keep_index or "_index"
        hot: dict[str, DataFrame] = {}

        def encoded(frame: DataFrame, columns: list[str]) -> DataFrame:
            frame = self.vectors(frame, suffix, columns)
            return then(frame) if then else frame

        def values(c: str) -> DataFrame:
            known = self._values(c)
            hot[c] = encoded(known.select("*", self.stated(F.col(f"`_s_{c}`"), c, suffix)), [c])
            return hot[c].select(*[f"`{x}`" for x in known.columns], F.col(f"`{c}`").alias(f"_v_{c}"))

        def constant(below: int) -> Column:
            """What the rows get that the dictionary has no value for: one row, the encoding of width - ``below``."""
            one = df.sparkSession.range(1).select(*[self.stated(F.lit(self.widths[c] - below), c, suffix) for c in self.columns])
            return encoded(one, self.columns).select(F.struct(*[F.col(f"`{c}`") for c in self.columns])).scalar()

        if not self.columns:
            return df
        # Each subquery stands in the plan once, above the joins, whatever the number of columns.
        absent = {"_unseen": constant(0)} | ({"_none": constant(1)} if self.null_slot else {})
        out = self._looked_up(df, suffix, values).withColumns(absent)

        def vector(c: str) -> Column:
            found = F.coalesce(F.col(f"`_v_{c}`"), F.col("_unseen").getField(c))
            return F.when(F.col(f"`{c}`").isNull(), F.col("_none").getField(c)).otherwise(found) if self.null_slot else found

        rest = [f"`{c}`" for c in df.columns if c not in self.columns]
        indexes = [c + suffix for c in self.columns] if keep_index else []
        made = {c: vector(c) for c in self.columns}
        return out.select(
            *rest, *[f"`{c}`" for c in indexes], *[x.alias(c, metadata=hot[c].schema[c].metadata) for c, x in made.items()]
        )

    def vectors(self, indexed: DataFrame, suffix: str = "_index", columns: list[str] | None = None) -> DataFrame:
        """Add the one-hot vectors of ``columns`` (default: all) to the indexes that ``index`` made."""
        columns = self.columns if columns is None else columns
        names = [f"{c}_onehot" for c in columns]
        encoder = OneHotEncoder(inputCols=[c + suffix for c in columns], outputCols=names, dropLast=True)
        encoded = encoder.fit(indexed).transform(indexed)
        return encoded.withColumnsRenamed(dict(zip(names, columns)))


def fit_dictionary(
    train: DataFrame,
    columns: list[str],
    null_slot: bool = False,
) -> CategoryDictionary:
    """Index the distinct values of all columns in one pass over the training rows.

    The distinct (column, value) pairs are written in sorted order; an index is the
    row's place in the sorted files.  Dictionaries are tables at every size, so no task
    and no driver ever holds one.  With ``null_slot`` null has a slot of its own.
    """
    spark = train.sparkSession
    source = train.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    path = work_path(spark, "dictionary")
    _cells(source).distinct().orderBy("place", "value").write.parquet(path)
    counts = {columns[r["place"]]: r["count"] for r in spark.read.parquet(path).groupBy("place").count().collect()}
    placed = materialised(written_positions(spark, path), "dictionary-slots")
    tables, start = {}, 0
    for i, c in enumerate(columns):
        slots = placed.where(F.col("place") == i)
        tables[c] = slots.select("value", (F.col("position") - start).alias("slot"))
        start += counts.get(c, 0)
    widths = {c: counts.get(c, 0) + null_slot for c in columns}
    return CategoryDictionary(list(columns), widths, tables, null_slot)


@dataclass
class Standardizer:
    """Centre and scale by the mean and sample deviation of the fitted rows."""

    means: dict[str, float]
    deviations: dict[str, float]

    def scaled(self, column: str) -> Column:
        sd = self.deviations[column]
        if not sd:  # a constant column (or a single row) carries no information
            return F.when(F.col(f"`{column}`").isNotNull(), F.lit(0.0))
        return (F.col(f"`{column}`") - F.lit(self.means[column])) / F.lit(sd)

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({c + suffix: self.scaled(c) for c in self.means})

    def replace(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        """Drop the originals once scaled, alike for training and test rows."""
        return self.transform(df, suffix).drop(*self.means)


def fit_standardizer(train: DataFrame, columns: list[str] | None = None) -> Standardizer:
    """One aggregate over the given (default: all) numeric columns; null and NaN are skipped."""
    columns = numeric_columns(train) if columns is None else columns
    finite = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    row = train.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(finite.values())],
        *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(finite.values())],
    ).first()
    means = {c: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}
    sds = {c: row[f"s{i}"] for i, c in enumerate(columns)}
    return Standardizer(
        means, {c: 0.0 if s is None or math.isnan(s) else s for c, s in sds.items()}
    )
