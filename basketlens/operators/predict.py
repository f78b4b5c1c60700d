"""Random forests that predict any column from the others, and their metrics."""

from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.bins import age_bin, previous_purchases_bin, purchase_amount_bin
from basketlens.functions.features import first_slot, vector_head
from basketlens.operators import forest
from basketlens.operators.encode import (
    CategoryDictionary,
    Standardizer,
    fit_dictionary,
    fit_standardizer,
    split,
)
from basketlens.operators.segment import run_parallel
from basketlens.schema import CUSTOMER_ID, ROW_KEY, has
from basketlens.sources.files import materialised

RATING = "review_rating"
# Pieces that the rows of a forest are dealt into, and rows from which there are more; its bootstrap depends on them,
# so they depend on the number of rows and nothing else.
FOREST_PARTITIONS = 32
FOREST_ROWS = 250_000
# Rows that forests fitted side by side may read between them; more of them keep all cores busy one at a time.
FITTED_ROWS = 8_000_000
BINS = {
    "age": age_bin,
    "purchase_amount": purchase_amount_bin,
    "previous_purchases": previous_purchases_bin,
}


def bin_columns(df: DataFrame) -> DataFrame:
    """Replace age, amount and previous purchases by their bins, in one projection."""
    return df.withColumns({c: rule(F.col(c)) for c, rule in BINS.items() if has(df, c)})


@dataclass
class Prepared:
    """Training and test rows encoded by what the training rows taught."""

    train: DataFrame
    test: DataFrame
    dictionary: CategoryDictionary
    standardizer: Standardizer


def prepare(
    df: DataFrame,
    key: str = ROW_KEY,
    null_slot: bool = False,
    keep_index: str | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
    vectors: bool = True,
) -> Prepared:
    """Bin, split, one-hot encode, standardise the rating; both parts get the same columns.

    ``then`` goes to ``CategoryDictionary.one_hot``.  Without ``vectors`` the parts hold the indexes only.
    """
    binned = materialised(bin_columns(df), "binned")
    train, test = split(binned, key)
    categorical = [c for c in binned.columns if c not in (key, CUSTOMER_ID, RATING)]
    dictionary = fit_dictionary(train, categorical, null_slot)
    standardizer = fit_standardizer(train, [RATING])

    def encode(part: DataFrame) -> DataFrame:
        part = part.drop(CUSTOMER_ID)
        if not vectors:
            return standardizer.replace(dictionary.index(part, keep_index or "_index").drop(*categorical))
        return standardizer.replace(dictionary.one_hot(part, keep_index, then))

    return Prepared(encode(train), encode(test), dictionary, standardizer)


def first_slots(df: DataFrame) -> DataFrame:
    """Every vector column reduced to its first slot."""
    vectors = [f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT)]
    return df.withColumns({c: first_slot(vector_head(F.col(f"`{c}`"))) for c in vectors})


def cached(df: DataFrame, place: list[Column], partitions: int | None = None) -> DataFrame:
    """Fill a spillable cache for iterative work, dealt and ordered by a hash of the cells ``place``.

    A forest's bootstrap follows the order of the rows in their partitions.  By a hash they
    are the same for any number of cores and any split of the input; unless ``partitions`` is given,
    there are as many as the number of rows asks for.
    """
    if partitions is None:
        partitions = max(FOREST_PARTITIONS, -(-df.count() // FOREST_ROWS))
    spread = df.withColumn("_place", F.xxhash64(*place))
    spread = spread.repartition(partitions, "_place").sortWithinPartitions("_place").drop("_place")
    spread = spread.persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    return spread


@dataclass
class ModelFrame:
    """One cached frame for all targets: features ``{c}`` and labels ``{c}_y``, and the packed rows made of it."""

    train: DataFrame
    test: DataFrame
    categorical: list[str]
    rating: str = f"{RATING}_scaled"
    stored: list[DataFrame] = field(default_factory=list)
    widths: dict[str, int] = field(default_factory=dict)
    flatten: bool = False
    bags: dict[tuple, forest.Bag] = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)

    @property
    def targets(self) -> list[str]:
        return [*self.categorical, self.rating]

    def release(self) -> None:
        for part in [*self.stored, *self.bags.values()]:
            part.unpersist()

    def coded(self, part: DataFrame) -> DataFrame:
        """Stored rows with the columns that codes are made of: the slot, or the first slot, of each attribute, the rating and its label."""
        return part.withColumnsRenamed({} if self.flatten else {f"{c}_y": c for c in self.categorical})

    def bag(self, target: str, trees: int, seed: int) -> forest.Bag:
        """The training rows whose label is known, with their counts per tree; all attributes with a label in every row share one."""
        key = target == self.rating, trees, seed
        with self.lock:
            if key not in self.bags:
                self.bags[key] = self._bag(*key)
            return self.bags[key]

    def _bag(self, numeric: bool, trees: int, seed: int) -> forest.Bag:
        known, label = self.coded(self.stored[0]), f"{self.rating}_y"
        if numeric:
            known = known.where(F.col(label).isNotNull())
        rows, wrong = known.agg(F.count(F.lit(1)), F.count_if(F.isnan(self.rating))).first()
        if not rows or wrong:
            raise ValueError(f"{rows} training rows, of which {wrong} have NaN as rating: no forest can be grown")
        numbers = ([*self.categorical] if self.flatten else []) + ([] if numeric else [self.rating])
        placed = forest.thresholds(known, numbers, rows, seed) if numbers else {}
        found = [forest.Attribute(c, 0 if c in placed else self.widths[c], placed.get(c)) for c in self.targets if c != self.rating or not numeric]
        if self.flatten and not numeric:
            # A label is the code of its attribute wherever that tells 0 from 1.
            apart = [c for c in self.categorical if not (len(placed[c]) == 1 and 0 <= placed[c][0] < 1)]
            known = known.withColumns({f"{c}_y": F.col(f"`{c}`") for c in apart})
            found += [forest.Attribute(f"{c}_y", 1) for c in apart]
        return forest.pack_bag(known, found, rows, trees, seed, label if numeric else None, merge=self.flatten)


def model_frame(df: DataFrame, key: str = ROW_KEY, flatten: bool = False) -> ModelFrame:
    """Encode once and cache once, for every target.

    Null is a category of its own.  ``flatten`` reduces each attribute to its first
    slot ("is it category 0?"), as a feature and as a label.  Vectors are neither shuffled nor
    cached: they are made of the indexes beside them whenever rows are read.
    """
    made = prepare(df, key, null_slot=True, keep_index="_y", vectors=False)
    columns, widths, rating = made.dictionary.columns, made.dictionary.widths, f"{RATING}_scaled"

    def dealt(part: DataFrame) -> DataFrame:
        # An unknown rating is 0 as a feature (the training mean) and stays null as a label.
        known = [F.coalesce(rating, F.lit(0.0)).alias(rating), F.col(rating).alias(f"{rating}_y")]
        if flatten:
            kept = [(F.col(f"`{c}_y`") == 0).cast("byte").alias(c) for c in columns]
            cells = 2 * [F.col(f"`{c}`").cast("double") for c in columns]
        else:
            kept = [F.col(f"`{c}_y`").cast("int").alias(f"{c}_y") for c in columns]
            # The cells of a sparse vector, and the index.
            cells = [x for c in columns for x in _vector_cells(F.col(f"`{c}_y`"), widths[c])]
            cells += [F.col(f"`{c}_y`").cast("double") for c in columns]
        # Fractions are rounded: the last digits of a fitted mean follow the order in which it was summed.
        cells += [F.round(F.col(c), 6) for c in (rating, f"{rating}_y")]
        # The joins that made the indexes end here: compiled together with the hash, both run several times as long.
        return cached(materialised(part.select(*kept, *known), "encoded"), cells)

    stored = [dealt(made.train), dealt(made.test)]
    ratings = [F.col(rating), F.col(f"{rating}_y")]

    def shaped(part: DataFrame) -> DataFrame:
        if flatten:
            binary = {"ml_attr": {"type": "nominal", "num_vals": 2}}
            slots = [F.col(f"`{c}`").cast("double") for c in columns]
            return part.select(*[x.alias(c) for x, c in zip(slots, columns)], *[x.alias(f"{c}_y", metadata=binary) for x, c in zip(slots, columns)], *ratings)
        indexed = part.select(*[made.dictionary.stated(F.col(f"`{c}_y`"), c, "_y") for c in columns], *ratings)
        return made.dictionary.vectors(indexed, "_y").select(*columns, *[f"{c}_y" for c in columns], *ratings)

    return ModelFrame(*map(shaped, stored), columns, rating, stored, widths, flatten)


def _vector_cells(slot: Column, width: int) -> list[Column]:
    """What a hash of the one-hot vector of a slot goes by: its kind, its size, and index and value of the one entry."""
    inside = slot < width
    return [F.lit(0).cast("byte"), F.lit(width), F.when(inside, slot), F.when(inside, F.lit(1.0))]


def fit_target(frame: ModelFrame, target: str, trees: int = 20, depth: int = 5, seed: int = 42) -> forest.Forest:
    """A forest for one target on all other attributes: regression for the rating."""
    bag = frame.bag(target, trees, seed)
    places = {a.name: i for i, a in enumerate(bag.attributes)}
    inputs = tuple(places[c] for c in frame.targets if c != target)
    numeric = target == frame.rating
    label = None if numeric else places.get(f"{target}_y", places[target])
    classes = 0 if numeric else 2 if frame.flatten else frame.widths[target] + 1
    task = forest.Task(tuple(bag.attributes), inputs, label, classes)
    return forest.Forest(task, forest.grow(bag, task, depth, seed), labelCol=f"{target}_y", maxDepth=depth, seed=seed)


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Feature vector and label of the rows whose label is known."""
    known = df.where(F.col(label).isNotNull())
    return VectorAssembler(inputCols=features, outputCol="features").transform(known).select("features", label)


def predict(model: forest.Forest | Model, frame: ModelFrame, target: str) -> DataFrame:
    """Predictions for the test rows, beside the true label; ``model`` may be one of ``pyspark.ml`` too."""
    if isinstance(model, forest.Forest):
        rows = frame.coded(frame.stored[1])
        if target != frame.rating:
            return model.score(rows.withColumn(f"{target}_y", F.col(f"`{target}`")), f"{target}_y")
        return model.score(rows.where(F.col(f"{target}_y").isNotNull()), f"{target}_y")
    features = [c for c in frame.targets if c != target]
    test = assemble(frame.test, features, f"{target}_y")
    return model.transform(test).select(F.col(f"{target}_y").alias("label"), "prediction")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, accuracy, f1, weighted precision and recall, from one confusion count.

    Each (label, prediction, n) cell is booked once under its label and once under its
    prediction; a class that is never predicted has precision 0.
    """
    cells = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    booked = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), right.alias("tp"), F.lit(0).cast("long").alias("guessed")),
                F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("guessed")),
            )
        )
    )
    classes = booked.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("guessed").alias("guessed")
    )
    tp, zero = F.col("tp").cast("double"), F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, F.col("guessed")), zero)
    recall = F.coalesce(F.try_divide(tp, F.col("support")), zero)
    scored = classes.select("support", "tp", precision.alias("p"), recall.alias("r")).withColumn(
        "f", F.coalesce(F.try_divide(F.lit(2.0) * F.col("p") * F.col("r"), F.col("p") + F.col("r")), zero)
    )
    weighted = {"f1": "f", "weighted_precision": "p", "weighted_recall": "r"}
    return scored.agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        *[
            F.try_divide(F.sum(F.col("support") * F.col(c)), F.sum("support")).alias(name)
            for name, c in weighted.items()
        ],
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n and the root of the mean squared error."""
    error = F.col(label) - F.col(prediction)
    return df.agg(F.count(error).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))


def side_by_side(rows: int, threads: int) -> int:
    """How many forests to fit at a time: fewer on more rows, which keep all cores busy by themselves."""
    return max(1, min(threads, FITTED_ROWS // max(rows, 1)))


def fit_and_score(frame: ModelFrame, targets: list[str], threads: int = 4, **forest) -> DataFrame:
    """One forest per target; one row per target and metric.

    Up to ``threads`` forests are fitted at a time, as far as ``FITTED_ROWS`` allows; the scores do not depend on it.
    """

    def score(target: str) -> list[tuple[str, str, float]]:
        predicted = predict(fit_target(frame, target, **forest), frame, target)
        metrics = regression_metrics if target == frame.rating else classification_metrics
        row = metrics(predicted).first().asDict()
        return [(target, m, float(v)) for m, v in row.items() if v is not None]

    spark = frame.train.sparkSession
    rows = run_parallel(spark, [lambda t=t: score(t) for t in targets], side_by_side(frame.train.count(), threads))
    return spark.createDataFrame(
        [r for part in rows for r in part], "target string, metric string, value double"
    )


def predict_all_targets(
    df: DataFrame,
    targets: list[str] | None = None,
    key: str = ROW_KEY,
    flatten: bool = False,
    threads: int = 4,
    **forest,
) -> DataFrame:
    """Predict each attribute from all others; the encoded rows are shared and then released.

    ``key`` is the column whose value decides between training and test rows.
    """
    frame = model_frame(df, key, flatten)
    try:
        return fit_and_score(frame, targets or frame.targets, threads, **forest)
    finally:
        frame.release()
