"""From raw documents to encoded training text: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import catalog, exact_dedup, language_id, mixing, ngram_join, pieces
from basketlens.llm.common import saved, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; a text that is null or has no letter is rejected."""
    catalog.ship(spark)
    found = language_id.identify(docs, language_id.fit_on_rest(docs))
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest original, then the smallest id, of each normalised text."""
    catalog.ship(spark)
    return exact_dedup.exact_dedup(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    catalog.ship(spark)
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: mostly toxic text gives way; every other document, and any that is labelled clean, stays at least once."""
    rates = catalog.mixing_rates(docs, table(spark, sf_dir, "labels")).filter("copies > 0")
    copies = rates.groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    kept = docs.join(copies.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return kept.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with the check that they decode to it."""
    catalog.ship(spark)
    vocabulary = pieces.Vocabulary.load(catalog.VOCABULARY)
    both = pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, back=True)
    return both.select(
        "row.doc_id",
        "row.lang",
        "row.source",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        F.col("decoded").eqNullSafe(F.col("row.text")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_contents),
    ("mixing to target weights", mixed),
    ("piece encoding", encoded),
]

#: Fitted models and merge-by-similarity stages cannot be stated as one SQL query; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
