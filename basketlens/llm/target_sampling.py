"""Sampling documents towards a target distribution: importance weights of hashed n-grams, Gumbel noise, the highest scores.

The method: separators collapse to single spaces, and ``finditer`` with ``overlapped=True`` and
lookarounds at both ends of an n-gram gives the byte spans of all runs of words directly, which
go to CRC-32 without word lists or joined strings.  Counts of all documents and of all
target texts make a gain per bucket; a document's weight is the mean gain of its n-grams; with Gumbel
noise from a digest of its id the highest scores are a draw without replacement.

One pass counts (a task sends at most one row per bucket), one pass weighs against the table
of gains, whose size is fixed by ``buckets``.  Ranks are places in files written in order, so no task sorts
or counts all documents.

Defined results: a null text has no words, weight 0 and is never drawn; a null id is read as an empty
one for the noise and sorts first among equal scores; rows that are repeated are drawn as often as they stand there;
a very long text is scanned whole, and held as its bytes and its distinct n-grams; an empty
table, on either side, gives gains from the other one and no failure.  Columns besides ``doc_id`` and
``text`` are ignored, so none can clash.
"""

from collections import Counter
from collections.abc import Iterator
from functools import cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import discard, partitions, saved, text_of, tidy_shuffles
from basketlens.session import work_path
from basketlens.sources.files import written_positions

BUCKETS = 10_000
#: Share of the documents to draw, as a fraction of whole numbers, and fewest words of a drawn one.
DRAW, OF = 10, 100
FEWEST_WORDS = 20
SEED = 2024

# Words are runs of ASCII letters and digits and of all characters beyond ASCII.
_IN_WORDS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: What becomes of each byte: ASCII letters in lower case, separators as spaces.
_BYTES = bytes(b if b in _IN_WORDS else 0x20 for b in bytes(range(0x100)).lower())
_SPACES = regex.compile(rb"  +")


@cache
def _pattern(n: int) -> regex.Pattern:
    """n words joined by single spaces, from the start of a word to the end of one."""
    return regex.compile(rb"(?<![^ ])" + rb" ".join([rb"[^ ]++"] * n) + rb"(?![^ ])")


def collapsed(text: str) -> bytes:
    """ASCII letters in lower case, runs of separators as single spaces, none at the ends."""
    return _SPACES.sub(b" ", text.encode().translate(_BYTES)).strip(b" ")


def spans(body: bytes, lowest: int, highest: int) -> Iterator[bytes]:
    """All runs of ``lowest`` to ``highest`` consecutive words, also those that overlap."""
    for n in range(lowest, highest + 1):
        yield from map(regex.Match.group, _pattern(n).finditer(body, overlapped=True))


def _bucket_counts(text: str, lowest: int, highest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the distinct n-grams of a text, how often each occurs, and the number of words."""
    body = collapsed(text)
    found = Counter(spans(body, lowest, highest))
    places = np.fromiter(map(crc32, found), np.int64, len(found)) % buckets
    return places, np.fromiter(found.values(), np.int64, len(found)), body.count(b" ") + 1 if body else 0


def _count(batches: Iterator[pa.RecordBatch], lowest: int, highest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for text in batch.column(0):
            places, n, _ = _bucket_counts(text.as_py(), lowest, highest, buckets)
            np.add.at(total, places, n)
    held = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})


def bucket_counts(docs: DataFrame, lowest: int = 1, highest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """How many n-grams of all texts fall into each bucket: (bucket, n)."""
    count = partial(_count, lowest=lowest, highest=highest, buckets=buckets)
    texts = docs.select(text_of().alias("text")).mapInArrow(count, "bucket long, n long")
    return texts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, lowest: int = 1, highest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Thousandths of the log ratio of the smoothed shares of target and documents, for every bucket."""
    s = bucket_counts(docs, lowest, highest, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, lowest, highest, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    # Three tables of one row per bucket, written so that the texts are counted once.
    table = saved(every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"]).coalesce(1), "buckets")
    whole = table.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = F.col("s").cast("double") + 1, F.col("t").cast("double") + 1
    ratio = t * F.lit(float(whole["s"] + buckets)) / (s * F.lit(float(whole["t"] + buckets)))
    return table.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, lowest: int, highest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            places, n, words = _bucket_counts(text.as_py(), lowest, highest, len(gain))
            features = int(n.sum())
            rows.append((features, int(gain[places] @ n) // features if features else 0, words))
        features, weights, words = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n_features": pa.array(features, pa.int64()),
                "weight": pa.array(weights, pa.int64()),
                "n_words": pa.array(words, pa.int64()),
            }
        )


def weights(docs: DataFrame, gain: DataFrame, lowest: int = 1, highest: int = 1) -> DataFrame:
    """(doc_id, n_features, weight, n_words) of every document; ``gain`` has a row for every bucket."""
    rows = gain.orderBy("bucket").collect()  # as many as there are buckets
    table = np.array([r["gain"] for r in rows], np.int64)
    weigh = partial(_weigh, gain=table, lowest=lowest, highest=highest)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(weigh, "doc_id long, n_features long, weight long, n_words long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    lowest: int = 1,
    highest: int = 1,
    buckets: int = BUCKETS,
    draw: int = DRAW,
    of: int = OF,
    fewest_words: int = FEWEST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank (null for one that is not drawn)."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(2.0**32))))
    weighed = weights(docs, gains(docs, target, lowest, highest, buckets), lowest, highest)
    scored = saved(
        weighed.select(
            "doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= fewest_words).alias("fit")
        ),
        "scores",
    )
    drawn = scored.where("fit").count() * draw // of
    # Rows that agree in all that is ordered may be many; the last key lets them be split.
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight", "_row"]
    path = work_path(spark, "ranked")
    spread = scored.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order)
    with tidy_shuffles(spark):
        spread.sortWithinPartitions(*order).drop("_row").write.parquet(path)
    discard(scored)
    place = F.col("position") + 1
    ranked = written_positions(spark, path)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (place <= drawn), place).alias("rank"))
