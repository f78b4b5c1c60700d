"""Hard negatives: for an anchor and each of its positives, the best rows of other labels in a window below the positive.

Scores are integer inner products of quantised vectors.  The method: several candidates travel in one
wide integer.  For each component, the candidates' values are biased to be non-negative and laid
into separated fields; an anchor multiplies each of these integers once by its own biased
component and adds them up, so that one multiplication serves all candidates of the pack.
A field is wide enough for the largest sum that can arise, no carry crosses into the next, and taking the biases
off again gives every exact score.

Anchors are a stated query set.  They are taken in chunks of a fixed number of components, which each
task receives; candidates are read in place and never shuffled by label, so a label with a third of all
rows is no burden.  A task keeps, per anchor and positive, only as many rows as are wanted, and a
window merges what the tasks found.  Per chunk there are two passes: positives from packs that
hold the anchor's label, then negatives from packs that hold another one.

Defined results: rows without an id, a label or a vector, and rows with a null or non-finite component, take no
part; a vector that is shorter than another is continued by zeros; anchors equal in id, label
and vector count once, other repeated rows each count; another row is one with another id; ties go to the
smaller id; anchors without a positive and positives without a negative give no rows; an empty table gives none; scores
beyond 64 bits are an error.  Columns besides id, vector and label are ignored.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import discard, partitions, saved, tidy_shuffles
from basketlens.session import work_path

#: Factor of the quantisation: a component x becomes floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score as percent of the positive's: least and most.
LEAST, MOST = 50, 95
#: Candidates in one wide integer.
PACK = 4096
#: Components of all anchors of a chunk together: what a task receives, at 8 bytes each.
CHUNK_COMPONENTS = 1_000_000


@dataclass
class Anchors:
    """Anchors of one chunk, with the scores of their positives in the second pass."""

    ids: list[int]
    labels: list[str]
    vectors: list[list[int]]
    positives: list[list[int]]

    @property
    def bias(self) -> int:
        return max(0, -min((min(v) for v in self.vectors if v), default=0))

    @property
    def largest(self) -> int:
        return max((max(v) for v in self.vectors if v), default=0)


class Pack:
    """Candidates side by side in one wide integer per component."""

    def __init__(self, ids: np.ndarray, labels: list[str], vectors: list[list[int]], anchors: Anchors):
        self.ids = ids
        self.index: dict[str, int] = {}
        self.codes = np.array([self.index.setdefault(x, len(self.index)) for x in labels], np.int32)
        self.length = max(map(len, vectors), default=0)
        columns = [[v[j] if j < len(v) else 0 for v in vectors] for j in range(self.length)]
        self.bias = max(0, -min((min(c) for c in columns), default=0))
        self.anchor_bias = anchors.bias
        largest = max((max(c) for c in columns), default=0) + self.bias
        bound = max(self.length * (anchors.largest + self.anchor_bias), 1) * max(largest, 1)
        # A field holds the sum over all components; 32 and 64 bits are read back by numpy.
        self.bits = 32 if bound < 1 << 32 else -(-bound.bit_length() // 64) * 64
        self.words = [self._laid_out(c) for c in columns]
        self.sums = np.array([sum(v) for v in vectors], np.int64 if self.bits <= 64 else object)

    def _laid_out(self, column: list[int]) -> int:
        biased = (x + self.bias for x in column)
        if self.bits <= 64:
            return int.from_bytes(np.fromiter(biased, f"<u{self.bits // 8}", len(column)).tobytes(), "little")
        return int.from_bytes(b"".join(x.to_bytes(self.bits // 8, "little") for x in biased), "little")

    def scores(self, vector: list[int]) -> np.ndarray:
        """Exact inner products of an anchor with all candidates."""
        given = (vector + [0] * (self.length - len(vector)))[: self.length]
        total = sum((x + self.anchor_bias) * word for x, word in zip(given, self.words) if x + self.anchor_bias)
        width = self.bits // 8
        raw = total.to_bytes(width * len(self.ids), "little")
        shared = self.bias * sum(given) + self.length * self.anchor_bias * self.bias
        if self.bits <= 64:
            # Below the bound all differences are exact, also where the sum fills 64 bits.
            fields = np.frombuffer(raw, f"<u{width}").astype(np.uint64).view(np.int64)
            with np.errstate(over="ignore"):
                return fields - np.int64(self.anchor_bias) * self.sums - np.uint64(shared).astype(np.int64)
        return np.array([int.from_bytes(raw[i : i + width], "little") for i in range(0, len(raw), width)], object) - self.anchor_bias * self.sums - shared


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest scores as (-score, id), ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        scores, ids = scores[kept], ids[kept]
    return heapq.nsmallest(k, zip((-scores).tolist(), ids.tolist()))


def _packs(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: int) -> Iterator[Pack]:
    """Rows of a task, which come sorted by label, in packs."""
    for batch in batches:
        for start in range(0, batch.num_rows, PACK):
            part = batch.slice(start, PACK)
            vectors = [_quantised(v, scale) for v in part.column(2).to_pylist()]
            yield Pack(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_pylist(), vectors, anchors)


def _quantised(vector: list[float], scale: int) -> list[int]:
    return [floor(scale * float(x)) for x in vector]


_POSITIVE = "anchor int, id long, score long"


def _positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    best: dict[int, list[tuple[int, int]]] = {}
    for pack in _packs(batches, anchors, scale):
        for a, label in enumerate(anchors.labels):
            if label in pack.index:
                other = (pack.codes == pack.index[label]) & (pack.ids != anchors.ids[a])
                found = _best(pack.scores(anchors.vectors[a])[other], pack.ids[other], k)
                best[a] = heapq.nsmallest(k, [*best.get(a, ()), *found])
    rows = [(a, i, -s) for a, found in best.items() for s, i in found]
    yield _batch(rows, ("anchor", "id", "score"))


_NEGATIVE = "anchor int, bar long, id long, score long"


def _negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int, scale: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """The best rows below each distinct score of an anchor's positives (its bar)."""
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for pack in _packs(batches, anchors, scale):
        for a, label in enumerate(anchors.labels):
            bars = [(x, -(-least * x // 100), most * x // 100) for x in anchors.positives[a]]
            bars = [(x, low, high) for x, low, high in bars if low <= high]
            if not bars or set(pack.index) == {label}:
                continue
            scores = pack.scores(anchors.vectors[a])
            near = (scores >= min(b[1] for b in bars)) & (scores <= max(b[2] for b in bars)) & (pack.codes != pack.index.get(label, -1))
            scores, ids = scores[near], pack.ids[near]
            for bar, low, high in bars:
                inside = (scores >= low) & (scores <= high)
                found = _best(scores[inside], ids[inside], k)
                if found:
                    best[a, bar] = heapq.nsmallest(k, [*best.get((a, bar), ()), *found])
    rows = [(a, bar, i, -s) for (a, bar), found in best.items() for s, i in found]
    yield _batch(rows, ("anchor", "bar", "id", "score"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    types = [pa.int32() if name == "anchor" else pa.int64() for name in names]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _first(found: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """The k best rows of each group, from the k best of every task."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among the rows.

    ``rows`` has id, vector and label; ``is_anchor`` is a condition on them.  Work is anchors
    times rows by its nature; memory is a chunk of anchors and a pack of candidates.
    """
    spark = rows.sparkSession
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    given = rows.where(is_anchor.isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    given = given.select(F.col("id").cast("long"), F.col("label").cast("string"), "vector", is_anchor.alias("is_anchor"))
    spread = given.repartition(partitions(spark), F.xxhash64("id", "vector")).sortWithinPartitions("label")
    table = saved(spread, "candidates")
    candidates = table.select("id", "label", "vector")
    queries = saved(table.where("is_anchor").select("id", "label", "vector").distinct(), "anchors")
    # Beside its components an anchor costs about as much as some more of them.
    components = queries.agg(F.sum(F.size("vector") + 16)).first()[0] or 0
    chunks = -(-components // CHUNK_COMPONENTS)
    path = work_path(spark, "negatives")
    place = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(chunks, 1)))
    spark.createDataFrame([], _RESULT).write.parquet(f"{path}/part=-1")
    for chunk in range(chunks):
        chosen = sorted((r["id"], r["label"], _quantised(r["vector"], scale)) for r in queries.where(place == chunk).collect())
        if not chosen:
            continue
        ids, labels, vectors = (list(x) for x in zip(*chosen))
        anchors = Anchors(ids, labels, vectors, [[] for _ in ids])
        found = candidates.mapInArrow(partial(_positives, anchors=anchors, k=positives, scale=scale), _POSITIVE)
        best = _first(found, ("anchor",), positives).collect()  # a few rows for each anchor of the chunk
        for r in best:
            anchors.positives[r["anchor"]].append(r["score"])
        anchors.positives = [sorted(set(p)) for p in anchors.positives]
        search = partial(_negatives, anchors=anchors, k=negatives, scale=scale, least=least, most=most)
        below = _first(candidates.mapInArrow(search, _NEGATIVE), ("anchor", "bar"), negatives)
        pairs = [(r["anchor"], ids[r["anchor"]], r["id"], r["score"]) for r in best]
        above = spark.createDataFrame(pairs, "anchor int, anchor_id long, positive_id long, bar long")
        made = above.join(below, ["anchor", "bar"]).select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            F.col("bar").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
        with tidy_shuffles(spark):
            made.write.parquet(f"{path}/part={chunk}")
    result = spark.read.schema(f"{_RESULT}, part int").parquet(path).drop("part")
    discard(table, queries)
    return result


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
