"""Repeated passages by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; where its low bits are zero, a chunk ends.  The
hash sees the last 32 bytes alone, so a passage is cut at the same places wherever it stands and
chunks fall into step again after an insertion.  Chunks are deduplicated by digest: the first
occurrence (smallest id, then place) stays.  Consecutive repeated chunks make one passage; a passage
counts when it has at least ``LEAST`` characters, so that short chunks that agree by chance do not.

Digests are spread by ranges of (digest, id, place), so that the occurrences of one digest, however
many, run over several tasks; where they do, the first rows of the tasks are stitched by digest.

Defined results: a null text is empty and has no chunks; within a text the first occurrence stays as
well; a repeated row repeats all passages of the first one; rows without an id come after all others.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import partitions, saved

#: One place in so many ends a chunk (a power of two), and characters of a passage that counts.
EVERY, LEAST = 32, 80
#: Bytes that are hashed at a time.
PIECE = 4 << 20
_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks (exclusive, in bytes), never inside a character; the last is the end of the text."""
    ends = []
    for first in range(0, len(raw), PIECE):
        part = raw[max(0, first - 31) : first + PIECE + 3]
        gear = _GEAR[part]
        h = gear.copy()
        step = 1
        while step < 32:
            # Doubling: the sum over the last 2 * step bytes from two sums over step bytes.
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
        hit = np.flatnonzero((h >> np.uint32(32 - EVERY.bit_length() + 1)) == 0) + 1 + max(0, first - 31)
        ends.append(hit[(hit > first) & (hit <= first + PIECE)])
    places = np.concatenate([np.zeros(0, np.int64), *ends])
    inside = places < len(raw)
    while True:
        # A chunk that would end inside a character ends behind it.
        split = inside & (raw[np.minimum(places, max(0, len(raw) - 1))] & 0xC0 == 0x80)
        if not split.any():
            break
        places = places + split
        inside = places < len(raw)
    return np.unique(np.append(places, len(raw))) if len(raw) else places


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digest) of each chunk of a text, in code points."""
    data = text.encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    ends = cut_places(raw)
    if not len(ends):
        return []
    chars = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))
    begins = np.concatenate(([0], ends[:-1]))
    return [(int(chars[a]), int(chars[b]), xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63)) for a, b in zip(begins, ends, strict=True)]


_CHUNKS = "id bigint, row bigint, no int, start bigint, end bigint, digest bigint"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chunks(t or "") for t in batch.column("_text").to_pylist()]
        sizes = [len(f) for f in found]
        owner = np.repeat(np.arange(len(found)), sizes)
        flat = np.array([c for f in found for c in f], np.int64).reshape(-1, 3)
        no = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in sizes]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(owner)), batch.column("row").take(pa.array(owner)), pa.array(no, pa.int32()), *[pa.array(flat[:, k]) for k in range(3)]],
            names=["id", "row", "no", "start", "end", "digest"],
        )


_MARKED = "id bigint, row bigint, no int, start bigint, end bigint, digest bigint, first_id bigint, first_row bigint, first_no int, first_start bigint, _pid int, _edge boolean"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of digest, id and place: all but the first of a digest, with the first; the first run of
    a task whole (``_edge``), since it may go on from the task before; and the last digest's first row."""
    pid, lead, runs = TaskContext.get().partitionId(), None, 0
    held = None

    def out(batch: pa.RecordBatch, firsts: np.ndarray, edge: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.flatnonzero(keep))
        columns = [batch.column(c).take(at) for c in ("id", "row", "no", "start", "end", "digest")]
        lead_rows = pa.Table.from_batches([lead_batch for lead_batch in (held, batch) if lead_batch is not None])
        base = held.num_rows if held is not None else 0
        which = pa.array((firsts + base)[keep])
        more = [lead_rows.column(c).take(which).combine_chunks() for c in ("id", "row", "no", "start")]
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([*columns, *more, pa.array([pid] * n, pa.int32()), pa.array(edge[keep])], names=[f.split()[0] for f in _MARKED.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        digest = batch.column("digest").to_numpy(zero_copy_only=False)
        new = np.concatenate(([lead is None or digest[0] != lead], digest[1:] != digest[:-1]))
        number = np.cumsum(new) + runs
        firsts = np.maximum.accumulate(np.where(new, np.arange(len(digest)), -1))
        edge = number == 1
        yield out(batch, firsts, edge, ~new | edge)
        last = int(firsts[-1])
        if last >= 0:
            held = batch.slice(last, 1)
        lead, runs = digest[-1], int(number[-1])
    if held is not None and runs > 1:
        # The first row of the last digest: the next task may hold more of it.
        batch, held = held, None
        yield out(batch, np.zeros(1, np.int64), np.ones(1, bool), np.ones(1, bool))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks that an earlier chunk repeats: id, row, no, start, end and the first occurrence."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = saved(rows.mapInArrow(_cut, _CHUNKS), "chunks")
    order = ["digest", F.asc_nulls_last("id"), "row", "no"]
    dealt = found.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    marked = saved(dealt.mapInArrow(_repeats, _MARKED), "chunk-repeats")
    # Edge rows: one digest at most at either end of a task, so a digest is stitched over its leaders.
    edges = marked.filter("_edge")
    best = F.struct(F.col("first_id").isNull().alias("a"), F.col("first_id").alias("b"), F.col("first_row").alias("c"), F.col("first_no").alias("d"), F.col("first_start").alias("e"))
    firsts = edges.groupBy("digest").agg(F.min(best).alias("best"))
    # Rows of a digest inside the last run of a task carry that run's first; the stitched first replaces both.
    whole = marked.join(firsts, "digest", "left")
    fixed = whole.select(
        "id", "row", "no", "start", "end", "digest",
        F.when(F.col("best").isNull(), F.col("first_id")).otherwise(F.col("best.b")).alias("first_id"),
        F.coalesce("best.c", "first_row").alias("first_row"),
        F.coalesce("best.d", "first_no").alias("first_no"),
        F.coalesce("best.e", "first_start").alias("first_start"),
    )
    return fixed.filter("row <> first_row or no <> first_no")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Passages that repeat earlier text: key, start, end (code points) and the place of their first chunk's first occurrence."""
    rows = repeated_chunks(docs, key, text)
    order = Window.partitionBy("row").orderBy("no")
    islands = rows.withColumn("island", F.col("no") - F.row_number().over(order))
    passages = islands.groupBy("row", "island").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("no", "first_id", "first_start")).alias("from"))
    return passages.filter(F.col("end") - F.col("start") >= least).select(
        F.col("id").alias(key), "row", "start", "end", F.col("from.first_id").alias("first_id"), F.col("from.first_start").alias("first_start")
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` (the scan of a written table) with the repeated passages cut out of the texts; a null text stays null."""
    spans = repeated_passages(docs, key, text, least).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    spans = saved(spans, "passage-cuts")
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    joined = rows.join(spans.withColumnRenamed("row", "_row"), "_row", "left")
    pieces = "transform(sequence(0, size(_cuts)), i -> substring(_t, if(i = 0, 0, _cuts[greatest(i - 1, 0)].end) + 1, if(i = size(_cuts), length(_t), _cuts[least(i, size(_cuts) - 1)].start) - if(i = 0, 0, _cuts[greatest(i - 1, 0)].end)))"
    kept = F.expr(f"if(_cuts is null, _t, array_join({pieces}, ''))")
    return joined.withColumn("_t", F.col(f"`{text}`").cast("string")).withColumn(text, kept).select(*docs.columns)
