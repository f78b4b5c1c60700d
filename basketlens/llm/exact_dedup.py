"""Exact duplicates by content sort.

Rows are range-partitioned by sampled splitters over (start of the normalised bytes, digest,
length, id) and sorted externally, so that equal texts stand side by side, however many there
are: a large group of copies runs on over several partitions instead of filling one.  Each task
walks its rows once and compares neighbours in full.  Only the first and the last run of a
partition can go on elsewhere; their leaders (two rows a partition) are grouped by whole text.

Defined results: a null text is an empty one; empty texts are equal to each other; rows without
an id come last among ties; a repeated row is a copy like any other, and one of them stays.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.common import SPACE, partitions, saved, text_of

#: Characters of the text in a splitter; with the digest they bound what the driver samples.
HEAD = 32
_SPACES = re.compile(SPACE + "+")


def normalised(text: str) -> str:
    return _SPACES.sub("", text)


def _ordered(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """Rows in content order: ``_n`` code points, ``_sha`` digest, ``_text`` and the carried columns."""
    body = F.regexp_replace(text_of(text), SPACE + "+", "")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry],
        F.col(f"`{key}`").alias("_id"),
        text_of(text).alias("_text"),
        F.length(text_of(text)).cast("long").alias("_n"),
        F.sha2(body, 256).alias("_sha"),
        F.substring(body, 1, HEAD).alias("_head"),
    )
    order = ["_head", "_sha", F.desc("_n"), F.asc_nulls_last("_id")]
    return rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)


def _run_starts(batch: pa.RecordBatch, last: tuple[str, str] | None) -> list[bool]:
    """Whether each row differs from the one before it; equal digests are compared in full."""
    shas, texts = batch.column("_sha").to_pylist(), batch.column("_text")
    starts = []
    for i, sha in enumerate(shas):
        before = last if i == 0 else (shas[i - 1], None)
        if before is None or before[0] != sha:
            starts.append(True)
            continue
        other = before[1] if i == 0 else texts[i - 1].as_py()
        here = texts[i].as_py()
        starts.append(here != other and normalised(here) != normalised(other))
    return starts


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row: its run's keeper and size; ``_edge`` where the run may go on elsewhere."""
    pid, kind, last = TaskContext.get().partitionId(), None, None
    run: dict | None = None
    runs = 0
    out: list[list] = [[] for _ in range(9)]

    def close(edge: int | None) -> None:
        ids = run["ids"]
        size = len(ids)
        for column, values in zip(
            out,
            (
                ids,
                [ids[0]] * size,
                [run["n"]] * size,
                [size] * size,
                [True] + [False] * (size - 1),
                [run["sha"]] * size,
                [pid] * size,
                [edge] * size,
                [None if edge is None else run["text"]] + [None] * (size - 1),
            ),
            strict=True,
        ):
            column.extend(values)

    def flush() -> pa.RecordBatch:
        types = [kind, kind, pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=_NAMES)
        for column in out:
            column.clear()
        return done

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("_id").type
        ids, ns = batch.column("_id").to_pylist(), batch.column("_n").to_pylist()
        shas, texts = batch.column("_sha").to_pylist(), batch.column("_text")
        for i, new in enumerate(_run_starts(batch, last)):
            if new:
                if run is not None:
                    close(0 if runs == 1 else None)
                runs += 1
                run = {"ids": [], "n": ns[i], "sha": shas[i], "text": normalised(texts[i].as_py())}
            run["ids"].append(ids[i])
        last = (shas[-1], texts[len(shas) - 1].as_py())
        if len(out[0]) > 10_000:
            yield flush()
    if run is not None:
        close(0 if runs == 1 else 1)
        yield flush()


_NAMES = ["_id", "keep_id", "keep_n", "group_size", "leads", "text_sha256", "_pid", "_edge", "_body"]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run, with ``_edge`` where the run may go on elsewhere."""
    pid, last, held, runs = TaskContext.get().partitionId(), None, None, 0

    def out(batch: pa.RecordBatch, edges: list[int | None]) -> pa.RecordBatch:
        kept = batch.drop_columns(["_sha", "_head"])
        kept = kept.append_column("_pid", pa.array([pid] * kept.num_rows, pa.int32()))
        return kept.append_column("_edge", pa.array(edges, pa.int32()))

    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.filter(pa.array(_run_starts(batch, last)))
        last = (batch.column("_sha")[-1].as_py(), batch.column("_text")[-1].as_py())
        if not found.num_rows:
            continue
        if held is not None:
            yield out(held, [0 if runs == 1 else None])
        if found.num_rows > 1:
            yield out(found.slice(0, found.num_rows - 1), [0 if runs + i == 0 else None for i in range(found.num_rows - 1)])
        held, runs = found.slice(found.num_rows - 1), runs + found.num_rows
    if held is not None:
        yield out(held, [0 if runs == 1 else 1])


def _best() -> list:
    """Order in which the leaders of one group stand: most code points, then smallest id."""
    return [(-F.col("_n")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col("_pid").alias("d"), F.col("_edge").alias("e")]


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256 of the normalised text."""
    rows = _ordered(docs, key, text, []).select("_id", "_text", "_n", "_sha")
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("_id", kind),
            T.StructField("keep_id", kind),
            T.StructField("keep_n", T.LongType()),
            T.StructField("group_size", T.LongType()),
            T.StructField("leads", T.BooleanType()),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("_pid", T.IntegerType()),
            T.StructField("_edge", T.IntegerType()),
            T.StructField("_body", T.StringType()),
        ]
    )
    marked = saved(rows.mapInArrow(_members, schema), "content-runs")
    fixed = [F.col("_id").alias(key), "keep_id", "group_size", "kept", "text_sha256"]
    whole = marked.filter("_edge is null").withColumn("kept", F.col("leads")).select(*fixed)
    edges = marked.filter("_body is not null").select("_pid", "_edge", "_body", F.col("keep_id").alias("_id"), F.col("keep_n").alias("_n"), "group_size")
    groups = edges.groupBy("_body").agg(F.sum("group_size").alias("size"), F.min(F.struct(*_best())).alias("best"))
    stitched = edges.join(groups, "_body").select("_pid", "_edge", "size", "best")
    open_rows = (
        marked.filter("_edge is not null")
        .drop("keep_id", "group_size")
        .join(stitched, ["_pid", "_edge"])
        .withColumn("keep_id", F.col("best.c"))
        .withColumn("group_size", F.col("size"))
        .withColumn("kept", F.col("leads") & (F.col("best.d") == F.col("_pid")) & (F.col("best.e") == F.col("_edge")))
        .select(*fixed)
    )
    return whole.unionByName(open_rows)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose normalised text an earlier row in content order has."""
    carry = docs.columns
    rows = _ordered(docs, key, text, carry)
    extra = [T.StructField("_pid", T.IntegerType()), T.StructField("_edge", T.IntegerType())]
    schema = T.StructType([f for f in rows.schema if f.name not in ("_sha", "_head")] + extra)
    first = saved(rows.mapInArrow(_leaders, schema), "content-leaders")
    back = [F.col(f"`c_{c}`").alias(c) for c in carry]
    edges = first.filter("_edge is not null").withColumn("_body", F.regexp_replace("_text", SPACE + "+", ""))
    groups = edges.groupBy("_body").agg(F.min(F.struct(*_best())).alias("best"))
    best = groups.select(F.col("best.d").alias("_pid"), F.col("best.e").alias("_edge"))
    return first.filter("_edge is null").select(*back).unionByName(first.join(best, ["_pid", "_edge"]).select(*back))
