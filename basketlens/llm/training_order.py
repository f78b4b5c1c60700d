"""Token shards in training order.

Token ids of all texts, each followed by an end mark, form one stream in the order of the scan; it is
cut into sequences of a fixed number of tokens.  A keyed Feistel permutation with cycle-walking gives
every sequence a slot, without a table and without sorting.  Sequences go to the shard that holds
their slot and are written there in slot order with a fixed stride, so that a reader finds sequence
``s`` at ``(s % per_shard) * stride`` of shard ``s // per_shard`` and can resume anywhere.

The first pass counts the tokens of each scan task (one row a task), the second cuts and sends whole
sequences; a sequence that runs over from one task to the next is sent as two pieces.  A shard is
written under a temporary name and renamed, so a repeated task replaces it with the same bytes.

Defined results: a null text is empty, and an empty text is its end mark alone; the last sequence is
filled with pad tokens; repeated rows are written as often as they occur; an empty table gives no shard.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.common import discard, saved, text_of, tidy_shuffles
from basketlens.llm.pieces import Encoder, Vocabulary
from basketlens.session import work_path

#: Tokens of a sequence, and bytes of a shard (about).
LENGTH, SHARD_BYTES = 2_048, 16 << 20
#: Fixed values of the byte vocabulary: ids 0-253 are bytes, which UTF-8 never uses beyond 0xF4.
BYTE_END, BYTE_PAD = 255, 254
_ROUNDS = 6


@dataclass(frozen=True)
class Tokens:
    """How a text becomes token ids, their type in the shards, and the ids of the end mark and the padding.

    With ``once`` the ids are written to a table before they are counted and cut, so that no text is encoded twice.
    """

    encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    dtype: str
    end: int
    pad: int
    once: bool = False


def utf8_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, one after the other, and how many each has."""
    raw = [t.encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


UTF8 = Tokens(utf8_ids, "uint8", BYTE_END, BYTE_PAD)


class PieceIds:
    """Piece ids of texts; each process makes one encoder of the broadcast vocabulary."""

    def __init__(self, shared):
        self.shared, self.encoder = shared, None

    def __getstate__(self) -> dict:
        return {"shared": self.shared, "encoder": None}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.encoder = self.encoder or Encoder(self.shared.value)
        return self.encoder.encode(texts)


def piece_tokens(spark: SparkSession, vocabulary: Vocabulary) -> Tokens:
    """Ids of a vocabulary, in two bytes if they fit; its own end and pad pieces, or ids after the last piece where it has none."""
    n = len(vocabulary.pieces)
    control = {p: i for i, (p, normal) in enumerate(zip(vocabulary.pieces, vocabulary.normal, strict=True)) if not normal}
    end, pad = control.get("</s>", n), control.get("<pad>", n + 1)
    return Tokens(PieceIds(spark.sparkContext.broadcast(vocabulary)), "uint16" if max(n - 1, end, pad) < 1 << 16 else "uint32", end, pad, once=True)


def _stored(dtype: str) -> Callable:
    """Reads the ids that ``_encoded`` wrote."""

    def read(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.dtype(dtype).itemsize
        return np.frombuffer(b"".join(values), dtype), np.array([len(v) // size for v in values], np.int64)

    return read


def _encoded(docs: DataFrame, key: str, text: str, tokens: Tokens) -> DataFrame:
    """Written table of key and ids (the bytes of their type)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = tokens.encode(batch.column("_text").to_pylist())
            parts = np.split(ids.astype(tokens.dtype), np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "ids"])

    return saved(_rows(docs, key, text).mapInArrow(run, "id bigint, ids binary"), "token-ids", compression="zstd")


@dataclass(frozen=True)
class Permutation:
    """Keyed permutation of 0 .. n-1: a Feistel network over the next even number of bits, walked until it lands inside."""

    n: int
    key: int = 0

    @property
    def half(self) -> int:
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        x = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return (x ^ (x >> np.uint64(33))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            left, right = (right ^ self._round(left, r), left) if back else (right, left ^ self._round(right, r))
        return left << half | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(values, np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.col(f"`{text}`") if docs.schema[text].dataType == T.BinaryType() else text_of(text)
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), value.alias("_text"))


def _marked(batch: pa.RecordBatch, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a batch with the end marks in, and where each text starts."""
    ids, counts = tokens.encode(batch.column("_text").to_pylist())
    ends = np.cumsum(counts)
    return np.insert(ids.astype(tokens.dtype), ends, tokens.end), ends - counts + np.arange(len(counts))


def task_sizes(docs: DataFrame, key: str, text: str, tokens: Tokens) -> dict[int, int]:
    """Tokens with end marks of each task of the scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(len(_marked(b, tokens)[0]) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64())], names=["task", "n"])

    return {r.task: r.n for r in _rows(docs, key, text).mapInArrow(count, "task int, n bigint").collect()}


def _packed(values: np.ndarray) -> bytes:
    """Tokens as they are sent: their number of bytes, then the bytes compressed, since the shuffle stands on disk beside table and shards."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _cut(sizes: dict[int, int], tokens: Tokens, length: int, order: Permutation) -> Callable:
    starts, at = {}, 0
    for task in sorted(sizes):
        starts[task] = at
        at += sizes[task]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        place = starts.get(task, 0)
        rest, owners = np.zeros(0, tokens.dtype), []
        done = 0

        def out(first: int, values: np.ndarray, found: list[tuple[int, int | None]]) -> pa.RecordBatch:
            """Rows of the values from place ``first``: one for each sequence they touch."""
            edges = np.arange(first // length, (first + len(values) - 1) // length + 1)
            low = np.maximum(edges * length, first) - first
            high = np.minimum((edges + 1) * length, first + len(values)) - first
            ids: list[list[int]] = [[] for _ in edges]
            for p, i in found:
                ids[p // length - int(edges[0])].append(i)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(order.slot(edges)),
                    pa.array(edges),
                    pa.array((low + first - edges * length).astype(np.int32)),
                    pa.array([_packed(values[a:b]) for a, b in zip(low, high, strict=True)], pa.binary()),
                    pa.array(ids, pa.list_(pa.int64())),
                ],
                names=["slot", "sequence", "start", "tokens", "doc_ids"],
            )

        for batch in batches:
            values, begin = _marked(batch, tokens)
            owners += [(place + len(rest) + int(b), i) for b, i in zip(begin, batch.column("id").to_pylist(), strict=True)]
            done += len(values)
            rest = np.concatenate((rest, values))
            whole = (place + len(rest)) // length * length - place
            if whole > 0:
                yield out(place, rest[:whole], [o for o in owners if o[0] < place + whole])
                owners = [o for o in owners if o[0] >= place + whole]
                place, rest = place + whole, rest[whole:]
        if done != sizes.get(task, 0):
            raise RuntimeError("the scan gave other rows than when they were counted; write the input as a table first")
        if len(rest):
            yield out(place, rest, owners)

    return run


def _write(folder: str, tokens: Tokens, length: int, per_shard: int) -> Callable:
    """Writes the shards of a partition, whose rows stand in order of slot and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        rows = ((s, q, a, t, d) for b in batches for s, q, a, t, d in zip(*[b.column(c).to_pylist() for c in ("slot", "sequence", "start", "tokens", "doc_ids")], strict=True))
        for shard, group in groupby(rows, key=lambda r: r[0] // per_shard):
            name, out = f"{root}/shard-{shard:08d}.bin", []
            with store.open_output_stream(f"{name}.{attempt}") as file:
                for slot, pieces in groupby(group, key=lambda r: r[0]):
                    found = list(pieces)
                    data = b"".join(_unpacked(p[3]) for p in found)
                    missing = length - len(data) // np.dtype(tokens.dtype).itemsize
                    file.write(data + np.full(missing, tokens.pad, tokens.dtype).tobytes())
                    out.append((slot, found[0][1], shard, slot % per_shard * length * np.dtype(tokens.dtype).itemsize, length - missing, [d for p in found for d in p[4]]))
            store.move(f"{name}.{attempt}", name)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=_INDEX.fieldNames())

    return run


_INDEX = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("slot", "sequence", "shard", "byte_offset", "n_tokens")] + [T.StructField("doc_ids", T.ArrayType(T.LongType()))]
)


def write_shards(
    docs: DataFrame, folder: str | None = None, tokens: Tokens = UTF8, length: int = LENGTH, seed: int = 0, shard_bytes: int = SHARD_BYTES, key: str = "doc_id", text: str = "text"
) -> tuple[str, DataFrame]:
    """Write all shards; return their folder and the index: slot, sequence, shard, byte_offset, n_tokens and
    the ids of the texts that start in the sequence.  ``docs`` must be the scan of a written table."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "shards")
    if tokens.once:
        docs, key, text, tokens = _encoded(docs, key, text, tokens), "id", "ids", replace(tokens, encode=_stored(tokens.dtype))
    sizes = task_sizes(docs, key, text, tokens)
    total = sum(sizes.values())
    if not total:
        return folder, spark.createDataFrame([], _INDEX)
    n = -(-total // length)
    per_shard = max(1, shard_bytes // (length * np.dtype(tokens.dtype).itemsize))
    order = Permutation(n, seed)
    schema = "slot bigint, sequence bigint, start int, tokens binary, doc_ids array<bigint>"
    pieces = _rows(docs, key, text).mapInArrow(_cut(sizes, tokens, length, order), schema)
    shards = -(-n // per_shard)
    dealt = pieces.repartitionById(shards, (F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot", "start")
    with tidy_shuffles(spark):
        index = saved(dealt.mapInArrow(_write(folder, tokens, length, per_shard), _INDEX), "shard-index")
    if tokens.once:
        discard(docs)
    return folder, index


def read_slots(folder: str, index: DataFrame, tokens: Tokens = UTF8, length: int = LENGTH) -> DataFrame:
    """The index with ``tokens``: the bytes of each slot, read back from its shard; shards are read side by side."""
    size = length * np.dtype(tokens.dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            data, at, file = [], None, None
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("byte_offset").to_pylist(), strict=True):
                if shard != at:
                    if file:
                        file.close()
                    file, at = store.open_input_file(f"{root}/shard-{shard:08d}.bin"), shard
                file.seek(offset)
                data.append(file.read(size))
            if file:
                file.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "tokens"])

    return index.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("tokens", T.BinaryType())]))
