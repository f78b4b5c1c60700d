"""Encode texts into the pieces of a SentencePiece vocabulary, and decode them.

A text is cut into marked words: a run of spaces, written as marks, and the letters after it (the
first word gets one mark more).  No piece of the vocabulary has a mark after a letter, so the best
segmentation of a text is that of its words.  Distinct words are sorted, which walks their trie
depth first: the forward scores of a word are kept up to the prefix it shares with the next one.

The path with the largest sum of scores wins; of equal ones the one whose last piece is longest.
A character outside the vocabulary costs the smallest score less 10 and becomes byte pieces.
Decoding gives the text back exactly; a mark character that the text itself holds goes through bytes.

Defined results: null gives null ids; the empty text gives no ids.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Cost of a character without a piece, below the smallest score (fixed by the vocabulary format).
UNKNOWN_PENALTY = 10.0
#: Characters of text whose words are held at a time, and words whose pieces a task remembers.
BLOCK, REMEMBERED = 1_000_000, 150_000
#: Transitions past a failure link that are remembered.
LEARNED = 300_000


@dataclass
class Vocabulary:
    """Pieces by id with scores; ``byte_ids`` has the id of each byte."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    _walk: tuple | None = field(default=None, repr=False)
    _learned: int = field(default=0, repr=False)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        made = cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [not s for s in special], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if not all(model.is_byte(i) for i in made.byte_ids):
            raise ValueError("the vocabulary has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p, n in zip(made.pieces, made.normal, strict=True) if n):
            raise ValueError("a piece has a mark after a letter; words cannot be encoded apart")
        return made

    def walk(self) -> tuple[list[dict], list[int], list[tuple]]:
        """Trie of the pieces with failure links: next states, and (length, id, score) of the pieces that end in each."""
        if self._walk is None:
            nexts: list[dict] = [{}]
            own: list[tuple | None] = [None]
            for i, piece in enumerate(self.pieces):
                if self.normal[i] and piece:
                    state = 0
                    for c in piece:
                        if c not in nexts[state]:
                            nexts[state][c] = len(nexts)
                            nexts.append({})
                            own.append(None)
                        state = nexts[state][c]
                    own[state] = (len(piece), i, self.scores[i])
            fail, ends, queue = [0] * len(nexts), [()] * len(nexts), [0]
            for state in queue:
                for c, deeper in nexts[state].items():
                    back = fail[state]
                    while back and c not in nexts[back]:
                        back = fail[back]
                    fail[deeper] = nexts[back].get(c, 0) if state else 0
                    ends[deeper] = ends[fail[deeper]] + ((own[deeper],) if own[deeper] else ())
                    queue.append(deeper)
            self._walk = nexts, fail, ends
        return self._walk

    def unknown_score(self) -> float:
        return min((s for s, n in zip(self.scores, self.normal, strict=True) if n), default=0.0) - UNKNOWN_PENALTY

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Pieces of each distinct word: one depth-first walk over the trie of the sorted words."""
        (nexts, fail, ends), unknown, byte_ids = self.walk(), self.unknown_score(), self.byte_ids
        best, back = [0.0], [(0, -1, 0)]
        before, out = "", {}
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], back[same + 1 :]
            state, end = back[same][2], same
            for c in word[same:]:
                top, size, found = best[end] + unknown, 1, -1
                end += 1
                after = nexts[state].get(c)
                if after is None:
                    first = state
                    while c not in nexts[state] and state:
                        state = fail[state]
                    after = nexts[state].get(c, 0)
                    if self._learned < LEARNED:
                        nexts[first][c] = after
                        self._learned += 1
                state = after
                for n, i, score in ends[state]:
                    score += best[end - n]
                    if score >= top:
                        top, size, found = score, n, i
                best.append(top)
                back.append((size, found, state))
            ids, end = [], len(word)
            while end:
                size, found, _ = back[end]
                if found >= 0:
                    ids.append(found)
                else:
                    ids.extend(byte_ids[b] for b in reversed(word[end - 1].encode("utf-8")))
                end -= size
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def piece_bytes(self) -> pa.Array:
        values = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return pa.array([values.get(i, p.replace(MARK, " ").encode() if n else b"") for i, (p, n) in enumerate(zip(self.pieces, self.normal, strict=True))], pa.binary())


def marked_words(text: str) -> list[str | None]:
    """Words with the marks of the spaces before them; None stands for each mark the text itself holds."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return [MARK + word for word in text.split(" ")]
    out: list[str | None] = []
    for n, part in enumerate(text.split(MARK)):
        if n:
            out.append(None)
        marks = "" if n else MARK
        for i, word in enumerate(part.split(" ")):
            marks += MARK if i else ""
            if word:
                out.append(marks + word)
                marks = ""
        if marks:
            out.append(marks)
    return out


class Encoder:
    """Encodes and decodes lists of texts; remembers the pieces of recent words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.literal = [vocabulary.byte_ids[b] for b in MARK.encode()]
        self.bytes = vocabulary.piece_bytes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | None, int] = {None: 0}
        self.pool, self.sizes = np.array(self.literal, np.int32), np.array([len(self.literal)])

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [marked_words(t) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if new := set(flat) - self.known.keys():
            made = self.vocabulary.encode_words(list(new))
            for n, word in enumerate(made, len(self.known)):
                self.known[word] = n
            lists = made.values()
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, lists), np.int64, len(made))))
            self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(lists), np.int32)))
        sizes, pool = self.sizes, self.pool
        starts = np.concatenate(([0], np.cumsum(sizes)))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n = sizes[codes]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out = pool[np.repeat(starts[codes], n) + place]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, words)])]
        if len(self.known) > REMEMBERED:
            self._forget()
        return out, np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        ids, counts, block, size = [], [], [], 0
        for text in [*texts, None]:
            if text is None or block and size + len(text) > BLOCK:
                if block:
                    a, b = self._block(block)
                    ids.append(a)
                    counts.append(b)
                block, size = [], 0
            if text is not None:
                block.append(text)
                size += len(text)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        out, at = [], 0
        for n in counts:
            taken = self.bytes.take(pa.array(ids[at : at + n]))
            at += n
            text = b"".join(taken.to_pylist()) if n < 64 else _joined(taken)
            out.append(text.decode("utf-8", "replace")[1:] if n else "")
        return out


def _joined(values: pa.Array) -> bytes:
    first, last = np.frombuffer(values.buffers()[1], np.int32)[[values.offset, values.offset + len(values)]]
    return values.buffers()[2][int(first) : int(last)].to_pybytes()


def parts_of(batch: pa.RecordBatch, column: str = "_text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", back: bool = False) -> DataFrame:
    """Columns ``row`` (a struct of all columns of ``docs``) and ``ids``; with ``back`` also ``decoded``, the text the ids give.

    Encoding and decoding in one task needs half the Python workers that one after the other would.
    Ids, decoded texts and what is sent back are held for a part of a batch at a time (``parts_of``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in chain.from_iterable(map(parts_of, batches)):
            texts = batch.column("_text").to_pylist()
            ids, counts = encoder.encode([t or "" for t in texts])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
            columns = {"row": batch.column("row"), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))}
            if back:
                decoded = encoder.decode(ids, counts)
                columns["decoded"] = pa.array([None if t is None else d for t, d in zip(texts, decoded, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields + [T.StructField("decoded", T.StringType())] * back))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Columns ``row`` (a struct of all columns of ``rows``) and ``decoded``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    given = rows.select(F.struct("*").alias("row"), F.col(f"`{ids}`").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column("_ids")
            counts = np.array([len(x) if x.is_valid else 0 for x in column])
            texts = encoder.decode(column.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t if x.is_valid else None for t, x in zip(texts, column, strict=True)], pa.string())], names=["row", "decoded"])

    return given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("decoded", T.StringType())]))
