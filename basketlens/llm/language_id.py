"""Language identification in two steps: the family first, then the language within it.

Every duel (family against family, language against language of one family) is a linear support
vector machine on the shares of hashed character n-grams.  The machines are fitted on a bounded
sample of labelled rows; every text is scored whole, in pieces of a million characters.

Defined results: a text that is null or without a letter is ``und`` with score 0, as is every text
where no row carries a label; with a single learned language it is that language with score 1.
Rows are scored one by one, so repeated rows agree; ties go to the first name in sorted order.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BITS = 13
#: Rows that fit the machines, shared evenly between the languages.
SAMPLE_ROWS = 2_000
#: Characters that are hashed at a time.
PIECE = 1_000_000
#: Steepness of the map from a margin to a confidence.
STEEP = 3.0
_SCALE = 8.0
_NUMBER = ">u4"

#: Families of languages by code.  Any other code is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}

_mixed: np.ndarray | None = None
_GAP = np.uint32(32 * 0x9E3779B1 & 0xFFFFFFFF)


def _mix_table() -> np.ndarray:
    """Hash of each code point folded to lower case; all that is no letter has the hash of a gap."""
    global _mixed
    if _mixed is None:
        folded = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):  # no list of all code points, which would take ten times the table
            if (c := chr(i)).isalpha():
                lower = c.lower()
                folded[i] = ord(lower) if len(lower) == 1 else i
        folded *= np.uint32(0x9E3779B1)
        _mixed = folded
    return _mixed


def hashed_grams(texts: list[str], bits: int = BITS) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Buckets of all 2- and 3-grams of letters and gaps with each text's range among them, and letters per text."""
    codes = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    mixed = _mix_table()[codes]
    letter = mixed != _GAP
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[begin[:-1]] = True
    counts = np.diff(np.concatenate(([0], np.cumsum(letter)))[begin])
    begin = np.concatenate(([0], np.cumsum(keep)))[begin]
    mixed = mixed[keep]
    two = (mixed[:-1] >> np.uint32(3)) * np.uint32(0x85EBCA77) ^ mixed[1:]
    three = (two[:-1] >> np.uint32(5)) * np.uint32(0xC2B2AE3D) ^ mixed[2:]
    out = []
    for n, grams in ((2, two), (3, three)):
        out.append(((grams * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits), begin[:-1], np.maximum(begin[:-1], begin[1:] - n + 1)))
    return out, counts


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of each range of values; the ranges do not overlap."""
    values = np.append(values, values.dtype.type(0))
    total = np.add.reduceat(values, np.column_stack((first, last)).ravel().clip(0, len(values) - 1), dtype=np.float64)[::2]
    return np.where(last > first, total, 0.0)


def pieces(texts: list[str | None], limit: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, piece of its text) of at most ``limit`` characters together, or one piece."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), limit):
            part = text[at : at + limit]
            if parts and size + len(part) > limit:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, parts


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights of a linear machine (squared hinge loss, the last weight is the bias) by accelerated descent."""
    given, x = x, np.ones((len(x), x.shape[1] + 1), np.float32)
    np.multiply(given, np.float32(_SCALE), out=x[:, :-1])  # one copy: the driver holds the sample besides
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (share * (x @ v))
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1.0 / (2 * top + penalty)
    w, ahead = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (x.T @ (-2 * share * gap * y) + penalty * ahead)
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    w[:-1] *= _SCALE
    return w


@dataclass
class LanguageModel:
    """Duels between names; ``weights`` has a row of n-gram weights per duel, ``bias`` its offset."""

    families: dict[str, list[str]]
    duels: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Margins (text, duel) and whether a text has a letter."""
        size = max(1, len(self.duels))
        sums, grams, letters = np.zeros((len(texts), size)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for rows, parts in pieces(texts):
            found, counts = hashed_grams(parts)
            rows = np.array(rows)
            np.add.at(letters, rows, counts)
            for bucket, first, last in found:
                np.add.at(grams, rows, last - first)
                for d in range(len(self.duels)):
                    np.add.at(sums[:, d], rows, _sums(self.weights[d][bucket], first, last))
        margins = sums / np.maximum(1, grams)[:, None]
        return (margins + self.bias if self.duels else margins), letters > 0

    def _winner(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most duels won (then the larger sum of margins), and its confidence."""
        won, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        sure = np.ones((len(margins), len(names)))
        for a, b in combinations(range(len(names)), 2):
            m = margins[:, self.duels.index((names[a], names[b]))]
            for name, side in ((a, m), (b, -m)):
                won[:, name] += side > 0
                total[:, name] += side
                sure[:, name] = np.minimum(sure[:, name], 1 / (1 + np.exp(-STEEP * np.clip(side, -20, 20))))
        best = np.argmax(won + 0.5 * (1 + np.tanh(total)) * 0.999, axis=1)
        return best, sure[np.arange(len(margins)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        margins, known = self.margins(texts)
        if not self.families or not known.any():
            return list(names), scores
        families = sorted(self.families)
        which, sure = self._winner(families, margins)
        for f, family in enumerate(families):
            rows = np.flatnonzero(known & (which == f))
            if len(rows):
                inner, inner_sure = self._winner(self.families[family], margins[rows])
                names[rows] = np.array(self.families[family], object)[inner]
                scores[rows] = sure[rows] * inner_sure
        return list(names), scores


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed n-gram counts of each text, sparse, as big-endian bytes (which sort as their numbers); dense for one text at a time."""
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        at, n = [b""] * len(texts), [b""] * len(texts)
        for rows, parts in pieces(texts):
            found = hashed_grams(parts)[0]
            for i, row in enumerate(rows):
                total = sum(np.bincount(bucket[first[i] : last[i]], minlength=1 << BITS) for bucket, first, last in found)
                total[np.frombuffer(at[row], _NUMBER)] += np.frombuffer(n[row], _NUMBER).astype(np.int64)
                some = np.flatnonzero(total)
                at[row], n[row] = some.astype(_NUMBER).tobytes(), total[some].astype(_NUMBER).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on labelled rows of ``docs``: at most twice ``sample_rows``, about that many, chosen by a hash of key and length."""
    families = FAMILIES if families is None else families
    rows = docs.filter(F.col(f"`{lang}`").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(f"`{lang}`").cast("string").alias("l")).count().collect()}
    if not counts:
        return LanguageModel({})
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("_lang") == name, min(1.0, sample_rows / len(counts) / n)).otherwise(share)
    found = (
        rows.select(F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").alias("_text"), F.xxhash64(F.col(f"`{key}`"), F.length(F.col(f"`{text}`"))).alias("_h"))
        .filter(F.col("_text").isNotNull() & (F.pmod(F.col("_h"), F.lit(1 << 30)) < share * (1 << 30)))
        .select("_lang", "_text")
        .limit(2 * sample_rows)
        .mapInArrow(_samples, "lang string, at binary, n binary")
        .collect()
    )
    by: dict[str, list[str]] = {}
    for name in sorted(counts):
        by.setdefault(families.get(name, name), []).append(name)
    found.sort(key=lambda r: (r.lang, r.at, r.n))
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for i, r in enumerate(found):
        if r.at:
            n = np.frombuffer(r.n, _NUMBER).astype(np.float32)
            x[i, np.frombuffer(r.at, _NUMBER)] = n / n.sum()
    langs = np.array([r.lang for r in found], object)
    groups = {f: np.isin(langs, members) for f, members in by.items()}
    model = LanguageModel(by)
    sides = [(a, b, groups[a], groups[b]) for a, b in combinations(sorted(by), 2)]
    sides += [(a, b, langs == a, langs == b) for members in by.values() for a, b in combinations(members, 2)]
    fitted = []
    for a, b, left, right in sides:
        at = np.flatnonzero(left | right)
        model.duels.append((a, b))
        fitted.append(fit_svm(x[at], np.where(left[at], 1, -1).astype(np.float32)) if left.any() and right.any() else np.zeros((1 << BITS) + 1, np.float32))
    if fitted:
        model.weights, model.bias = np.array([w[:-1] for w in fitted]), np.array([w[-1] for w in fitted])
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Columns ``row`` (a struct of all columns of ``docs``), ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def held_out(key: str = "doc_id"):
    """Rows that fit nothing: a fixed quarter by a checksum of the key (a null key is not held out)."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def fit_on_rest(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on the rows with a key that are not held out."""
    return fit(docs.filter(~held_out(key) & F.col(f"`{key}`").isNotNull()), key, text, lang)
