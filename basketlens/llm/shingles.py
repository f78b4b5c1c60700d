"""Sets of word shingles as sorted 64-bit hashes, from whole texts, in numpy."""

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Bytes of texts that are hashed in one go.
BLOCK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What a byte counts: itself (A-Z as a-z) and one more.
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n of a base, kept between texts."""
    known = _tables.get(int(base))
    if known is None or len(known) <= n:
        _tables[int(base)] = known = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1 << 16), base, np.uint64))))
    return known


def _blocks(texts: Iterable[str]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        raw = text.encode("utf-8")
        if block and size + len(raw) >= BLOCK:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    if block:
        yield block


def shingle_sets(texts: Iterable[str], words: int = 5) -> Iterator[np.ndarray]:
    """Of each text: distinct hashes of the runs of ``words`` words (A-Z lower-cased); a shorter text is one run; no words, no hash.

    Texts are hashed one after the other as one run of bytes, ``BLOCK`` or a single text at a time.
    """
    for block in _blocks(texts):
        raw = np.frombuffer(b" ".join(block) + b" ", np.uint8)
        space = _SPACE[raw]
        # The bytes end with a space, so every word has an end.
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_FOLD[raw] * _powers(_BASE, len(raw))[: len(raw)])))
        word = _mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(raw))[begin] + (end - begin).astype(np.uint64))
        run = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            run = _mix(run * _BASE + word[k : k + len(run)] + np.uint64(k + 1))
        first = 0
        for last in np.searchsorted(begin, np.cumsum([len(text) + 1 for text in block])).tolist():
            if last - first >= words:
                yield _distinct(run[first : last - words + 1])
            else:
                short = np.zeros(min(1, last - first), np.uint64)
                for k in range(last - first):
                    short = _mix(short * _BASE + word[first + k : first + k + 1] + np.uint64(k + 1))
                yield short
            first = last


def _distinct(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets([text], words))


def digest(shingles: np.ndarray) -> str:
    """Name of a set: a 128-bit digest of its hashes."""
    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def bitmap(shingles: np.ndarray, per: int = 2, sharp: int = 8, least: int = 64, long: int = 4096) -> np.ndarray:
    """Token bitmap with at least ``per`` bits a shingle, and ``sharp`` as long as that takes no more than ``long`` bits.

    Its length is a power of two, so that it can be folded, and at most doubles when a set grows by a quarter.
    """
    n = max(1, len(shingles))
    bits = max(least, min(long, _power(sharp * n)), _power(per * n))
    out = np.zeros(bits, bool)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _power(n: int) -> int:
    return 1 << (n - 1).bit_length()


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The bitmap over fewer bits: the last axis is halved until it has ``length`` words."""
    while bits.shape[-1] > length:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits
