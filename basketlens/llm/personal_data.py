"""Personal data: base rules for four kinds, and a character model that finds more of each kind.

The model is a bidirectional LSTM over character classes with a CRF on top, trained in numpy from
labelled spans: the base spans of a sample of texts, and the same texts with each span written in
another way that the base rules do not read (spelled or spaced signs, other separators, phones without
plus, a card beside another number) or put in place of it something that only looks alike (dates, amounts,
versions, book numbers), labelled as outside.

Texts are cut into overlapping windows; each window is decoded on its own, then every character takes
the label of the window whose centre is nearest, and spans are read off the whole text.  A span of the
model counts when it passes the checks of its kind (``plausible``), the mean of its marginals under the
CRF reaches ``SURE`` and it meets no base span.  Every span that passes those checks holds a digit, an
at sign or a spelled sign, so a window without any of them (``marks``) cannot add one and is not run
through the network.

Defined results: a null or empty text has no spans; without training windows (an empty table, or no base
span in the sample) the model adds nothing.  Rows are handled one by one, so repeated rows agree; among
spans that meet, base spans stay.  A text of any length is read whole, at most ``TOGETHER`` windows at a time.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.common import discard, saved

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and between the starts of two windows.
WINDOW, STRIDE = 96, 48
#: Units per direction; windows at a time; mean certainty of a span that the model adds.
HIDDEN, TOGETHER, SURE = 24, 2_048, 0.6
#: Rows (about) and windows (at most, of each sort) of the training sample, and steps of the descent.
TRAIN_ROWS, TRAIN_WINDOWS, STEPS = 4_000, 3_000, 220
#: Other ways of writing each text of the sample that has spans.
WAYS = 20

# Fixed patterns: the base rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The letters before an at sign cannot hold one, so each at sign is tried with all of them."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for run in _RUN.finditer(text):
        if run.start() >= done and (found := _IP.match(text, run.start())):
            done = found.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found[0].split(".")):
                yield found.span()


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by kind as listed, then start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [("ip", a, b) for a, b in _addresses(text)]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


# Signs of an address in words or brackets, and the forms in which the model's spans are accepted.
_AT_SIGN = re.compile(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
_DOT_SIGN = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+|\s*\.\s*", re.IGNORECASE)
_SPELLED = re.compile(r"[\[({]\s*(?:at|dot)\s*[\])}]|\bdot\b", re.IGNORECASE)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"([0-9]{1,3})([^0-9]{1,7})([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})")
_GROUPS = re.compile(r"[0-9](?:[^A-Za-z0-9\n]{0,3}[0-9])+")
_DIALLED = re.compile(r"\+?\(?[0-9]+(?:[\x20()./-]{1,2}[0-9]+)+")


def plausible(kind: str, found: str) -> bool:
    """The checks of a kind, on whatever way it is written."""
    digits = _digits(found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _GROUPS.fullmatch(found) is not None and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and _DIALLED.fullmatch(found) is not None
    if kind == "ip":
        four = _FOUR.fullmatch(found)
        return bool(four) and _DOT_SIGN.fullmatch(four[2]) is not None and all(int(p) <= 255 for p in four.group(1, 3, 4, 5))
    return _MAIL.fullmatch(_DOT_SIGN.sub(".", _AT_SIGN.sub("@", found))) is not None


def _another_way(kind: str, found: str, r: np.random.Generator) -> list[tuple[str, bool]]:
    """The data in pieces of text, each with whether it is of the kind: a way that the base rules do not read."""
    pick = lambda *ways: ways[int(r.integers(len(ways)))]
    if kind == "email":
        local, host = found.rsplit("@", 1)
        at = pick(" at ", " [at] ", " (at) ", "[at]", "(at)", " @ ", " AT ")
        dots = (" dot ", " DOT ", " [dot] ", "(dot)") if at.strip().lower() == "at" else (".", ".", " dot ", " [dot] ", "[dot]", "(dot)")
        return [(local + at + host.replace(".", pick(*dots)), True)]
    if kind == "ip":
        return [(pick(" . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", ". ").join(found.split(".")), True)]
    digits = _digits(found)
    if kind == "card":
        if r.random() < 0.3:
            other = "".join(map(str, r.integers(0, 10, 16)))
            pair = [(digits, True), (" ", False), (other, True)]
            return pair if r.random() < 0.5 else pair[::-1]
        return [(pick("  ", ".", "/", "_", " - ", "\u00a0", "\u2013", " / ").join(digits[i : i + 4] for i in range(0, len(digits), 4)), True)]
    country, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    if len(digits) < 10:
        return [(pick("-", ".", " ", "/").join(digits[i : i + 3] for i in range(0, len(digits), 3)), True)]
    return [(pick(f"({a}) {b}-{c}", f"{country or 1}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{country or 1} {a} {b} {c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{a}-{b}-{c}"), True)]


def _look_alike(r: np.random.Generator) -> str:
    """Something with digits or spelled signs that is nobody's data."""
    n = [int(x) for x in r.integers(0, 10_000, 4)]
    return (
        f"{1900 + n[0] % 150}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d} {n[3] % 24:02d}:{n[0] % 60:02d}",
        f"{1 + n[0] % 999},{n[1] % 1000:03d},{n[2] % 1000:03d}.{n[3] % 100:02d}",
        f"{n[0] % 20}.{n[1] % 20}.{n[2] % 40}",
        f"978-{n[0] % 10}-{n[1] % 100:02d}-{n[2]:04d}{n[3] % 100:02d}-{n[0] % 7}",
        f"{n[0]:04d}{n[1]:04d}{n[2]:04d}{n[3]:04d}{n[0]:04d}",
        f"at {n[0] % 24}:{n[1] % 60:02d}, dot by dot",
        f"{n[0]} - {n[1]}",
    )[int(r.integers(7))]


def rewritten(text: str, spans: list[Span], r: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with each span written in another way (three in four) or replaced by something alike, and its spans then."""
    out, found, at, size = [], [], 0, 0

    def put(piece: str, kind: str | None = None) -> None:
        nonlocal size
        if kind:
            found.append((kind, size, size + len(piece)))
        out.append(piece)
        size += len(piece)

    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a < at:
            continue
        put(text[at:a])
        at = b
        if r.random() < 0.25:
            put(_look_alike(r))
        else:
            for piece, of_kind in _another_way(kind, text[a:b], r):
                put(piece, kind if of_kind else None)
    put(text[at:])
    return "".join(out), found


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


#: Character classes: the ASCII range as it is, then other letters and all the rest.
CLASSES = 130


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129)).astype(np.uint8)


def _gates(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the cell from the summed inputs (batch, 4 units)."""
    h = c.shape[1]
    s = 0.5 * np.tanh(0.5 * z[:, : 3 * h]) + 0.5
    g = np.tanh(z[:, 3 * h :])
    i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
    new = f * c + i * g
    t = np.tanh(new)
    return i, f, o, g, new, t, o * t


@dataclass
class Tagger:
    """Weights: per direction ``table`` (class, 4 units), ``deep`` (units, 4 units); then ``out``, ``shift``, ``turn``."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> "Tagger":
        r, labels = np.random.default_rng(seed), len(KINDS) + 1
        w = {}
        for d in "fb":
            w[f"table_{d}"] = r.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            w[f"table_{d}"][:, HIDDEN : 2 * HIDDEN] += 1
            w[f"deep_{d}"] = r.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
        w["out"], w["shift"], w["turn"] = r.normal(0, 0.3, (2 * HIDDEN, labels)), np.zeros(labels), np.zeros((labels, labels))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _direction(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, batch = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        table, deep = self.weights[f"table_{d}"], self.weights[f"deep_{d}"]
        out, kept = np.empty((steps, batch, HIDDEN), table.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            before = (h, c)
            i, f, o, g, c, tc, h = _gates(table[x[t]] + h @ deep, c)
            out[t] = h
            if keep:
                kept.append((t, *before, i, f, o, g, tc))
        return out, kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emission scores (step, batch, label) of windows of classes (step, batch)."""
        both = np.concatenate([self._direction(x, d, False)[0] for d in "fb"], axis=2)
        return both @ self.weights["out"] + self.weights["shift"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels under the CRF (step, batch), and the marginal of each (of windows that are all outside: 1)."""
        e, turn = self.scores(x), self.weights["turn"]
        steps, batch, labels = e.shape
        top, back = e[0], np.empty((steps, batch, labels), np.uint8)
        for t in range(1, steps):
            paths = top[:, :, None] + turn
            back[t] = paths.argmax(1)
            top = paths.max(1) + e[t]
        path, rows = np.empty((steps, batch), np.int64), np.arange(batch)
        path[-1] = top.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        sure, some = np.ones((steps, batch), np.float32), path.any(0)
        if some.any():
            p = self.marginals(e[:, some])
            sure[:, some] = np.take_along_axis(p, path[:, some, None], 2)[:, :, 0]
        return path, sure

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """Probability of each label at each step under the CRF, from emission scores."""
        ahead, behind = self._sums(e)
        return np.exp(ahead + behind - np.logaddexp.reduce(ahead[-1], axis=1)[None, :, None])

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all paths up to each label and from it on."""
        ahead, behind, turn = np.empty_like(e), np.zeros_like(e), self.weights["turn"]
        ahead[0] = e[0]
        for t in range(1, len(e)):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, :, None] + turn, axis=1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(turn + (e[t + 1] + behind[t + 1])[:, None, :], axis=2)
        return ahead, behind

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the labels and its gradients."""
        w, (steps, batch) = self.weights, x.shape
        runs = {d: self._direction(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e, turn = both @ w["out"] + w["shift"], w["turn"]
        rows = np.arange(batch)
        ahead, behind = self._sums(e)
        whole = np.logaddexp.reduce(ahead[-1], axis=1)
        gold = sum(e[t, rows, y[t]] for t in range(steps)) + sum(turn[y[t - 1], y[t]] for t in range(1, steps))
        de = np.exp(ahead + behind - whole[None, :, None])
        np.subtract.at(de, (np.arange(steps)[:, None], rows[None], y), 1.0)
        dturn = np.zeros_like(turn)
        for t in range(1, steps):
            dturn += np.exp(ahead[t - 1][:, :, None] + turn + (e[t] + behind[t])[:, None, :] - whole[:, None, None]).sum(0)
            np.subtract.at(dturn, (y[t - 1], y[t]), 1.0)
        de /= batch
        grads = {"turn": dturn / batch, "out": np.einsum("tbh,tbl->hl", both, de), "shift": de.sum((0, 1))}
        dboth, picked = de @ w["out"].T, np.eye(CLASSES, dtype=np.float32)[x.ravel()].T
        for n, d in enumerate("fb"):
            deep, entered = np.zeros_like(w[f"deep_{d}"]), np.empty((steps, batch, 4 * HIDDEN), de.dtype)
            dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, tc in reversed(runs[d][1]):
                dh = dh + dboth[t, :, n * HIDDEN : (n + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                entered[t] = dz
                deep += h0.T @ dz
                dh, dc = dz @ w[f"deep_{d}"].T, dc * f
            grads[f"table_{d}"], grads[f"deep_{d}"] = picked @ entered.reshape(-1, 4 * HIDDEN), deep
        return float((whole - gold).mean()), grads


def train(windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = 128, rate: float = 0.03) -> Tagger | None:
    """Fit a tagger on windows (n, step) of classes and labels by Adam with a falling rate; None without windows."""
    if not len(windows):
        return None
    tagger, r = Tagger.fresh(), np.random.default_rng(11)
    one = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    two = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    for n in range(1, steps + 1):
        at = r.integers(0, len(windows), batch)
        _, grads = tagger.gradients(windows[at].T, labels[at].T)
        for k, g in grads.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            step = (one[k] / (1 - 0.9**n)) / (np.sqrt(two[k] / (1 - 0.99**n)) + 1e-6)
            tagger.weights[k] -= np.float32(rate * (1 - 0.9 * n / steps)) * step.astype(np.float32)
    return tagger


def _starts(n: int) -> np.ndarray:
    """Starts of the windows over a text: every stride, until one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


_DIGIT_OR_AT = np.zeros(CLASSES, bool)
_DIGIT_OR_AT[[*range(48, 58), 64]] = True


def marks(text: str, x: np.ndarray) -> np.ndarray:
    """Places, in order, of digits, at signs and spelled signs; ``x`` are the classes of the text."""
    plain = np.flatnonzero(_DIGIT_OR_AT[x])
    spelled = [m.start() for m in _SPELLED.finditer(text)]
    return np.union1d(plain, np.array(spelled, np.int64)) if spelled else plain


def busy_starts(text: str, x: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a mark."""
    hits = marks(text, x)
    if not len(hits):
        return np.zeros(0, np.int64)
    starts = _starts(len(x))
    first = np.searchsorted(hits, starts)
    return starts[(first < len(hits)) & (hits[np.minimum(first, len(hits) - 1)] < starts + WINDOW)]


def _labelled(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text that hold a mark, and their labels."""
    x = classes(text)
    y = np.zeros(len(x), np.uint8)
    for kind, a, b in spans:
        y[a:b] = KINDS.index(kind) + 1
    starts = busy_starts(text, x)
    at = starts[:, None] + np.arange(WINDOW)
    x, y = np.pad(x, (0, WINDOW)), np.pad(y, (0, WINDOW))
    return x[at], y[at]


def training_windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of a text, and of ``WAYS`` rewritings of it where it has spans."""
    base = base_spans(text)
    both = [_labelled(text, base)]
    for n in range(WAYS if base else 0):
        other, found = rewritten(text, base, np.random.default_rng([n, len(text), *(a for _, a, _ in base[:4])]))
        clear = [s for s in base_spans(other) if all(s[2] <= f[1] or f[2] <= s[1] for f in found)]
        both.append(_labelled(other, found + clear))
    xs, ys = zip(*both, strict=True)
    return np.concatenate(xs), np.concatenate(ys)


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of the model in each text: windows of many texts together, reconciled text by text."""
    waiting: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []
    found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def run() -> None:
        path, sure = tagger.decode(np.array(rows).T)
        for (n, start), labels, p in zip(waiting, path.T, sure.T, strict=True):
            if labels.any():
                found.setdefault(n, []).append((start, labels, p))
        waiting.clear()
        rows.clear()

    for n, text in enumerate(texts):
        x = classes(text)
        for start in busy_starts(text, x):
            window = x[start : start + WINDOW]
            rows.append(np.pad(window, (0, WINDOW - len(window))))
            waiting.append((n, int(start)))
            if len(rows) == TOGETHER:
                run()
    if rows:
        run()
    return [_reconciled(texts[n], found.get(n, [])) for n in range(len(texts))]


#: Characters that a span of the model neither starts nor ends with.
_EDGES = frozenset(" \t\n,;:.!?\"'/-")


def _reconciled(text: str, decoded: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Span]:
    """Each character takes the label of the window whose centre is nearest; spans are runs of one label."""
    side = (WINDOW - STRIDE) // 2
    labels: dict[int, tuple[int, float]] = {}
    for start, path, sure in decoded:
        low = 0 if start == 0 else side
        high = WINDOW if start + WINDOW >= len(text) else WINDOW - side
        for i in range(low, high):
            if path[i] and start + i < len(text):
                labels[start + i] = (int(path[i]), float(sure[i]))
    spans, at = [], sorted(labels)
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and labels[at[j + 1]][0] == labels[at[i]][0]:
            j += 1
        a, b = at[i], at[j] + 1
        kind, sure = KINDS[labels[a][0] - 1], sum(labels[k][1] for k in range(a, b)) / (b - a)
        while a < b and text[a] in _EDGES:
            a += 1
        while a < b and text[b - 1] in _EDGES:
            b -= 1
        # A word is taken whole; one that goes on for more than a window fails the checks.
        low, high = max(0, a - WINDOW), min(len(text), b + WINDOW)
        while low < a < b and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while a < b < high and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if b - a >= 7 and sure >= SURE and plausible(kind, text[a:b]):
            spans.append((kind, a, b))
        i = j + 1
    return spans


def all_spans(texts: list[str], tagger: Tagger | None) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    added = model_spans(texts, tagger) if tagger else [[] for _ in texts]
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        yield base, base + [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, train_windows: int = TRAIN_WINDOWS) -> Tagger | None:
    """Train on the spans of a sample: about ``train_rows`` rows by a hash of key and length, and of their
    windows (``training_windows``) at most ``train_windows`` with a span and half as many without, by a hash of the window."""
    size = docs.count()
    if not size:
        return None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in filter(None, batch.column("_text").to_pylist()):
                x, y = training_windows(t)
                columns = [pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in y], pa.binary()), pa.array(y.any(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "some"])

    share = min(1.0, train_rows / size)
    rows = (
        docs.select(F.col(f"`{text}`").alias("_text"), F.xxhash64(F.col(f"`{key}`"), F.length(F.col(f"`{text}`"))).alias("_h"))
        .filter(F.col("_text").isNotNull() & (F.pmod(F.col("_h"), F.lit(1 << 30)) < share * (1 << 30)))
        .select("_text")
        .mapInArrow(windows, "x binary, y binary, some boolean")
    )
    rows = saved(rows.distinct(), "personal-windows")
    least = lambda some, n: rows.filter(F.col("some") == some).orderBy(F.xxhash64("x"), "x", "y").limit(n).select("x", "y").collect()
    found = sorted(least(True, train_windows) + least(False, train_windows // 2))
    discard(rows)
    if not found:
        return None
    stack = lambda name: np.array([np.frombuffer(bytes(r[name]), np.uint8) for r in found])
    return train(stack("x"), stack("y"))


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """Columns ``row`` (a struct of all columns of ``docs``), ``base`` and ``spans``: arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(all_spans(batch.column("_text").to_pylist(), shared.value))
            as_rows = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(f[k], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))] for f in found], span)
            yield pa.RecordBatch.from_arrays([batch.column("row"), as_rows(0), as_rows(1)], names=["row", "base", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("base", kind), T.StructField("spans", kind)]))


def spans_text(column: str):
    """Spans written as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
