"""Chat records of many layouts as canonical turns, and turns as one marked text with a loss mask.

A record is JSON.  The paths of its nested fields (list positions left out) are hashed to a
fingerprint, which selects a mapping: steps that say where turns, roles and texts stand.  A new
layout is a new entry of the table, not new code.

The template writes ``<|turn|>role\\n text <|end|>\\n``.  Inside roles and texts every control string gets
a backslash after its first character and every backslash is doubled, so that no control string is
left and unescaping gives the text back.  Long conversations are never gathered: rows are sorted by
conversation and turn, and a task writes or reads one turn at a time.

Defined results: a null text or role is empty; a conversation with a null id is one conversation; rows
come by turn (nulls first), then role, then text, repeated ones as often as they stand there; an empty table gives none.
A record that no mapping reads goes to the rejects, with the paths of its fields; null and empty fields fit any layout that has them.
"""

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import partitions

TURN, END = "<|turn|>", "<|end|>"
#: Strings that models read as control, besides the marks of this template.
CONTROL = (TURN, END, "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def paths(value: object, at: str = "") -> set[str]:
    """Paths of the fields of a nested value; the elements of a list share one path, and ``?`` ends that of a null or empty one."""
    if isinstance(value, dict) and value:
        return set().union(*[paths(v, f"{at}.{k}") for k, v in value.items()])
    if isinstance(value, list) and value:
        return set().union(*[paths(v, f"{at}[]") for v in value])
    return {f"{at}?" if value is None or value == [] or value == {} else at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Step:
    """Turns of one place of a record: the list at ``each`` (or the record), with role and text at paths in it.

    A role that starts with ``=`` is meant as it stands; other texts are read from the record, and
    ``join`` puts several text fields that are not empty together with a blank line.
    """

    role: str
    text: tuple[str, ...]
    each: str | None = None


def _at(record: object, path: str) -> object:
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


#: Roles under other names (fixed values of common chat data).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts by the paths of their fields; the table is looked up by fingerprint.
LAYOUTS: dict[tuple[str, ...], tuple[Step, ...]] = {
    (".messages[].role", ".messages[].content"): (Step("role", ("content",), "messages"),),
    (".conversations[].from", ".conversations[].value"): (Step("from", ("value",), "conversations"),),
    (".message.role", ".message.content"): (Step("message.role", ("message.content",)),),
    (".prompt", ".completion"): (Step("=user", ("prompt",)), Step("=assistant", ("completion",))),
    (".prompt", ".response"): (Step("=user", ("prompt",)), Step("=assistant", ("response",))),
    (".question", ".answer"): (Step("=user", ("question",)), Step("=assistant", ("answer",))),
    (".system", ".prompt", ".response"): (Step("=system", ("system",)), Step("=user", ("prompt",)), Step("=assistant", ("response",))),
    (".instruction", ".output"): (Step("=user", ("instruction",)), Step("=assistant", ("output",))),
    (".instruction", ".input", ".output"): (Step("=user", ("instruction", "input")), Step("=assistant", ("output",))),
    (".prompt",): (Step("=user", ("prompt",)),),
    (".completion",): (Step("=assistant", ("completion",)),),
    (".instruction.system",): (Step("=system", ("instruction.system",)),),
}
_BY_FINGERPRINT = {fingerprint(set(k)): v for k, v in LAYOUTS.items()}


_KNOWN = set().union(*[set(k) for k in LAYOUTS])

#: Fields that describe a record or a message and are no part of what is said.
DESCRIBING = ("id", "name", "source", "type", "index", "weight", "timestamp", "created", "metadata", "tags")
_DESCRIBING = re.compile(r"\.(" + "|".join(DESCRIBING) + r")(\W|$)")


def layout_paths(found: set[str]) -> set[str]:
    """The paths that tell the layout.

    Describing fields and unknown empty ones are left out, parts of a text (``text`` in a list) stand for the
    text, and a field that is empty stands for all that a layout may have below it.
    """
    told = set()
    for path in found:
        empty, path = path.endswith("?"), path.rstrip("?")
        if path in _KNOWN:
            told.add(path)
        elif path.endswith("[].text") and path.removesuffix("[].text") in _KNOWN or empty and path.removesuffix("[]") in _KNOWN:
            told.add(path.removesuffix("[].text").removesuffix("[]"))
        elif empty:
            told.update(k for k in _KNOWN if k.startswith((f"{path}.", f"{path}[].")))
        elif not _DESCRIBING.search(path):
            told.add(path)
    return told


class Unmapped(ValueError):
    """A record that no mapping reads, with the paths of its fields."""

    def __init__(self, found: set[str]) -> None:
        super().__init__(f"no layout for the fields {sorted(found)}")
        self.paths = sorted(found)


def _text(value: object) -> str:
    """A text field: null is empty, and texts in parts are put together."""
    if isinstance(value, list):
        return "".join(_text(part.get("text") if isinstance(part, dict) else part) for part in value)
    return "" if value is None else str(value)


def canonical(record: object) -> list[tuple[str, str]]:
    """(role, text) of the turns of a record, by the mapping that its fingerprint selects."""
    found = paths(record)
    steps = _BY_FINGERPRINT.get(fingerprint(layout_paths(found)))
    if steps is None:
        raise Unmapped(found)
    turns = []
    for step in steps:
        for item in (_at(record, step.each) or []) if step.each else [record]:
            if item is None:
                continue
            role = step.role[1:] if step.role.startswith("=") else _text(_at(item, step.role))
            texts = [_text(_at(item, p)) for p in step.text]
            turns.append((ROLES.get(role, role), texts[0] if len(texts) == 1 else "\n\n".join(t for t in texts if t)))
    return turns


def read_record(record: str | None) -> tuple[list[tuple[str, str]], str | None, list[str] | None]:
    """Turns of a JSON text, or why it has none and the paths of its fields; a null record has no turns and no reason."""
    try:
        turns = canonical(json.loads(record)) if record is not None else []
        for role, text in turns:
            (role + text).encode()
        return turns, None, None
    except Unmapped as fault:
        return [], "no layout", [p.encode(errors="replace").decode() for p in fault.paths]
    except UnicodeEncodeError:
        return [], "not Unicode", None
    except (ValueError, RecursionError):
        return [], "not JSON", None


_TURNS = "conv_id bigint, turn bigint, part int, role string, text string"


def canonical_turns(records: DataFrame) -> DataFrame:
    """Turns of records (conv_id, turn, record as JSON): conv_id, turn, part within the record, role, text.

    Records without a mapping have none; ``rejected`` lists them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (c, t, k, role, text)
                for c, t, r in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turn", "record")], strict=True)
                for k, (role, text) in enumerate(read_record(r)[0])
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _TURNS.split(", ")])

    return records.select("conv_id", "turn", "record").mapInArrow(run, _TURNS)


_REJECTED = "conv_id bigint, turn bigint, record string, reason string, paths array<string>"


def rejected(records: DataFrame) -> DataFrame:
    """The records that have no turns for a reason: no layout (with the paths of the fields), not JSON, or not Unicode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_record(r) for r in batch.column("record").to_pylist()]
            kept = pa.Table.from_batches([batch]).append_column("reason", pa.array([r[1] for r in read], pa.string()))
            kept = kept.append_column("paths", pa.array([r[2] for r in read], pa.list_(pa.string())))
            yield from kept.filter(pa.array([r[1] is not None for r in read], pa.bool_())).to_batches()

    chosen = [F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("record").cast("string")]
    return records.select(*chosen).mapInArrow(run, _REJECTED)


def as_records(conversations: DataFrame) -> DataFrame:
    """One JSON record per row of (conv_id, turn, role, text), in the layout usual for its role."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    message = F.to_json(F.struct(F.struct(role.alias("role"), text.alias("content")).alias("message")))
    record = (
        F.when(role == "user", F.to_json(F.struct(text.alias("prompt"))))
        .when(role == "assistant", F.to_json(F.struct(text.alias("completion"))))
        .when(role == "system", F.to_json(F.struct(F.struct(text.alias("system")).alias("instruction"))))
        .otherwise(message)
    )
    return conversations.select("conv_id", "turn", record.alias("record"))


_FORMATTED = "conv_id bigint, no bigint, formatted string, loss_from bigint, loss_to bigint"


def _batched(rows: Iterator[tuple], schema: str, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """The text of each turn, ``no`` in its conversation, and the range of it under the loss mask (assistant texts).

    The segments of a conversation in order of ``no`` are its formatted text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, no = object(), 0
            for conv, role, text in _rows(batches, "conv_id", "role", "text"):
                no, last = (no + 1 if conv == last else 0), conv
                body, head = escape(text or ""), f"{TURN}{escape(role or '')}\n"
                masked = role == "assistant"
                yield conv, no, f"{head}{body}{END}\n", len(head) if masked else None, len(head) + len(body) if masked else None

        yield from _batched(rows(), _FORMATTED)

    order = ["conv_id", "turn", "part", "role", "text"]
    dealt = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _FORMATTED)


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not (segment.startswith(TURN) and segment.endswith(END + "\n")) or TURN in segment[len(TURN) :] or END in segment[: -len(END) - 1]:
        raise ValueError(f"not a formatted turn: {segment[:60]!r}")
    role, _, text = segment[len(TURN) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """What a conversation's formatted text holds, read turn by turn: counts and digests of turns and of the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last: object = rows
            n = chars = loss = 0
            turns = masked = None
            for conv, segment, low, high in _rows(batches, "conv_id", "formatted", "loss_from", "loss_to"):
                if conv != last or turns is None:
                    if turns is not None:
                        yield last, n, turns.hexdigest(), loss, masked.hexdigest(), chars
                    last, n, chars, loss, turns, masked = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse_turn(segment)
                n, chars = n + 1, chars + len(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if low is not None:
                    kept = unescape(segment[low:high])
                    loss += len(kept)
                    masked.update(kept.encode())
            if turns is not None:
                yield last, n, turns.hexdigest(), loss, masked.hexdigest(), chars

        yield from _batched(rows(), _READ)

    dealt = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "no")
    return dealt.mapInArrow(run, _READ)
