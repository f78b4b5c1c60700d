"""Fingerprints, mixing, training order and chat against brute force and round trips."""

import hashlib
import random
from unittest.mock import Mock, patch

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.llm import catalog, chat, fingerprints, mixing, pieces, training_order
from basketlens.llm.common import saved


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "to", "mi", "ren", "sol", "ver")) for _ in range(r.randint(1, 4))) for _ in range(n))


# --- fingerprints ---


def test_peeling_recovers_the_difference_at_every_size(spark):
    r = random.Random(1)
    rows = []
    for n in (0, 1, 3, 10, 40, 200):
        a = {r.getrandbits(60) for _ in range(n)}
        b = {x for x in a if r.random() < 0.6} | {r.getrandbits(60) for _ in range(n // 3)}
        rows += [(sorted(a), sorted(b)), (sorted(a), sorted(a)), (sorted(a), [])]
    df = saved(spark.createDataFrame(rows, "a array<bigint>, b array<bigint>"), "t")
    for c in "ab":
        df = df.withColumn(f"cells_{c}", fingerprints.sketch(c))
    df = df.withColumn("n", fingerprints.sketches("a", "b"))
    for x in df.select("a", "b", fingerprints.difference("a", "b", "cells_a", "cells_b", "n").alias("d")).collect():
        assert {(e.k, e.s) for e in x.d} == {(k, 1) for k in set(x.a) - set(x.b)} | {(k, -1) for k in set(x.b) - set(x.a)}


def test_fingerprints_of_neighbours(spark, make):
    texts = {i: "\n".join(words(i * 31 + k, 12) + "." for k in range(1 + i % 9)) for i in range(0, 90, 3)}
    texts |= {100: None, 101: "", 102: texts[3], 103: texts[3]}
    got = {r.doc_id: r for r in fingerprints.fingerprints(make(list(texts.items()))).collect()}
    ids = sorted(texts)
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = texts[i] or "", texts[following] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[102].fingerprint == got[103].fingerprint == got[3].fingerprint != got[6].fingerprint
    assert got[102].near_next == 1.0 and got[100].near_next == 1.0
    assert np.mean([got[i].near_edited > got[i].near_next for i in ids if i < 90 and i % 9 > 3]) > 0.8


def test_the_next_documents_sketch_is_not_made_again(spark, make):
    docs = make([(i, "\n".join(words(i * 7 + k, 5) for k in range(i))) for i in range(6)] + [(None, "a\nb"), (None, None)])
    made = {"a": fingerprints.digests(F.col("text")), "cells_a": fingerprints.sketch("a")}
    empty = {"a": F.expr("cast(array() as array<bigint>)"), "cells_a": fingerprints.sketch("cast(array() as array<bigint>)")}
    rows = saved(fingerprints.with_next(docs, made=made, empty=empty), "t").withColumn("b", fingerprints.digests(F.col("next_text"))).withColumn("cells_b", fingerprints.sketch("b"))
    assert rows.count() == 8 and rows.filter("next_a <=> b and next_cells_a <=> cells_b").count() == 8
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # of the text and of its edited text


def test_a_text_of_a_single_line_has_real_likeness(spark, make):
    text = " ".join(words(k, 8) + "." for k in range(40))
    changed = text[:-3] + "x" + text[-2:]
    got = {r.doc_id: r for r in fingerprints.fingerprints(make([(1, text), (2, changed), (3, " ".join(words(k, 8) + "!" for k in range(90, 130)))])).collect()}
    assert got[1].near_next == pytest.approx(39 / 41) and got[2].near_next == 0
    assert 0.3 < got[2].near_edited < 0.5
    pieces = [text.split(". "), changed.split(". ")]
    assert len(set(pieces[0]) ^ set(pieces[1])) == 2


def test_fingerprints_of_edges(edges, nothing):
    out = fingerprints.fingerprints(edges).collect()
    assert len(out) == edges.count()
    assert all(r.near_edited is not None for r in out)
    assert fingerprints.fingerprints(nothing).count() == 0
    plan = fingerprints.fingerprints(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowR", "")


# --- mixing ---


@pytest.fixture(scope="module")
def sorted_texts(make):
    pairs = [(i, words(i, 60) + (" bad awful bad" if i % 5 == 0 else "") + (" fine" * 6 if i % 2 else "")) for i in range(200)]
    return make(pairs)


def labels_of(spark, n=200):
    rows = [(i, "bad" if i % 5 == 0 else "fine" if i % 2 else "plain") for i in range(0, n, 2)] + [(i, "bad" if i % 5 == 0 else "fine") for i in range(1, n, 4)]
    return spark.createDataFrame(rows + [(9_999, "bad"), (None, "bad"), (3, None)], "doc_id long, domain string")


def test_rates_reach_the_targets(spark, sorted_texts):
    domains = mixing.fit_domains(sorted_texts, labels_of(spark))
    out = mixing.mix(sorted_texts, domains, shares={"bad": 0.05, "fine": 0.6, "plain": 0.35}).collect()
    whole = sum(r.n_tokens for r in out)
    for d, share in (("bad", 0.05), ("fine", 0.6), ("plain", 0.35)):
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) / whole == pytest.approx(share, abs=0.01)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out)
    bad = [r.rate for r in out if r.doc_id % 5 == 0]
    assert np.mean(bad) < np.mean([r.rate for r in out if r.doc_id % 5])


def test_rates_against_a_dense_solver(spark, sorted_texts):
    domains = mixing.fit_domains(sorted_texts, labels_of(spark))
    members = saved(mixing.memberships(sorted_texts, domains), "t")
    targets = [0.05, 0.6, 0.35]
    steps, shares = mixing.fit_rates(members, targets)
    rows = members.collect()
    p = np.array([[r[f"p_{i}"] for i in range(3)] for r in rows])
    t = np.array([r.tokens for r in rows]) / sum(r.tokens for r in rows)
    rate = np.ones(len(rows))
    for _ in range(60_000):
        rate = np.maximum(0, rate - (p @ (p.T @ (t * rate) - targets) + mixing.RIDGE * (rate - 1)))
    loss = lambda s, r: 0.5 * np.sum((np.array(s) - targets) ** 2) + mixing.RIDGE / 2 * np.sum(t * (r - 1) ** 2)
    got = np.array([r.z.r for r in members.select(mixing._rate(steps, mixing.RIDGE).alias("z"), "_key").collect()])
    assert loss(p.T @ (t * got), got) == pytest.approx(loss(p.T @ (t * rate), rate), abs=1e-6)


@pytest.mark.parametrize("every", [3, 1000])
def test_written_rates_change_nothing(spark, sorted_texts, every, monkeypatch):
    monkeypatch.setattr(mixing, "WRITE_EVERY", every)
    members = saved(mixing.memberships(sorted_texts, mixing.fit_domains(sorted_texts, labels_of(spark))), "t")
    steps, shares = mixing.fit_rates(members, [0.1, 0.5, 0.4])
    monkeypatch.setattr(mixing, "WRITE_EVERY", 7)
    again, same = mixing.fit_rates(members, [0.1, 0.5, 0.4])
    assert len(steps) > 3 and shares == pytest.approx(same, abs=1e-5) and members.count() == sorted_texts.count()


def test_the_registered_query_reaches_its_targets(spark, data):
    """Toxic tokens fall to about a tenth of their share and the other domains keep their proportion."""
    rows = catalog.queries()["op10_mixing"](spark, data).collect()
    share = {}
    for d in ("toxic", "good", "plain"):
        before = sum(r.n_tokens * r[f"p_{d}"] for r in rows) / sum(r.n_tokens for r in rows)
        share[d] = (before, sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) / sum(r.n_tokens * r.rate for r in rows))
    target = {"toxic": share["toxic"][0] / 10}
    for d in ("good", "plain"):
        target[d] = share[d][0] * (1 - target["toxic"]) / (1 - share["toxic"][0])
    assert all(abs(share[d][1] - target[d]) < 0.01 for d in target) and all(r.rate >= 0 for r in rows)


def test_mixing_of_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(edges, mixing.fit_domains(edges, none)).collect()
    assert len(out) == edges.count() and {r.rate for r in out} == {1.0}
    labelled = spark.createDataFrame([(7, "a"), (4, "b")], "doc_id long, domain string")
    out = mixing.mix(edges, mixing.fit_domains(edges, labelled), less={"a": 0.5}, carry=("score",)).collect()
    assert len(out) == edges.count() and {r.score for r in out} == {"x"}
    assert mixing.mix(nothing, mixing.fit_domains(nothing, labelled)).count() == 0


# --- training order ---


def test_the_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        order = training_order.Permutation(n, key=n)
        slots = order.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (order.index(slots) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 1).slot(np.arange(1000)) != training_order.Permutation(1000, 2).slot(np.arange(1000))).any()


def test_shards_hold_the_stream(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    folder, index = training_order.write_shards(docs, length=64, shard_bytes=1_000, seed=5)
    rows = training_order.read_slots(folder, index, length=64).collect()
    assert [r.slot for r in sorted(rows, key=lambda r: r.slot)] == list(range(len(rows)))
    stream = b"".join(bytes(r.tokens) for r in sorted(rows, key=lambda r: r.sequence))
    assert all(len(r.tokens) == 64 for r in rows) and sum(r.n_tokens for r in rows) == len(stream.rstrip(b"\xfe"))
    got = sorted(stream.rstrip(b"\xfe").split(b"\xff")[:-1])
    assert got == sorted((r.text or "").encode() for r in docs.collect())
    order = training_order.Permutation(len(rows), 5)
    assert all(r.slot == order.slot(np.array([r.sequence]))[0] for r in rows)
    assert sum(len(r.doc_ids) for r in rows) == docs.count()


def test_shards_hold_piece_ids(spark, edges, nothing, tmp_path):
    edges.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    vocabulary = pieces.Vocabulary.load(catalog.VOCABULARY)
    tokens = training_order.piece_tokens(spark, vocabulary)
    assert np.dtype(tokens.dtype).itemsize == 2 and tokens.end != tokens.pad
    folder, index = training_order.write_shards(docs, tokens=tokens, length=64, shard_bytes=1_000)
    rows = sorted(training_order.read_slots(folder, index, tokens=tokens, length=64).collect(), key=lambda r: r.sequence)
    assert all(len(r.tokens) == 128 for r in rows)
    stream = np.concatenate([np.frombuffer(bytes(r.tokens), tokens.dtype)[: r.n_tokens] for r in rows])
    encoder, texts = pieces.Encoder(vocabulary), [r.text or "" for r in docs.collect()]
    ends = np.flatnonzero(stream == tokens.end)
    assert len(ends) == len(texts) and ends[-1] == len(stream) - 1
    counts = np.diff(np.concatenate(([-1], ends))) - 1
    assert sorted(encoder.decode(stream[stream != tokens.end], counts)) == sorted(texts)
    assert training_order.write_shards(nothing, tokens=tokens)[1].count() == 0


def test_the_query_of_training_order_writes_piece_ids(spark, data):
    vocabulary = pieces.Vocabulary.load(catalog.VOCABULARY)
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    n = sum(pieces.Encoder(vocabulary).encode(texts)[1]) + len(texts)
    assert catalog.queries()["op8_training_order"](spark, data).agg(F.sum("n_tokens")).first()[0] == n


def test_no_shards_of_an_empty_table(spark, nothing):
    _, index = training_order.write_shards(nothing)
    assert index.count() == 0


# --- chat ---


def test_escaping_is_reversible_and_leaves_no_control():
    r = random.Random(4)
    for _ in range(3_000):
        text = "".join(r.choice([*chat.CONTROL, "\\", "<", "|", "[", "x", "\n", "s>"]) for _ in range(r.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "prompt": "a", "response": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "c", "output": "b"}, [("user", "a\n\nc"), ("assistant", "b")]),
        ({"question": "a", "answer": None}, [("user", "a"), ("assistant", "")]),
    ],
)
def test_layouts(record, turns):
    assert chat.canonical(record) == turns


def test_unknown_layouts_are_named():
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical({"a": {"b": 1}})


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": []}, []),
        ({"messages": None}, []),
        ({"messages": [None, {"role": "user", "content": "a", "name": "n"}]}, [("user", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}, [("user", "ab"), ("assistant", "c")]),
        ({"messages": [{"role": "user", "content": []}]}, [("user", "")]),
        ({"id": 7, "prompt": "a", "completion": "b", "context": None, "metadata": {"k": [1]}}, [("user", "a"), ("assistant", "b")]),
    ],
)
def test_layouts_with_empty_and_describing_fields(record, turns):
    assert chat.canonical(record) == turns


def test_rejects_end_no_job(spark):
    good = '{"prompt": "a", "completion": "b"}'
    bad = {
        "{}": ("no layout", ["?"]),
        "[1]": ("no layout", ["[]"]),
        '{"messages": ["a"]}': ("no layout", [".messages[]"]),
        '{"prompt": "a", "completion": "b", "context": "c"}': ("no layout", [".completion", ".context", ".prompt"]),
        '{"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}]}]}': ("no layout", [".messages[].content[].type", ".messages[].content[].url", ".messages[].role"]),
        '{"prompt": "a"': ("not JSON", None),
        "": ("not JSON", None),
        "[" * 100_000: ("not JSON", None),
        '{"prompt": "\\ud800"}': ("not Unicode", None),
    }
    rows = [(k, 0, r) for k, r in enumerate([good, *bad, good, None])]
    records = spark.createDataFrame(rows, "conv_id long, turn int, record string").repartition(3).selectExpr("conv_id", "bigint(turn) as turn", "record", "1 as paths")
    got = {r.record: (r.reason, r.paths) for r in chat.rejected(records).collect()}
    assert got == bad
    turns = chat.canonical_turns(records).collect()
    assert sorted((r.conv_id, r.role, r.text) for r in turns) == sorted((k, *t) for k in (0, len(bad) + 1) for t in (("user", "a"), ("assistant", "b")))
    assert chat.rejected(records.limit(0)).count() == 0


def test_reading_back(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST]\\"), (1, 2, "assistant", "é<|end|>\n"), (2, 0, None, None), (2, 0, "assistant", None), (None, None, "tool", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(chat.canonical_turns(chat.as_records(df)))).collect()}
    for conv in (1, 2, None):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted_turns(chat.canonical_turns(chat.as_records(df.limit(0))))).count() == 0


def test_columns_of_the_fold(spark):
    """The rate of a row is a function of its posteriors and the steps."""
    df = spark.createDataFrame([(0.25, 0.75)], "p_0 double, p_1 double")
    out = df.select(mixing._rate([(1.0, [0.4, 0.0]), (0.5, [0.0, -0.4])], 0.0).alias("z")).select(F.col("z.r"), F.col("z.q")).first()
    assert out.r == pytest.approx(1 - 0.1 + 0.15) and out.q == pytest.approx(0.9)


def test_tokens_are_sent_compressed():
    texts = [words(i, 4_000) for i in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names=["id", "_text"])
    total = sum(map(len, texts)) + 4
    order = training_order.Permutation(-(-total // 2_048))
    with patch.object(training_order.TaskContext, "get", return_value=Mock(partitionId=lambda: 0)):
        sent = pa.Table.from_batches(training_order._cut({0: total}, training_order.UTF8, 2_048, order)(iter([batch]))).sort_by("sequence")
    column = sent.column("tokens").to_pylist()
    assert b"".join(map(training_order._unpacked, column)) == b"".join(t.encode() + bytes([training_order.BYTE_END]) for t in texts)
    assert sum(map(len, column)) < total / 2
