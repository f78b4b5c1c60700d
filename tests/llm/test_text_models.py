"""Languages, personal data and pieces against brute force, round trips and held-out accuracy."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import catalog, common, language_id, personal_data, pieces
from basketlens.llm.catalog import VOCABULARY

# --- languages ---


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_on_rest(docs)
    out = language_id.identify(docs.withColumn("held_out", language_id.held_out()), model).select("row.lang", "row.held_out", "lang_pred", "score").collect()
    tested = [r for r in out if r.held_out]
    assert len(tested) > 150 and np.mean([r.lang == r.lang_pred for r in tested]) >= 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_edges(edges, nothing, make):
    model = language_id.fit_on_rest(edges)
    out = language_id.identify(edges, model).select("row.*", "lang_pred", language_id.F.col("lang_pred"), "row.text").toDF(*edges.columns, "a", "b", "t").collect()
    for r in out:
        letters = any(c.isalpha() for c in r.t or "")
        assert r.a == ("en" if letters else "und")
    empty = language_id.fit(nothing)
    assert [r.lang_pred for r in language_id.identify(make([(1, "abc")]), empty).collect()] == ["und"]
    assert language_id.identify(nothing, model).count() == 0


def test_a_prediction_does_not_depend_on_its_neighbours():
    model = language_id.LanguageModel({"a": ["x"], "b": ["y"]}, [("a", "b")], np.random.default_rng(0).normal(size=(1, 1 << language_id.BITS)).astype(np.float32), np.zeros(1))
    texts = ["abc def", "", None, "  x", "ééé 12 ß", "q" * 40]
    alone = [model.predict([t]) for t in texts]
    names, scores = model.predict(texts)
    assert names == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone])


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@-+% é", max_size=24), st.text("129.. 5", max_size=24))
def test_base_spans_are_those_of_the_patterns(mail, number):
    assert [s[1:] for s in personal_data.base_spans(mail) if s[0] == "email"] == [m.span() for m in EMAIL.finditer(mail)]
    want = [m.span() for m in IP.finditer(number) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [s[1:] for s in personal_data.base_spans(number) if s[0] == "ip"] == want


def test_base_spans_of_cards_and_phones():
    text = "pay 4111 1111 1111 1111 or 4111 1111 1111 1112, call +49 (30) 901820-0 or +1 23"
    assert personal_data.written(personal_data.base_spans(text)) == "card:4:23,phone:53:70"
    assert personal_data.base_spans("1" * 200_000) == []


def test_gradients_against_differences():
    tagger = personal_data.Tagger.fresh()
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(40, 60, (7, 3)), r.integers(0, 5, (7, 3))
    _, grads = tagger.gradients(x, y)
    for k, at in (("deep_f", (3, 2)), ("deep_b", (1, 7)), ("out", (3, 2)), ("turn", (1, 2)), ("table_b", (int(x[2, 1]), 5))):
        old = tagger.weights[k][at]
        losses = []
        for e in (1e-3, -1e-3):
            tagger.weights[k][at] = old + e
            losses.append(tagger.gradients(x, y)[0])
        tagger.weights[k][at] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[k][at], rel=1e-2, abs=1e-5)


def planted(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        head = "".join(r.choice("abcdefg hij ") for _ in range(r.randint(5, 60)))
        mail = f"u{r.randint(1, 999)}@mail{r.randint(1, 9)}.example.com"
        out.append(f"{head} {mail} and {r.randint(1, 250)}.{r.randint(1, 250)}.1.{r.randint(1, 250)} end")
    return out


def test_a_trained_tagger_finds_what_it_was_taught():
    xs, ys = zip(*[personal_data._labelled(t, personal_data.base_spans(t)) for t in planted(150, 1)], strict=True)
    tagger = personal_data.train(np.concatenate(xs), np.concatenate(ys), steps=250)
    texts = planted(60, 2)
    found = personal_data.model_spans(texts, tagger)
    base = [personal_data.base_spans(t) for t in texts]
    hits = sum(len(set(a) & set(b)) for a, b in zip(base, found, strict=True))
    assert hits >= 0.8 * sum(map(len, base))
    assert personal_data.model_spans(["no data here " * 400], tagger) == [[]]
    # Windows are decoded together or apart alike.
    assert [personal_data.model_spans([t], tagger)[0] for t in texts[:5]] == found[:5]


@pytest.fixture(scope="module")
def taught(spark):
    """A model of three quarters of the documents (enough to fill the sample), and the texts of the other quarter."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return personal_data.fit(docs.filter("doc_id % 4 <> 0")), [r.text for r in docs.filter("doc_id % 4 = 0 and text is not null").orderBy("doc_id").collect()]


def test_data_written_in_other_ways_is_found(taught):
    tagger, texts = taught
    found = wanted = wrong = 0
    for seed in range(3):
        r = np.random.default_rng([2024, seed])
        made = [personal_data.rewritten(t, personal_data.base_spans(t), r) for t in texts]
        got = personal_data.all_spans([t for t, _ in made], tagger)
        for (text, planted_spans), (base, both) in zip(made, got, strict=True):
            clear = {s for s in planted_spans if personal_data.plausible(s[0], text[s[1] : s[2]]) and all(s[2] <= b[1] or b[2] <= s[1] for b in base)}
            added = set(both) - set(base)
            assert set(base) <= set(both)
            found, wanted, wrong = found + len(clear & added), wanted + len(clear), wrong + len(added - clear)
    assert wanted > 200 and found >= 0.8 * wanted and wrong <= 0.05 * found


def test_texts_without_data_get_no_spans(taught):
    tagger, texts = taught
    clean = [t for t in texts if not personal_data.base_spans(t)]
    alike = ["on 2024-05-17 08:30 it cost 1,234,567.89 in version 10.4.2", "ISBN 978-3-16-148410-1, dot by dot, at 10:30", "", "x" * 100_000]
    assert len(clean) > 500 and not any(both for _, both in personal_data.all_spans(clean + alike, tagger))


@pytest.mark.parametrize(
    ("kind", "text", "good"),
    [
        ("email", "ann [at] post (dot) example DOT org", True),
        ("email", "ann at the post", False),
        ("ip", "10 . 0 . 0 . 7", True),
        ("ip", "10 . 0 , 0 . 7", False),
        ("ip", "10[.]0[.]0[.]300", False),
        ("card", "4111  1111  1111  1111", True),
        ("card", "4111  1111  1111  1112", False),
        ("phone", "(030) 555-0199", True),
        ("phone", "2024123456", False),
        ("phone", "2024-05-17 08:30", False),
    ],
)
def test_checks_of_other_ways(kind, text, good):
    assert personal_data.plausible(kind, text) is good


def test_marginals_against_all_paths():
    tagger, r = personal_data.Tagger.fresh(), np.random.default_rng(3)
    tagger.weights["turn"] = r.normal(0, 1, (5, 5)).astype(np.float32)
    e = r.normal(0, 1, (4, 1, 5))
    want = np.zeros((4, 5))
    for path in itertools.product(range(5), repeat=4):
        weight = np.exp(sum(e[t, 0, path[t]] for t in range(4)) + sum(tagger.weights["turn"][path[t - 1], path[t]] for t in range(1, 4)))
        for t in range(4):
            want[t, path[t]] += weight
    assert np.allclose(tagger.marginals(e)[:, 0], want / want.sum(1, keepdims=True), atol=1e-5)


def plain_spans(text):
    """The base rules by their patterns alone."""
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    rules = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))),
        ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, p, good in rules for m in p.finditer(text) if good(m[0])]


def test_base_columns_of_all_documents(spark, taught):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = personal_data.find(docs, taught[0]).select("row.doc_id", "row.text", personal_data.spans_text("base").alias("base"), personal_data.spans_text("spans").alias("spans")).collect()
    assert len(got) == docs.count()
    for r in got:
        want = plain_spans(r.text or "")
        assert r.base == personal_data.written(want)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_personal_data_of_edges(edges, nothing, taught):
    assert personal_data.fit(nothing) is None
    for tagger in (None, taught[0]):
        rows = personal_data.find(edges, tagger).select("row.doc_id", personal_data.spans_text("spans").alias("s")).collect()
        assert len(rows) == edges.count() and {r.s for r in rows} == {""}
        assert personal_data.find(nothing, tagger).count() == 0


# --- pieces ---


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(VOCABULARY)


def brute(vocabulary, table, word):
    """Best segmentation by the plain recurrence."""
    best = {0: (0.0, 0, [])}
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + vocabulary.unknown_score(), 0, best[end - 1][2] + [vocabulary.byte_ids[b] for b in word[end - 1].encode()])]
        for start in range(max(0, end - 20), end):
            if word[start:end] in table:
                i, score = table[word[start:end]]
                options.append((best[start][0] + score, end - start, best[start][2] + [i]))
        best[end] = max(options, key=lambda o: o[:2])
    return best[len(word)][2]


def test_pieces_against_the_plain_recurrence(vocabulary):
    table = {p: (i, s) for i, (p, s, n) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal, strict=True)) if n}
    r = random.Random(3)
    words = {"▁" * r.randint(0, 3) + "".join(r.choice("aehinorst,.ßé漢\n") for _ in range(r.randint(1, 12))) for _ in range(400)}
    got = vocabulary.encode_words(list(words))
    assert all(got[w] == brute(vocabulary, table, w) for w in words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" ▁ae\n"), max_size=20), max_size=6))
def test_decoding_gives_the_text_back(texts):
    encoder = pieces.Encoder(pieces.Vocabulary.load(VOCABULARY)) if not hasattr(test_decoding_gives_the_text_back, "e") else test_decoding_gives_the_text_back.e
    test_decoding_gives_the_text_back.e = encoder
    ids, counts = encoder.encode(texts)
    assert encoder.decode(ids, counts) == texts


def test_pieces_leave_in_parts_of_a_batch(spark, vocabulary, make):
    import pyarrow as pa

    texts = ["ab " * 50, None, "", "ünï " * 300, "x"]
    parts = list(pieces.parts_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["_text"]), most=200))
    assert len(parts) > 1 and [t for p in parts for t in p.column("_text").to_pylist()] == texts
    assert [p.num_rows for p in pieces.parts_of(parts[0].slice(0, 0))] == [0]
    # Texts of two blocks and more in one batch of one task.
    docs = make([(i, f"text {i} " + "word another " * 9_000) for i in range(24)] + [(99, None)], parts=1)
    got = pieces.encode(docs, vocabulary, back=True).select("row.doc_id", "row.text", "ids", "decoded").collect()
    assert len(got) == 25 and all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in got)


def test_pieces_of_edges(edges, nothing, vocabulary):
    both = pieces.decode(pieces.encode(edges, vocabulary), vocabulary).select("row.row.text", "decoded", "row.ids").collect()
    assert all(r.text == r.decoded for r in both) and len(both) == edges.count()
    assert all((r.ids is None) == (r.text is None) for r in both)
    at_once = pieces.encode(edges, vocabulary, back=True).select("row.text", "decoded", "ids").collect()
    assert sorted(map(str, at_once)) == sorted(map(str, both))
    assert pieces.encode(nothing, vocabulary).count() == 0


def test_batches_that_go_to_python_are_bounded_in_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["size", "n"])

    try:
        spark.conf.set(name, str(64 << 20))
        catalog.ship(spark)
        found = spark.range(0, 3_000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 10000) AS text").mapInArrow(sizes, "size bigint, n bigint").collect()
        assert sum(r.n for r in found) == 3_000 and max(r.size for r in found) <= common.BATCH_BYTES + 20_000
        spark.conf.set(name, "1m")
        catalog.ship(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_counts_of_a_sample_are_dense_for_one_text_at_a_time():
    texts = [f"word {i}" for i in range(4_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["_lang", "_text"])
    tracemalloc.start()
    list(language_id._samples(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
