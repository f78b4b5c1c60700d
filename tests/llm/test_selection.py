"""Hard negatives, quality rules and target sampling against brute force and SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import compare
import pytest
from conftest import EDGES, words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm import catalog, hard_negatives, quality_rules, target_sampling


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_target_sampling"])
def test_registered_queries_against_sql(spark, data, name):
    got = compare.spark_table(catalog.queries()[name](spark, data))
    assert got[1]
    assert compare.difference(got, compare.duck_table(compare.database(data), catalog.oracle_sql()[name])) is None


# --- hard negatives -------------------------------------------------------------------

ROWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("anchor", T.StringType()),
    ]
)


def mined(rows, is_anchor, positives=5, negatives=3):
    """All pairs, plainly."""
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in good if is_anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in good)
        for s, j, _ in [x for x in scored if x[2] == c and x[1] != i][:positives]:
            below = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(below, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e6])
def test_negatives_equal_brute_force_at_any_field_width(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PACK", 16)
    r = random.Random(5)
    rows = [(i, [r.choice((-1, 0, 1, 2)) * scale + r.random() for _ in range(6)], f"c{i % 3 if i % 4 else 0}") for i in range(120)]
    rows += [(200, None, "c0"), (201, [1.0, None], "c0"), (202, [math.nan] * 6, "c1"), (203, [math.inf] * 6, "c1"), (204, [1.0] * 6, None), (None, [1.0] * 6, "c2")]
    rows += [(210, [], "c1"), (210, [], "c1"), (211, [2.0 * scale], "c0"), (220, [scale] * 9, "c2")]
    rows += [rows[10], rows[10], (10, [0.5] * 6, "c2")]
    df = spark.createDataFrame([(*x, "s", "a") for x in rows], ROWS).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 10 == 0)
    assert sorted(tuple(x) for x in got.collect()) == mined(rows, lambda i: i % 10 == 0)


def test_chunks_and_empty_tables(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)], str(i % 2)) for i in range(60)]
    df = spark.createDataFrame([(*x, "s", "a") for x in rows], ROWS)
    monkeypatch.setattr(hard_negatives, "CHUNK_COMPONENTS", 100)
    got = hard_negatives.mine(df, F.col("id") % 4 == 0, positives=2, negatives=4)
    assert sorted(tuple(x) for x in got.collect()) == mined(rows, lambda i: i % 4 == 0, 2, 4)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 4 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("id") < 0).collect() == []


def test_a_pack_gives_exact_scores():
    import numpy as np

    r = random.Random(7)
    for top in (100, 10**7, 10**13):
        vectors = [[r.randint(-top, top) for _ in range(8)] for _ in range(33)]
        queries = [[r.randint(-top, top) for _ in range(8)] for _ in range(3)]
        pack = hard_negatives.Pack(np.arange(33), ["x"] * 33, vectors, hard_negatives.Anchors([0] * 3, ["x"] * 3, queries, [[]] * 3))
        for q in queries:
            assert pack.scores(q).tolist() == [sum(a * b for a, b in zip(q, v)) for v in vectors]


# --- quality rules --------------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    held = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    threes = [tuple(held[i : i + 3]) for i in range(len(held) - 2)]
    n = Counter(threes)
    repeated = {i + j for i, t in enumerate(threes) if n[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    failed = len(held) < 50 or 100 * len(repeated) > 50 * len(held)
    return (len(held), sum(map(len, held)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed)


def test_base_columns_of_the_registered_query(spark, data):
    got = catalog.queries()["op12_quality_rules"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in got if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert clean and all(r.kept for r in clean)
    assert not junk or any(not r.kept for r in junk)


def histogram_verdicts(rows):
    """Distances by the definition, over (text, lang) rows."""
    q = quality_rules

    def classes(text):
        import unicodedata

        n = dict.fromkeys(q.CLASSES, 0)
        for c in text:
            if c in SPACES:
                continue
            k = unicodedata.category(c)
            n["lower" if k == "Ll" else "upper" if k == "Lu" else "digit" if k[0] == "N" else "mark" if c in q.MARKS else "sign" if k[0] in "PS" else "other"] += 1
        return [n[c] for c in q.CLASSES]

    held = [[w for w in "".join(" " if c in SPACES else c for c in t or "").split(" ") if w] for t, _ in rows]
    langs = {lang or "" for _, lang in rows}
    common = {}
    for lang in langs:
        mine = [set(w) for w, (_, x) in zip(held, rows) if (x or "") == lang]
        votes = Counter(w for s in mine for w in s)
        common[lang] = [w for w, n in sorted(votes.items(), key=lambda x: (-x[1], x[0])) if n >= q.COMMON_SHARE * len(mine)][: q.COMMON_WORDS]
    both = []
    for (t, lang), w in zip(rows, held):
        place = {c: i for i, c in enumerate(common[lang or ""], 1)}
        counts = [0] * (q.COMMON_WORDS + 1)
        for x in w:
            counts[place.get(x, 0)] += 1
        both.append((classes(t or ""), counts))
    failed = [base(t)[-1] for t, _ in rows]

    def far(p, r):
        m = [(x + y) / 2 for x, y in zip(p, r)]
        return math.sqrt(max(0.0, sum(x * math.log2(x / z) for a in (p, r) for x, z in zip(a, m) if x > 0) / 2))

    unlike = [False] * len(rows)
    for _ in range(2):
        found = []
        for i, (_, lang) in enumerate(rows):
            fit = [
                j for j, (_, x) in enumerate(rows)
                if x == lang and not failed[j] and not unlike[j] and sum(both[j][0]) >= q.LEAST_CHARACTERS and sum(both[j][1]) >= q.LEAST_WORDS
            ]
            row = []
            for part, least in ((0, q.LEAST_CHARACTERS), (1, q.LEAST_WORDS)):
                n = sum(both[i][part])
                if n < least or len(fit) < q.LEAST_DOCUMENTS:
                    row.append(None)
                    continue
                mean = [sum(both[j][part][k] / sum(both[j][part]) for j in fit) / len(fit) for k in range(len(both[i][part]))]
                row.append(far([x / n for x in both[i][part]], mean))
            found.append(row)
        unlike = [(a or 0) > q.CHARACTER_LIMIT or (b or 0) > q.WORD_LIMIT for a, b in found]
    return found, [not f and not u for f, u in zip(failed, unlike)]


def test_distances_and_verdicts_equal_their_definition(spark):
    r = random.Random(8)
    usual = [f"w{i}" for i in range(30)]
    texts = [(" ".join(r.choice(usual) if r.random() < 0.4 else words(r.randint(0, 10**6), 1) for _ in range(r.choice((60, 150, 300)))), "aa") for _ in range(60)]
    texts += [(" ".join(w + "###" for w in t.split()).upper(), "aa") for t, _ in texts[:12]]
    texts += [("Ünï «ok» 12 ½ ǅ " * 40 + words(i, 120), None) for i in range(3)] + [(None, "aa"), ("", "bb"), (words(1, 300), "bb")]
    df = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, words string, language string")
    got = sorted(quality_rules.judge(df, ("doc_id", "words", "language")).collect(), key=lambda x: x.row.doc_id)
    found, kept = histogram_verdicts(texts)
    assert [x.kept for x in got] == kept and any(kept) and not all(kept)
    for x, (a, b) in zip(got, found):
        assert x.character_distance == (None if a is None else pytest.approx(a, abs=1e-9))
        assert x.word_distance == (None if b is None else pytest.approx(b, abs=1e-9))
        assert (x.row.words, x.row.language) == ("x", "y")


def test_quality_of_edges(edges, nothing):
    got = quality_rules.judge(edges).collect()
    want = Counter((i, *base(t)) for i, t in EDGES)
    assert Counter((x.row.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == want
    assert quality_rules.judge(nothing).collect() == []


def test_quality_stays_in_expressions(spark, data):
    plan = catalog.queries()["op12_quality_rules"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


# --- target sampling ------------------------------------------------------------------


def grams(text, lowest, highest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    held = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in low).split(" ")
    held = [w for w in held if w]
    return held, [" ".join(held[i : i + n]) for n in range(lowest, highest + 1) for i in range(len(held) - n + 1)]


def resampled(docs, target, lowest, highest, buckets, draw, of, fewest):
    where = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(where(g) for _, t in docs for g in grams(t, lowest, highest)[1])
    t = Counter(where(g) for x in target for g in grams(x, lowest, highest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        held, found = grams(text, lowest, highest)
        weight = sum(gain[where(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(held) >= fewest, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), i, len(found), weight))
    drawn = sum(r[0] for r in rows) * draw // of
    rows.sort(key=lambda r: (not r[0], -r[1], -1 if r[2] is None else r[2]))
    return Counter((i, n, w, score, k if fit and k <= drawn else None) for k, (fit, score, i, n, w) in enumerate(rows, 1))


@pytest.mark.parametrize(("lowest", "highest"), [(1, 1), (1, 2), (2, 3)])
def test_sampling_equals_brute_force(spark, make, lowest, highest):
    docs = [(i, words(i, 10 + i)) for i in range(80)] + [(100, "A-b céÉ 1 1 1 a b"), (101, None), (None, words(2, 40))]
    target = [words(i, 30) for i in range(3)] + [None, "", "ka ka"]
    df = spark.createDataFrame([(t, "z") for t in target], "text string, doc_id string")
    got = target_sampling.resample(make(docs), df, lowest, highest, buckets=97, draw=30)
    assert Counter(map(tuple, got.collect())) == resampled(docs, target, lowest, highest, 97, 30, 100, 20)


def test_sampling_of_edges(spark, edges, nothing):
    target = spark.createDataFrame([("one two",)], "text string")
    got = target_sampling.resample(edges, target).collect()
    assert Counter(map(tuple, got)) == resampled(EDGES, ["one two"], 1, 1, 10_000, 10, 100, 20)
    assert target_sampling.resample(nothing, target).collect() == []
    assert len(target_sampling.resample(edges, target.limit(0)).collect()) == len(EDGES)


def test_spans_overlap():
    body = target_sampling.collapsed(" A,b  cé!d ")
    assert list(target_sampling.spans(body, 1, 2)) == ["a".encode(), b"b", "cé".encode(), b"d", b"a b", "b cé".encode(), "cé d".encode()]
