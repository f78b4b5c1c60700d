"""Exact groups, shingle components and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import chunk_dedup, exact_dedup, ngram_join, shingles, signature_tree
from basketlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "to", "mi", "ren", "sol", "ver")) for _ in range(r.randint(1, 4))) for _ in range(n))


def shingle_tuples(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_exact_groups_of_edges_and_of_a_group_over_many_partitions(spark, make, edges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    many = [(i, "a b" if i % 3 else f" a{' ' * (i % 5)}b ") for i in range(600)] + [(1000 + i, f"x{i}") for i in range(100)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for df in (edges, make(many)):
            pairs = [(r.doc_id, r.text) for r in df.collect()]
            want = brute_groups(pairs)
            got = exact_dedup.exact_groups(df).collect()
            assert len(got) == len(pairs)
            by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
            for r in got:
                assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
            kept = [r for r in got if r.kept]
            assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)
            rest = exact_dedup.exact_dedup(df)
            assert rest.columns == df.columns
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rest.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_groups_of_an_empty_table(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).columns == nothing.columns


def brute_components(pairs):
    sets = [(i, shingle_tuples(t)) for i, t in pairs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def near_copies(seed, n=40):
    """Texts with chains of small edits, a passage that all share, and short ones around the threshold."""
    r = random.Random(seed)
    passage, out = words(99, 60), []
    for k in range(n):
        base = words(r.randint(0, 6), 80).split(" ")
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = f"edit{r.randint(0, 9)}"
        out.append((k * 7, " ".join(base) + (" " + passage if k % 3 == 0 else "")))
    for k in range(n):
        w = words(5, 14).split(" ")
        w[r.randrange(14)] = f"e{k % 4}"
        out.append((1000 + k, " ".join(w[: r.randint(3, 14)])))
    return out


def test_components_against_all_pairs(make, edges, spark):
    for df in (edges, make(near_copies(1))):
        pairs = [(r.doc_id, r.text) for r in df.collect()]
        key = lambda t: tuple((x is None, x or 0) for x in t)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect()]
        assert sorted(got, key=key) == sorted(brute_components(pairs), key=key)


def test_components_of_blocks_in_chunks(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 5)
    monkeypatch.setattr(ngram_join, "MINIMA", 1)
    pairs = near_copies(2, 30)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(make(pairs)).collect())
    assert got == sorted(brute_components(pairs))


def test_near_duplicates_of_an_empty_table(nothing):
    assert ngram_join.similar_components(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=25))
def test_trees_lose_no_pair(sets):
    hashed = [np.unique(shingles._mix(np.array(sorted(s), np.uint64))) for s in sets]
    bits = [shingles.bitmap(h) for h in hashed]
    sizes = np.array([len(h) for h in hashed])
    everyone = np.arange(len(sets))
    found = {frozenset(p) for p in signature_tree.block_pairs(bits, sizes, everyone, np.zeros(len(sets), int))}
    sides = everyone % 2
    across = {frozenset(p) for p in signature_tree.block_pairs(bits, sizes, everyone, sides)}
    for a in everyone:
        for b in range(a):
            n = len(sets[a] & sets[b])
            if signature_tree.linked(n, len(sets[a]), len(sets[b])):
                assert frozenset((a, b)) in found
                assert sides[a] == sides[b] or frozenset((a, b)) in across


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=2, max_size=25), st.integers(2, 25))
def test_spanning_pairs_reach_what_all_pairs_reach(sets, n_groups):
    hashed = [np.unique(shingles._mix(np.array(sorted(s), np.uint64))) for s in sets]
    bits, sizes = [shingles.bitmap(h) for h in hashed], np.array([len(h) for h in hashed])
    groups = np.arange(len(sets)) % n_groups
    for sides in (np.zeros(len(sets), int), np.arange(len(sets)) // 2 % 2):
        some = list(signature_tree.spanning_pairs(bits, sizes, groups, sides))
        every = list(signature_tree.block_pairs(bits, sizes, groups, sides))
        assert len(some) < len(set(groups.tolist()))

        def reached(pairs):
            joined = signature_tree.Joined()
            for a, b in pairs:
                joined.put(int(groups[a]), int(groups[b]))
            return [joined.find(int(g)) for g in groups]

        assert reached(some) == reached(every)


def test_a_group_of_near_copies_gives_few_pairs(spark, make):
    """Copies with edits of their own, nearly all linked with each other: pairs grow with the copies, not with their square."""
    base, r = words(77, 110).split(" "), random.Random(6)
    pairs = []
    for k in range(150):
        text = list(base)
        for _ in range(2 if k % 5 == 0 else 1):
            text[r.randrange(len(text))] = f"edit{k}"
        pairs.append((k, " ".join(text)))
    docs = make(pairs)
    profile = ngram_join.profiles(docs, "doc_id", "text")
    alone = spark.createDataFrame([], "node string, root string")
    postings = ngram_join.block_postings(profile, alone)
    blocks = postings.select("token").distinct().count()
    some = ngram_join.block_candidates(profile, postings, alone, spanning=True)
    links = ngram_join.verified(docs, profile.select("id", "cls", "n"), some, "doc_id", "text")
    star = components(links)
    rest = ngram_join.block_candidates(profile, postings, star, spanning=False)
    every = ngram_join.block_candidates(profile, postings, alone, spanning=False)
    assert some.count() <= postings.count() - blocks
    assert some.count() + rest.count() < every.count() / 4
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect())
    assert got == sorted(brute_components(pairs))


def test_shingle_sets_count_as_tuples_do():
    for seed in range(40):
        text = words(seed, seed) + ("\n\tA B a" if seed % 2 else "")
        assert len(shingles.shingle_set(text)) == len(shingle_tuples(text))


def test_sets_of_many_texts_are_those_of_each_text_alone():
    texts = ["", "a", " \t\n", "a b c d", *[words(seed, seed) for seed in range(30)], "x" * shingles.BLOCK, "é A b\x0bc d e", words(1, 30_000), "", words(2, 5)]
    got = list(shingles.shingle_sets(texts))
    assert [len(s) for s in got] == [len(shingle_tuples(t)) for t in texts]
    assert all(np.array_equal(s, shingles.shingle_set(t)) for s, t in zip(got, texts, strict=True))
    assert list(shingles.shingle_sets([])) == []


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("500", f"{i}") for i in range(501, 520)] + [("900", "900")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(1, 41)} | {f"{i}": "500" for i in range(501, 520)}


def brute_passages(pairs, least=chunk_dedup.LEAST):
    """Passages by a dictionary of chunks over the texts in order of id and place."""
    seen, out = {}, []
    for i, text in sorted(pairs):
        run = None
        for a, b, d in chunk_dedup.chunks(text or ""):
            if d in seen:
                run = (run[0], b) if run else (a, b)
            else:
                seen[d] = (i, a)
                if run and run[1] - run[0] >= least:
                    out.append((i, *run))
                run = None
        if run and run[1] - run[0] >= least:
            out.append((i, *run))
    return sorted(out)


def test_repeated_passages_against_a_dictionary(spark, make):
    passage = words(77, 70)
    pairs = [(i, f"{words(100 + i, 40)} {passage if i % 4 == 0 else ''} {words(200 + i, 30)}") for i in range(60)]
    pairs += [(100, pairs[3][1]), (101, None), (102, ""), (103, "é" * 500), (104, words(7, 20_000))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        df = make(pairs)
        got = sorted((r.doc_id, r.start, r.end) for r in chunk_dedup.repeated_passages(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_passages(pairs)
    texts = dict(pairs)
    assert {i for i, *_ in got} >= {i for i in range(4, 60, 4)} | {100}
    for i, a, b in got:
        if i < 100:
            assert i % 4 == 0 and texts[i][a:b].strip()[20:-20] in passage


def test_cutting_resists_insertions():
    text = words(5, 400)
    one, two = {c[2] for c in chunk_dedup.chunks(text)}, {c[2] for c in chunk_dedup.chunks("zz " + text)}
    assert len(one - two) <= 2
    assert [text[a:b] for a, b, _ in chunk_dedup.chunks(text)] and "".join(text[a:b] for a, b, _ in chunk_dedup.chunks(text)) == text


def test_removing_passages(spark, make, tmp_path):
    passage = words(77, 70)
    make([(1, f"start {passage} end"), (2, f"other {words(8, 20)} {passage} tail"), (3, None)]).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = {r.doc_id: r.text for r in chunk_dedup.without_repeats(df).collect()}
    assert out[1] == f"start {passage} end" and out[3] is None
    cuts = [(r.start, r.end) for r in chunk_dedup.repeated_passages(df).collect()]
    text = f"other {words(8, 20)} {passage} tail"
    assert cuts and out[2] == text[: cuts[0][0]] + text[cuts[0][1] :]


def test_repeated_passages_of_an_empty_table(nothing):
    assert chunk_dedup.repeated_passages(nothing).count() == 0


def test_one_row_of_each_component_with_repeated_and_null_ids(make):
    base = words(1, 60)
    near, other, lone = base + " end", words(2, 60), words(3, 60)
    rows = [(1, base), (2, near), (2, other), (3, lone), (3, lone), (None, base), (None, other), (None, words(4, 60)), (None, words(4, 60) + " end"), (5, ""), (None, None)]
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(make(rows)).collect()]
    fourth = [t for i, t in got if i is None and t]
    assert len(fourth) == 1 and fourth[0] in (words(4, 60), words(4, 60) + " end")
    rest = sorted((i or 0, t or "") for i, t in got if (i, t) != (None, fourth[0]))
    assert rest == sorted([(1, base), (2, other), (3, lone), (5, ""), (0, "")])
