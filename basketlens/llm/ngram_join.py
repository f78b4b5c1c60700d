"""Similarity join on word shingles (five words, Jaccard of 0.8 or more) by signature trees.

A text's set of shingles has a name (a digest of the set); equal sets are one class from the start.
1. Counts of hashed shingles over all texts give an order from rare to common.
2. Each set yields its size, a token bitmap, four smallest hashes, and its rarest shingles: two sets
   that are similar share one of those (prefix filter), so no link is lost.
3. Stars: sets with an equal smallest hash are compared with the first of them, and what that links
   needs no further search.
4. Blocks: sets of different stars that share a rare shingle.  In a block, signature trees are
   traversed against each other; node pairs whose largest possible overlap is too small, or whose
   groups are together, are pruned.  Large blocks are dealt out as pairs of chunks.
5. That is done twice.  First a block gives only pairs that would put its stars together, likely ones
   before others, so that a group of thousands of near copies gives no more pairs than members.  When
   those are compared by their whole sets and linked, all pairs of stars still apart follow, each from
   the first block that holds it.
6. Every pair is compared by its whole sets, and links make components.

Defined results: a null text is empty; a text without words has no shingles, is linked with nothing
and is its own component; ties are exact (100 * intersection >= 80 * union); repeated rows share a class.
A row without an id takes part, but never names a component.
"""

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import discard, saved, tidy_shuffles
from basketlens.llm.components import components
from basketlens.llm.shingles import bitmap, digest, shingle_sets
from basketlens.llm.signature_tree import block_pairs, linked, spanning_pairs

WORDS = 5
#: Buckets of the shingle counts, smallest hashes per set, and members of a block that meet in one task.
BUCKETS, MINIMA, CHUNK = 1 << 16, 4, 1_500
#: Smallest tokens of a class that travel with it, by which a block leaves a pair to an earlier one (what it misses is a repeated pair).
FIRST = 64
#: Bits of the map of live shingles that thins out postings before the exact join.
LIVE_BITS = 24
_SEEDS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def _texts(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    return docs.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _values(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.as_py() for t in batch.column("_text"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        held, size = [], 0
        for s in shingle_sets(_values(batch), WORDS):
            held.append(_buckets(s))
            size += len(s)
            if size > BUCKETS:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["counts"])


def shingle_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many sets hold a shingle of each bucket; the table has a fixed number of buckets."""
    with tidy_shuffles(docs.sparkSession):
        rows = _texts(docs, text).mapInArrow(_count, "counts array<bigint>").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r.pos] = r.n
    return counts


def prefix_length(n: int) -> int:
    """Rarest shingles of which similar sets must share one: they have at least four fifths in common."""
    return n - -(-80 * n // 100) + 1


def profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cls, n, bits, minima, rare) of each row; cls is null for an empty set."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for s in shingle_sets(_values(batch), WORDS):
                if not len(s):
                    row = (None, 0, None, None, None)
                else:
                    rare = s[np.argsort(counts.value[_buckets(s)], kind="stable")[: prefix_length(len(s))]]
                    minima = [int(((s ^ seed) * np.uint64(0x9E3779B97F4A7C15)).min().view(np.int64)) for seed in _SEEDS[:MINIMA]]
                    row = (digest(s), len(s), bitmap(s).tobytes(), minima, rare.view(np.int64))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=["id", "cls", "n", "bits", "minima", "rare"])

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, text, key).mapInArrow(run, f"id {kind}, cls string, n bigint, bits binary, minima array<bigint>, rare array<bigint>")


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with sizes and bitmaps whose largest possible overlap suffices."""
    for batch in batches:
        keep = []
        for r in batch.to_pylist():
            one, two = (np.frombuffer(r[f"bits_{s}"], np.uint64) for s in "ab")
            keep.append(any(True for _ in block_pairs([one, two], np.array([r["n_a"], r["n_b"]]), np.array([0, 1]), np.array([0, 1]))))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(digest(s), s.tobytes()) for s in shingle_sets(_values(batch), WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in sets], pa.string()), pa.array([tokens for _, tokens in sets], pa.binary())], names=["cls", "tokens"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            keep.append(bool(linked(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two))))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes that are similar, compared by the whole sets of one text of each class."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "wanted")
    places = saved(members.filter("cls is not null").join(wanted, "cls").groupBy("cls").agg(F.min("id").alias("id")).select("id").distinct(), "places")
    texts = _texts(docs, text, key).withColumnRenamed(key, "_key")
    sets = texts.join(places, F.col("_key").eqNullSafe(F.col("id"))).select("_text").mapInArrow(_sets, "cls string, tokens binary")
    sets = saved(sets.dropDuplicates(["cls"]), "sets")
    found = (
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_compare, "a string, b string")
    )
    out = saved(found, "links")
    discard(wanted, places, sets)
    return out


def stars(profile: DataFrame) -> DataFrame:
    """Pairs of a class with the first class that has the same smallest hash, where the bounds allow a link."""
    keys = profile.filter("cls is not null").select("cls", "n", F.posexplode("minima").alias("pos", "low"))
    hubs = keys.groupBy("pos", "low").agg(F.min(F.struct("cls", "n")).alias("hub"), F.max("cls").alias("last")).filter("hub.cls <> last").drop("last")
    pairs = (
        keys.join(hubs, ["pos", "low"])
        .filter("cls <> hub.cls and 100 * least(n, hub.n) >= 80 * greatest(n, hub.n)")
        .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )
    return possible(profile, pairs)


def possible(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    maps = profile.filter("cls is not null").select("cls", "n", "bits").dropDuplicates(["cls"])
    for side in "ab":
        pairs = pairs.join(maps.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return saved(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_possible, "a string, b string"), "star-pairs")


def _thinned(live: np.ndarray, docs: DataFrame):
    """Keeps of each array of rare shingles those whose bit in the map of live ones is set."""
    shared = docs.sparkSession.sparkContext.broadcast(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = batch.column("rare")
            flat = rare.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), [len(r) if r.is_valid else 0 for r in rare])
            hit = shared.value[(flat.view(np.uint64) >> np.uint64(64 - LIVE_BITS)).astype(np.int64)]
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(rows), batch.column("star").take(rows), pa.array(flat[hit])], names=["cls", "star", "token"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], pairs_of: Callable) -> Iterator[tuple[int, list[dict], Iterator[tuple[int, int]]]]:
    """Token, members and pairs of each block; the rows of a block stand together."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for (token, i, j), block in groupby(rows(), key=lambda r: (r["token"], r["i"], r["j"])):
        members = list(block)
        names = {s: k for k, s in enumerate(sorted({m["star"] for m in members}))}
        if len(names) < 2:
            continue
        groups = np.array([names[m["star"]] for m in members])
        sides = np.array([0 if i == j or m["chunk"] == i else 1 for m in members])
        yield token, members, pairs_of([np.frombuffer(m["bits"], np.uint64) for m in members], np.array([m["n"] for m in members]), groups, sides)


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each block, pairs that would put its stars together."""
    found = ((members[one]["cls"], members[two]["cls"]) for _, members, pairs in _blocks(batches, spanning_pairs) for one, two in pairs)
    yield from _pairs(found)


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each block, all pairs of different stars, but for those that an earlier block has as well."""

    def found() -> Iterator[tuple[str, str]]:
        for token, members, pairs in _blocks(batches, block_pairs):
            earlier: dict[int, set[int]] = {}
            for one, two in pairs:
                for m in (one, two):
                    if m not in earlier:
                        earlier[m] = {t for t in members[m]["first"] if t < token}
                if earlier[one].isdisjoint(earlier[two]):
                    yield members[one]["cls"], members[two]["cls"]

    yield from _pairs(found())


def _pairs(found: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """The pairs, smaller class first, in batches without repetition."""
    while some := set(islice(found, 20_000)):
        rows = sorted({(a, b) if a < b else (b, a) for a, b in some})
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["a", "b"])


def block_postings(profile: DataFrame, star: DataFrame) -> DataFrame:
    """(cls, token) of blocks: rare shingles that classes of different stars share; of blocks with the same members, one."""
    named = profile.filter("cls is not null").select("cls", "rare").dropDuplicates(["cls"]).join(star.withColumnRenamed("node", "cls"), "cls", "left")
    named = saved(named.select("cls", F.xxhash64(F.coalesce("root", "cls")).alias("star"), "rare"), "rare")
    tokens = named.select("star", F.explode("rare").alias("token")).groupBy("token").agg(F.min("star").alias("lo"), F.max("star").alias("hi"))
    live = saved(tokens.filter("lo <> hi").select("token"), "live")
    marks = live.groupBy(F.expr(f"shiftrightunsigned(token, {64 - LIVE_BITS}) div 32768").alias("part")).agg(
        F.expr(f"bitmap_construct_agg(shiftrightunsigned(token, {64 - LIVE_BITS}) % 32768)").alias("bits")
    )
    on = np.zeros(1 << LIVE_BITS, bool)
    for r in marks.collect():
        on[r.part * 32768 : (r.part + 1) * 32768] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
    postings = saved(named.mapInArrow(_thinned(on, profile), "cls string, star bigint, token bigint").join(live, "token").select("cls", "token"), "postings")
    discard(named, live)
    sets = postings.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("cls")).alias("xor"))
    blocks = sets.groupBy("size", "sum", "xor").agg(F.min("token").alias("token")).select("token")
    out = saved(postings.join(blocks, "token"), "block-postings")
    discard(postings)
    return out


def block_candidates(profile: DataFrame, postings: DataFrame, star: DataFrame, spanning: bool) -> DataFrame:
    """Pairs of classes of different stars that share a rare shingle and that the trees leave.

    With ``spanning`` only as many in each block as put its stars together, else all.
    """
    named = postings.join(star.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "token", F.xxhash64(F.coalesce("root", "cls")).alias("star"))
    named = saved(named, "named-postings")
    stars_of = named.groupBy("token").agg(F.count("*").alias("size"), F.min("star").alias("lo"), F.max("star").alias("hi")).filter("lo <> hi")
    live = saved(named.join(stars_of.select("token", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "token"), "live-postings")
    dealt = (
        live.withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cls", "star", "token", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    maps = profile.filter("cls is not null").select("cls", "n", "bits").dropDuplicates(["cls"])
    if not spanning:
        # A class has no more postings than its prefix has shingles.
        maps = maps.join(live.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("token")), 1, FIRST).alias("first")), "cls")
    place = ["token", "i", "j"]
    members = dealt.join(maps, "cls").repartition(*place).sortWithinPartitions(*place)
    out = saved(members.mapInArrow(_spanning if spanning else _traverse, "a string, b string").distinct(), "block-pairs")
    discard(named, live)
    return out


def united(star: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links."""
    return components(star.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links)."""
    profile = saved(profiles(docs, key, text), "profiles")
    members = profile.select("id", "cls", "n")
    pairs = stars(profile)
    first = verified(docs, members, pairs, key, text)
    star = components(first)
    postings = block_postings(profile, star)
    spanning = block_candidates(profile, postings, star, spanning=True)
    second = verified(docs, members, spanning, key, text)
    star = united(star, second)
    others = block_candidates(profile, postings, star, spanning=False)
    rest = verified(docs, members, others, key, text)
    roots = united(star, rest).withColumnRenamed("node", "cls")
    named = members.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("low")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = saved(named, "classes")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    component = saved(named.join(lows, "root").select("cls", "component_id"), "component-of")
    rows = saved(members, "members")
    discard(profile, named, pairs, first, postings, spanning, second, others, rest)
    out = rows.filter("cls is not null").join(component, "cls").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.filter("cls is null").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest id (rows without an id come last); rows without words stay.

    Rows are told apart by id and text, so that rows with one id and different texts are judged each by
    its own; of rows equal in both, one stays.
    """
    # Structs are ordered by their fields, so the smallest key of a component is that of the row to keep.
    named = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.length(text).alias("n"))
    keyed = docs.withColumn("_row_key", named)
    found = saved(similar_components(keyed, "_row_key", text), "keyed-components")
    gone = found.filter("not (component_id <=> _row_key)").select(F.col("_row_key").alias("_gone")).distinct()
    kept = keyed.join(gone, F.col("_row_key") == F.col("_gone"), "left_anti")
    again = found.filter("n_shingles > 0 and component_id <=> _row_key").groupBy("_row_key").count().filter("count > 1").select(F.col("_row_key").alias("_again"))
    again = saved(again, "repeated-rows")
    if not again.isEmpty():
        same = F.col("_row_key") == F.col("_again")
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["_row_key"]))
    return kept.drop("_row_key")
