"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, in SQL expressions only.

A text is cut at line ends and after sentence ends; each distinct piece that is not blank has a 64-bit digest.  A sketch
is ``CELLS`` cells of (count, xor of digests, xor of checks) in three sub-tables; each digest goes to
one cell of each.  Two sketches are subtracted cell by cell, and peeling takes out cells that hold
one digest until none is left: what was taken out are the pieces that differ.  Where peeling gets
stuck, the digests are dealt to more sketches (one for about ``LOAD`` pieces), and any of those that
gets stuck is split in two, four, eight and sixteen with other positions; what even that leaves
(once in some 10^11 sketches) is answered by comparing the digests themselves.

The next document of a row is the one with the next larger id.  Rows are dealt into ranges of ids,
and the first row of each range is also put at the end of the range before, so that no task sees
more than its range.

Defined results: a null text is empty; empty texts have equal fingerprints and likeness 1; of rows
with one id the smaller text comes first; a row without an id has an empty next text and is no row's next.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import partitions, text_of

#: Cells of a sketch (three sub-tables) and pieces for which a larger comparison takes one sketch.
CELLS, LOAD = 48, 8
#: Rounds of peeling, and how often a sketch that is stuck is split.
ROUNDS, SPLITS = 12, 4
_SIDE = CELLS // 3
_PIECES = r"\n|(?<=[.!?]) "


def digests(text: Column) -> Column:
    """Sorted distinct digests of the pieces of a text."""
    pieces = F.filter(F.split(text, _PIECES), lambda p: F.length(F.trim(p)) > 0)
    return F.sort_array(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _tagged(keys: str, level: int, side: str = "1") -> str:
    """Digests with a bit per cell they go to (``m``), their check (``c``) and their side (``s``)."""
    cell = " | ".join(f"shiftleft(1L, cast({j * _SIDE} + (shiftrightunsigned(h.h, {4 * j}) & {_SIDE - 1}L) as int))" for j in range(3))
    # The hash is cut to 48 bits, so that its check is never negative.
    hashed = f"transform({keys}, d -> named_struct('k', d, 'h', shiftrightunsigned(xxhash64(d, {level}L), 16)))"
    return f"transform({hashed}, h -> named_struct('k', h.k, 'm', {cell}, 'c', shiftrightunsigned(h.h, 12), 's', {side}))"


def _cells(tagged: str) -> str:
    """All cells of tagged digests, which are dealt to runs of four cells first, so that a cell looks at few of them."""
    masks = ", ".join(f"named_struct('q', {q}, 'm', {15 << q}L)" for q in range(0, CELLS, 4))
    runs = f"transform(array({masks}), r -> named_struct('q', r.q, 't', filter(t, x -> (x.m & r.m) <> 0)))"
    add = "named_struct('n', z.n + x.s, 'k', z.k ^ x.k, 'c', z.c ^ x.c)"
    one = f"aggregate(r.t, named_struct('n', 0, 'k', 0L, 'c', 0L), (z, x) -> if(getbit(x.m, i) = 1, {add}, z))"
    return f"element_at(transform(array({tagged}), t -> flatten(transform({runs}, r -> transform(sequence(r.q, r.q + 3), i -> {one})))), 1)"


def sketch(keys: str) -> Column:
    """The first sketch of a column of digests: one array of cells, whatever the length of the text."""
    return F.expr(_cells(_tagged(keys, 0)))


def _subtracted(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _peeled(cells: str, level: int) -> str:
    """Digests (k) and sides (s: 1 left, -1 right) that peeling recovers, or null when it gets stuck.

    Only cells that still hold something are carried from round to round.
    """
    filled = "x -> x.n <> 0 or x.k <> 0 or x.c <> 0"
    live = f"filter(transform({cells}, (x, i) -> named_struct('n', x.n, 'k', x.k, 'c', x.c, 'i', i)), {filled})"
    pure = f"filter(st.cells, x -> abs(x.n) = 1 and x.c = shiftrightunsigned(shiftrightunsigned(xxhash64(x.k, {level}L), 16), 12))"
    keys = f"array_distinct(transform({pure}, x -> named_struct('k', x.k, 's', x.n)))"
    tagged = f"element_at(transform(array({keys}), q -> zip_with({_tagged('transform(q, e -> e.k)', level)}, q, (a, b) -> named_struct('k', a.k, 'm', a.m, 'c', a.c, 's', b.s))), 1)"
    less = "aggregate(p, x, (z, y) -> if(getbit(y.m, z.i) = 1, named_struct('n', z.n - y.s, 'k', z.k ^ y.k, 'c', z.c ^ y.c, 'i', z.i), z))"
    found = "concat(st.found, transform(p, y -> named_struct('k', y.k, 's', y.s)))"
    moved = f"named_struct('cells', filter(transform(st.cells, x -> {less}), {filled}), 'found', {found}, 'on', true)"
    step = f"element_at(transform(array({tagged}), p -> if(size(p) = 0, named_struct('cells', st.cells, 'found', st.found, 'on', false), {moved})), 1)"
    none = "cast(array() as array<struct<k:bigint,s:int>>)"
    start = f"named_struct('cells', {live}, 'found', {none}, 'on', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> if(st.on, {step}, st), st -> if(size(st.cells) = 0, st.found, null))"


def _dealt(keys: str, level: int, parts: str, part: str) -> str:
    return f"filter({keys}, d -> pmod(xxhash64(d, {100 + level}L), {parts}) = {part})"


def _halved(left: str, right: str, size: str) -> str:
    """Digests of both sides (u, w) in ``size`` parts (a power of two), halved bit by bit of one hash of each."""
    hashed = lambda keys: f"transform({keys}, d -> named_struct('k', d, 'h', xxhash64(d, 150L)))"
    half = lambda bit: f"named_struct('u', filter(e.u, x -> getbit(x.h, b - 1) = {bit}), 'w', filter(e.w, x -> getbit(x.h, b - 1) = {bit}))"
    start = f"array(named_struct('u', {hashed(left)}, 'w', {hashed(right)}))"
    parts = f"aggregate(sequence(0, cast(round(log2({size})) as int)), {start}, (st, b) -> if(b = 0, st, flatten(transform(st, e -> array({half(0)}, {half(1)})))))"
    return f"transform({parts}, e -> named_struct('u', transform(e.u, x -> x.k), 'w', transform(e.w, x -> x.k)))"


def sketches(left: str, right: str) -> Column:
    """Number of sketches of a larger comparison: a power of two, by the longer of two columns of digests."""
    return F.expr(f"cast(pow(2, ceil(log2(greatest(1.0D, greatest(size({left}), size({right})) / {float(LOAD)}D)))) as int)")


def _difference(left: str, right: str, first_left: str, first_right: str, size: str) -> str:
    """Digests that differ: by the first sketches, else by more and more of them."""

    def by(level: int) -> str:
        a, b = (_dealt(f"g.{c}", level, str(1 << level), "v") if level else f"g.{c}" for c in "uw")
        inner = _peeled(_cells(f"concat({_tagged(a, level)}, {_tagged(b, level, '-1')})"), level)
        return f"flatten(transform(sequence(0, {(1 << level) - 1}), v -> {inner}))" if level else inner

    exact = (
        "concat(transform(array_except(g.u, g.w), d -> named_struct('k', d, 's', 1)), "
        "transform(array_except(g.w, g.u), d -> named_struct('k', d, 's', -1)))"
    )
    block = f"coalesce({', '.join(by(level) for level in range(SPLITS + 1))}, {exact})"
    return f"coalesce({_peeled(_subtracted(first_left, first_right), 0)}, flatten(transform({_halved(left, right, size)}, g -> {block})))"


def difference(left: str, right: str, first_left: str, first_right: str, size: str) -> Column:
    """Array of (k digest, s side) in which two columns of digests differ, from columns of first sketches and of ``sketches``."""
    return F.expr(_difference(left, right, first_left, first_right, size))


def likeness(left: str, right: str, differing: str) -> Column:
    """Shared pieces as a share of all pieces of both; 1 for two empty texts."""
    union = f"(size({left}) + size({right}) + size({differing})) / 2"
    return F.expr(f"if(size({left}) + size({right}) = 0, 1.0D, cast(({union} - size({differing})) / ({union}) as double))")


def written(cells: str) -> Column:
    """A sketch as text: counts in a byte, digests in eight and checks in three bytes, in base 64."""
    cell = "concat(lpad(hex(x.n % 256), 2, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c % 16777216), 6, '0'))"
    return F.expr(f"replace(base64(unhex(array_join(transform({cells}, x -> {cell}), ''))), concat(chr(13), chr(10)), '')")


def _bucket(key: str, splits: list[int]) -> str:
    """Number of splits up to a key, by a coarse and then a fine list."""
    if not splits:
        return "0"
    side = max(1, int(len(splits) ** 0.5))
    listed = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    coarse, fine = listed(splits[::side]), ", ".join(listed(splits[i : i + side]) for i in range(0, len(splits), side))
    return (
        f"element_at(transform(array(size(filter({coarse}, x -> x <= {key}))), "
        f"c -> if(c = 0, 0, (c - 1) * {side} + size(filter(element_at(array({fine}), greatest(c, 1)), x -> x <= {key})))), 1)"
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", made: dict[str, Column] | None = None, empty: dict[str, Column] | None = None) -> DataFrame:
    """Columns key, ``text`` (null as empty) and ``next_text`` of the document with the next larger id (after the last: the first).

    ``made`` names columns of ``text``, each of which may use those before it; they are made once a row, and
    follow with those of the next document as ``next_{name}``.  ``empty`` has what they are for the empty text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), text_of(text).alias("text"))
    n = 2 * partitions(spark)
    shares = F.lit([i / n for i in range(1, n)])
    splits = sorted(set(rows.select(F.percentile_approx("id", shares, 10_000)).first()[0] or []))
    buckets = F.expr(f"if(id is null, -1 - pmod(xxhash64(text), {n}), {_bucket('id', splits)})").cast("int")
    first = sorted(rows.filter("id is not null").select("id", F.expr(_bucket("id", splits)).cast("int").alias("b")).groupBy("b").agg(F.min("id").alias("id")).collect())
    before = {r.id: first[i - 1].b for i, r in enumerate(first)}
    places = F.array(F.struct(buckets.alias("bucket"), F.lit(False).alias("ghost")))
    if before:
        extra = f"try_element_at(map({', '.join(f'{k}L, {v}' for k, v in before.items())}), id)"
        ghost = F.struct(F.expr(extra).cast("int").alias("bucket"), F.lit(True).alias("ghost"))
        places = F.when(F.expr(extra).isNotNull(), F.concat(places, F.array(ghost))).otherwise(places)
    dealt = rows.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.bucket", "at.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", "id", "text")
    none = {"text": F.lit("")} | (empty or {})
    if made:
        # In order before they are made, so that the wider rows are not sorted.
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "ghost", "id", "text")
        for name, column in made.items():
            dealt = dealt.withColumn(name, column)
    following = dealt.select("*", *[F.lead(name).over(order).alias(f"next_{name}") for name in none])
    nexts = [F.when(F.col("id").isNull() | F.col(f"next_{name}").isNull(), x).otherwise(F.col(f"next_{name}")).alias(f"next_{name}") for name, x in none.items()]
    return following.filter("not ghost").select(F.col("id").alias(key), "text", *(made or {}), *nexts)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, the digest of its edited text, both fingerprints, and likeness to the edited and the next text.

    The edited text has its last half replaced by the first as many code points of the next document.
    ``edited_changes`` lists the piece digests in which the edited text differs, as peeled.
    """
    made = {"a": digests(F.col("text")), "cells_a": sketch("a")}
    empty = {"a": F.expr("cast(array() as array<bigint>)"), "cells_a": sketch("cast(array() as array<bigint>)")}
    rows = with_next(docs, key, text, made, empty).withColumn("n_chars", F.length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("e"), F.col("next_a").alias("b"), "cells_a", F.col("next_cells_a").alias("cells_b")
    )
    rows = rows.withColumn("cells_e", sketch("e"))
    rows = rows.withColumn("n_edited", sketches("a", "e")).withColumn("n_next", sketches("a", "b"))
    rows = rows.withColumn("to_edited", difference("a", "e", "cells_a", "cells_e", "n_edited"))
    rows = rows.withColumn("to_next", difference("a", "b", "cells_a", "cells_b", "n_next"))
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        written("cells_a").alias("fingerprint"),
        written("cells_e").alias("edited_fingerprint"),
        likeness("a", "e", "to_edited").alias("near_edited"),
        likeness("a", "b", "to_next").alias("near_next"),
        F.col("to_edited").alias("edited_changes"),
    )
