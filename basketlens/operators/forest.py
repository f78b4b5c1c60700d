"""Random forests grown as ``pyspark.ml`` grows them, on rows that are a few small codes each.

The trees are those of ``RandomForestClassifier`` and ``RandomForestRegressor`` with their defaults: the same bags,
feature subsets, thresholds, order of nodes, gains and ties.  What differs is the layout.  A row is one code per attribute
(which slot of its one-hot vector is set, or which bin its number falls into) and one count per tree, packed
as bytes, instead of a vector with an entry per slot.  A step counts codes per attribute, not slots.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The defaults of the forests of pyspark.ml.
MAX_BINS = 32
MEMORY = 256 << 20
EPSILON = float(np.finfo(float).eps)
#: Rows in one string of bytes.
PACK = 40_000
#: Cells of a histogram that is counted for several attributes at once, and of one that holds all codes of an attribute.
JOINT_CELLS, WIDEST = 1 << 14, 1 << 20


@dataclass(frozen=True)
class Attribute:
    """A column of codes: one-hot slots (0 to width - 1, and width for none), or bins between ``thresholds``."""

    name: str
    width: int
    thresholds: tuple[float, ...] | None = None

    @property
    def codes(self) -> int:
        return self.width + 1 if self.thresholds is None else len(self.thresholds) + 1

    @property
    def features(self) -> int:
        return self.width if self.thresholds is None else 1

    def code(self, value: Column) -> Column:
        """The code of a slot's number or of a value; bins are closed on the right."""
        if self.thresholds is not None:
            value = reduce(lambda a, b: a + b, [(value > F.lit(t)).cast("int") for t in self.thresholds], F.lit(0))
        return value.cast("byte" if self.codes < 128 else "short" if self.codes < 32_768 else "int").alias(self.name)


def thresholds(known: DataFrame, columns: list[str], rows: int, seed: int) -> dict[str, tuple[float, ...]]:
    """Candidate thresholds of numeric columns from a sample of the rows, as ``RandomForest.findSplits`` draws and places them."""
    spark = known.sparkSession
    wanted = max(MAX_BINS * MAX_BINS, 10_000)
    fraction = wanted / rows if wanted < rows else 1.0
    drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    chosen = known.select(*[F.col(f"`{c}`").cast("double") for c in columns])
    sampled = chosen._jdf.javaRDD().sample(False, fraction, drawn)
    sample = DataFrame(spark._jsparkSession.createDataFrame(sampled, chosen._jdf.schema()), spark).collect()
    expected, most = fraction * rows, min(MAX_BINS, rows) - 1
    found = {}
    for i, c in enumerate(columns):
        values, counts = np.unique(np.array([r[i] for r in sample if r[i] != 0.0], float), return_counts=True)
        seen = dict(zip(values.tolist(), counts.astype(float).tolist()))
        rest = expected - float(counts.sum())
        if seen and rest > np.finfo(float).eps * float(counts.sum()) * 100:
            seen[0.0] = rest
        found[c] = _placed(sorted(seen.items()), expected, most)
    return found


def _placed(counts: list[tuple[float, float]], expected: float, most: int) -> tuple[float, ...]:
    middles = [(a[0] + b[0]) / 2.0 for a, b in zip(counts, counts[1:])]
    if len(middles) <= most:
        return tuple(middles)
    stride = expected / (most + 1)
    kept, current, target = [], counts[0][1], stride
    for middle, (_, n) in zip(middles, counts[1:]):
        before, current = current, current + n
        if abs(before - target) < abs(current - target):
            kept.append(middle)
            target += stride
    return tuple(kept)


def _object(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def bagged(df: DataFrame, trees: int, seed: int) -> DataFrame:
    """The rows of ``df`` (no nulls) with ``_times``: how often each tree draws them, by the bags of ``pyspark.ml`` itself.

    Bags follow the order of the rows in their partitions.  The class that deals them has no
    interface in Python, so its rows are read by field.
    """
    spark = df.sparkSession
    jvm, catalyst = spark._jvm, spark._jvm.org.apache.spark.sql.catalyst
    bag = jvm.org.apache.spark.ml.tree.impl.BaggedPoint
    one = getattr(bag, "convertToBaggedRDD$default$5")()
    rows = bag.convertToBaggedRDD(df._jdf.queryExecution().toRdd(), 1.0, trees, True, one, seed)

    def listed(*items):
        found = jvm.java.util.ArrayList()
        for x in items:
            found.append(x)
        return jvm.scala.jdk.javaapi.CollectionConverters.asScala(found).toSeq()

    def kind(name: str):
        return jvm.org.apache.spark.sql.types.ObjectType(jvm.java.lang.Class.forName(name, True, loader))

    def call(on, method: str, returns, *arguments):
        return catalyst.expressions.objects.Invoke(on, method, returns, listed(*arguments), listed(), True, False, True)

    def named(expression, name: str):
        return catalyst.expressions.Alias(expression, name, catalyst.expressions.NamedExpression.newExprId(), listed(), _object(jvm.scala, "None"), listed())

    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    none = jvm.org.apache.spark.sql.types.Metadata.empty()
    point = catalyst.expressions.AttributeReference(
        "_point", kind("org.apache.spark.ml.tree.impl.BaggedPoint"), False, none, catalyst.expressions.NamedExpression.newExprId(), listed()
    )
    row = call(point, "datum", kind("org.apache.spark.sql.catalyst.expressions.UnsafeRow"))
    getters = {"tinyint": "getByte", "smallint": "getShort", "int": "getInt", "double": "getDouble"}
    fields = []
    for i, f in enumerate(df.schema.fields):
        place = _object(catalyst.expressions, "Literal").apply(i)
        made = jvm.org.apache.spark.sql.types.DataType.fromDDL(f.dataType.simpleString())
        fields.append(named(call(row, getters[f.dataType.simpleString()], made, place), f.name))
    numbers = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<int>")
    times = catalyst.expressions.objects.StaticInvoke(
        jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.UnsafeArrayData", True, loader),
        numbers, "fromPrimitiveArray", listed(call(point, "subsampleCounts", kind("[I"))), listed(), True, False, True,
        jvm.scala.Option.empty(),
    )
    session = spark._jsparkSession
    read = jvm.org.apache.spark.sql.execution.ExternalRDD(point, rows, session)
    plan = catalyst.plans.logical.SerializeFromObject(listed(*fields, named(times, "_times")), read)
    return DataFrame(_object(jvm.org.apache.spark.sql.classic, "Dataset").ofRows(session, plan), spark)


def _code_type(attributes: list[Attribute]) -> type:
    return np.uint8 if all(a.codes <= 256 for a in attributes) else np.uint16 if all(a.codes <= 65_536 for a in attributes) else np.int32


@dataclass
class Bag:
    """Packed training rows with their counts per tree; shared by all targets that train on the same rows."""

    packs: RDD
    attributes: list[Attribute]
    trees: int
    rows: int
    numeric: bool
    merged: bool

    def unpersist(self) -> None:
        self.packs.unpersist()

    def reader(self) -> Callable[[tuple[int, bytes]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Codes (attribute, row), counts (tree, row) and numeric labels of a pack."""
        width, trees, numeric = len(self.attributes), self.trees, self.numeric
        code_type, count_type = np.dtype(_code_type(self.attributes)), np.dtype(np.int64 if self.merged else np.uint8)

        def read(pack: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
            n, rows = pack
            first = n * width * code_type.itemsize
            second = first + n * trees * count_type.itemsize
            codes = np.frombuffer(rows, code_type, n * width).reshape(width, n)
            times = np.frombuffer(rows, count_type, n * trees, first).reshape(trees, n)
            return codes, times, np.frombuffer(rows, float, n, second) if numeric else None

        return read


def pack_bag(known: DataFrame, attributes: list[Attribute], rows: int, trees: int, seed: int, label: str | None = None, merge: bool = False) -> Bag:
    """One spillable copy of the rows: codes, counts per tree and, for a numeric ``label``, its values.

    ``merge`` adds up the counts of rows that are equal in all codes; it is for few and narrow attributes, where
    the number of different rows has a bound of its own.
    """
    # The order of the rows decides the bags, so whatever is made of them comes after.
    values = {a.name: F.col(f"`{a.name}`").cast("double" if a.thresholds is not None else "int").alias(a.name) for a in attributes}
    dealt = known.select(*values.values(), *([F.col(f"`{label}`").cast("double").alias("_label")] if label else []))
    coded = [a.code(F.col(f"`{a.name}`")) for a in attributes]
    drawn = bagged(dealt, trees, seed).select(*coded, "_times", *(["_label"] if label else []))
    if merge and not label:
        names = [f"`{a.name}`" for a in attributes]
        sums = [F.sum(F.col("_times")[t]).alias(f"_{t}") for t in range(trees)]
        drawn = drawn.groupBy(*names).agg(*sums).select(*names, F.array(*[F.col(f"_{t}") for t in range(trees)]).alias("_times"))
    merge = merge and not label
    code_type, count_type, width = _code_type(attributes), np.int64 if merge else np.uint8, len(attributes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def packed() -> pa.RecordBatch:
            codes = np.concatenate([c for c, _, _ in kept], axis=1)
            times = np.concatenate([t for _, t, _ in kept], axis=1)
            content = codes.tobytes() + times.tobytes()
            if label:
                content += np.concatenate([y for _, _, y in kept]).tobytes()
            return pa.record_batch({"n": pa.array([codes.shape[1]], pa.int32()), "rows": pa.array([content], pa.binary())})

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(code_type) for i in range(width)])
            times = batch.column(width).flatten().to_numpy(zero_copy_only=False).reshape(n, trees)
            if not merge and times.max() > 255:
                raise ValueError("a row is drawn more than 255 times")
            y = batch.column(width + 1).to_numpy(zero_copy_only=False) if label else None
            kept.append((codes, np.ascontiguousarray(times.T.astype(count_type)), y))
            held += n
            if held >= PACK:
                yield packed()
                kept, held = [], 0
        if held:
            yield packed()

    packs = drawn.mapInArrow(pack, "n int, rows binary").rdd.map(lambda row: (row.n, bytes(row.rows)))
    return Bag(packs.persist(StorageLevel.MEMORY_AND_DISK), attributes, trees, rows, bool(label), merge)



@dataclass
class Node:
    """A node of a tree; ``stats`` are counts per class, or weight, sum and sum of squares."""

    stats: np.ndarray
    impurity: float
    level: int
    gain: float = float("nan")
    valid: bool = True
    feature: int = -1
    left: tuple[int, ...] = ()
    children: "tuple[Node, Node] | None" = None


@dataclass(frozen=True)
class Task:
    """What a forest is grown for: the bag's attributes that are features, in order, and the label's (none if it is numeric)."""

    attributes: tuple[Attribute, ...]
    inputs: tuple[int, ...]
    label: int | None
    classes: int

    @property
    def numeric(self) -> bool:
        return self.label is None

    @property
    def width(self) -> int:
        return 3 if self.numeric else self.classes

    def features(self) -> list[tuple[int, int | None]]:
        """Attribute of each feature, and its slot if it is one."""
        found = []
        for i in self.inputs:
            a = self.attributes[i]
            found += [(i, None)] if a.thresholds is not None else [(i, slot) for slot in range(a.width)]
        return found

    def impurity(self, stats: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.numeric:
                n, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
                return np.where(n == 0, 0.0, (squares - total * total / n) / n)
            n, left = stats.sum(axis=-1), np.ones(stats.shape[:-1])
            for c in range(self.classes):
                share = stats[..., c] / n
                left = left - share * share
            return np.where(n == 0, 0.0, left)

    def weight(self, stats: np.ndarray) -> np.ndarray:
        return stats[..., 0] if self.numeric else stats.sum(axis=-1)

    def prediction(self, stats: np.ndarray) -> float:
        if self.numeric:
            return float(stats[1] / stats[0]) if stats[0] else 0.0
        return float(np.argmax(stats))


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.state >> (48 - bits)
        return x - (1 << bits) if bits == 32 and x >= 1 << 31 else x

    def next_long(self) -> int:
        x = ((self.next(32) << 32) + self.next(32)) & ((1 << 64) - 1)
        return x - (1 << 64) if x >= 1 << 63 else x


def drawn_features(spark: SparkSession, features: int, wanted: int, seed: int) -> list[int]:
    """``SamplingUtils.reservoirSampleAndCount`` of the feature numbers."""
    kept, mask = list(range(wanted)), (1 << 64) - 1
    state = _object(spark._jvm.org.apache.spark.util.random, "XORShiftRandom").hashSeed(seed) & mask

    def bits(n: int) -> int:
        nonlocal state
        x = (state ^ (state << 21)) & mask
        x ^= x >> 35
        state = (x ^ (x << 4)) & mask
        return state & ((1 << n) - 1)

    for item in range(wanted, features):
        place = int(((bits(26) << 27) + bits(27)) * 2.0**-53 * (item + 1))
        if place < wanted:
            kept[place] = item
    return kept


def _order(spark: SparkSession, trees: list[int]) -> list[int]:
    """The order in which Scala's immutable map hands out these keys."""
    jvm = spark._jvm
    found = jvm.scala.collection.mutable.HashMap()
    for t in trees:
        found.put(t, t)
    return [int(t) for t in found.toMap(_object(jvm.scala, "$less$colon$less").refl()).keys().mkString(",").split(",")]


def _routes(task: Task, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Attribute that each node looks at, and the node that each code leads to; a leaf leads to itself."""
    number, features = {id(x): i for i, x in enumerate(nodes)}, task.features()
    inner = [x for x in nodes if x.children]
    wide = max((task.attributes[features[x.feature][0]].codes for x in inner), default=1)
    at, go = np.zeros(len(nodes), np.intp), np.repeat(np.arange(len(nodes))[:, None], wide, axis=1)
    for x in inner:
        i = number[id(x)]
        at[i], slot = features[x.feature]
        lefts = np.zeros(wide, bool)
        if slot is None:
            lefts[list(x.left)] = True
        else:
            lefts[:] = 0 in x.left
            lefts[slot] = 1 in x.left
        go[i] = np.where(lefts, number[id(x.children[0])], number[id(x.children[1])])
    return at, go


def _arrived(at: np.ndarray, go: np.ndarray, steps: int, codes: np.ndarray) -> np.ndarray:
    """The node that each row (a column of ``codes``) comes to."""
    n, wide = codes.shape[1], go.shape[1]
    if not steps:
        return np.zeros(n, np.intp)
    node = go[0].take(codes[at[0]])
    flat, targets, rows, starts = codes.reshape(-1), go.reshape(-1), np.arange(n), at * n
    for _ in range(steps - 1):
        node = targets.take(node * wide + flat.take(starts.take(node) + rows))
    return node


def _joined(task: Task, used: list[int], nodes: int) -> list[list[int]]:
    """Attributes that are counted together: the cells of a histogram stay few, and its sums are those of each attribute."""
    most, groups = JOINT_CELLS // (nodes * max(task.classes, 1)), []
    for i in sorted(used, key=lambda i: -task.attributes[i].codes):
        for group in groups:
            if group[0] * task.attributes[i].codes <= most:
                group[0] *= task.attributes[i].codes
                group.append(i)
                break
        else:
            groups.append([task.attributes[i].codes, i])
    return [group[1:] for group in groups]


@dataclass
class _Step:
    """What is counted of the nodes of one tree, and the line of the result that each count goes to."""

    tree: int
    at: np.ndarray
    go: np.ndarray
    steps: int
    place: np.ndarray
    nodes: int
    totals: np.ndarray
    cells: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)


def _counts(bag: Bag, task: Task, steps: list[_Step], lines: int) -> np.ndarray:
    """Stats of the training nodes and of the bins of their features, from one pass over the rows."""
    used = sorted({i for s in steps for i in s.cells})
    nodes = max(s.nodes for s in steps)
    # Too many codes for a histogram of all: only those that a node asks for are told apart.
    wide = {i for i in used if nodes * max(task.classes, 1) * task.attributes[i].codes > WIDEST}
    groups = _joined(task, [i for i in used if i not in wide], nodes) + [[i] for i in sorted(wide)]
    read, numeric, classes, label = bag.reader(), task.numeric, max(task.classes, 1), task.label
    codes_of = {i: task.attributes[i].codes for i in used}
    for s in steps:
        s.cells = {i: np.array(x).T for i, x in s.cells.items()}
    lookups = {}
    for j, s in enumerate(steps):
        for i in wide & set(s.cells):
            seen, table = np.zeros(s.nodes, np.intp), np.zeros((s.nodes, codes_of[i]), np.intp)
            for m in range(s.cells[i].shape[1]):
                node, code, _ = s.cells[i][:, m]
                seen[node] += 1
                table[node, code] = s.cells[i][1, m] = seen[node]
            lookups[j, i] = int(seen.max()) + 1, table.reshape(-1)
    # The groups that count something for a tree; one without features still counts its rows.
    asked = [[g for g, group in enumerate(groups) if not s.cells.keys().isdisjoint(group)] or [-1] for s in steps]
    sent = bag.packs.context.broadcast((steps, groups, lookups, asked))

    def counted(packs: Iterator[tuple[int, bytes]]) -> Iterator[np.ndarray]:
        steps, groups, lookups, asked = sent.value
        held: dict[tuple[int, int], np.ndarray] = {}

        def dims(j: int, g: int) -> tuple[int, ...]:
            return tuple(lookups[j, i][0] if i in wide else codes_of[i] for i in groups[g]) if g >= 0 else ()

        for pack in packs:
            codes, times, y = read(pack)
            classed = None if numeric else codes[label].astype(np.intp)
            joint = {}
            for g, group in enumerate(groups):
                joint[g] = codes[group[0]].astype(np.intp)
                for i in group[1:]:
                    joint[g] = joint[g] * codes_of[i] + codes[i]
            for j, s in enumerate(steps):
                node, drawn = s.place.take(_arrived(s.at, s.go, s.steps, codes)), times[s.tree]
                chosen = np.flatnonzero((drawn != 0) & (node >= 0))
                node, weight = node.take(chosen), drawn.take(chosen).astype(float)
                if numeric:
                    base, mine = node, y.take(chosen)
                    sums = [weight, weight * mine, weight * mine * mine]
                else:
                    base, sums = node * classes + classed.take(chosen), [weight]
                for g in asked[j]:
                    place, size = base, math.prod(dims(j, g))
                    if g >= 0:
                        code = joint[g].take(chosen)
                        if groups[g][0] in wide:
                            code = lookups[j, groups[g][0]][1].take(node * codes_of[groups[g][0]] + code)
                        place = base * size + code
                    found = np.stack([np.bincount(place, x, s.nodes * classes * size) for x in sums])
                    held[j, g] = held[j, g] + found if (j, g) in held else found
        out = np.zeros((lines, 3 if numeric else classes))
        for (j, g), found in held.items():
            s = steps[j]
            cube = found.reshape(len(found), s.nodes, classes, *dims(j, g))
            cube = np.moveaxis(cube[:, :, 0], 0, 1) if numeric else cube[0]
            axes = range(2, cube.ndim)
            if g == asked[j][0]:
                out[s.totals] += cube.sum(axis=tuple(axes))
            for k, i in enumerate(groups[g] if g >= 0 else ()):
                if i in s.cells:
                    mine = cube.sum(axis=tuple(x for x in axes if x != k + 2))
                    node, code, line = s.cells[i]
                    out[line] += mine[node, :, code]
        yield out

    try:
        return bag.packs.mapPartitions(counted).treeReduce(lambda a, b: a + b)
    finally:
        sent.unpersist()


def _best(task: Task, node: Node, depth: int, subset: list[int], features: list[tuple[int, int | None]], total: np.ndarray, bins: list[np.ndarray]) -> None:
    """Choose the split of a node as ``RandomForest.binsToBestSplit`` does: the first of the largest gains, features in drawn order."""
    if node.level == 0:
        node.impurity = float(task.impurity(total))
    parts = []  # (place in the drawn order, feature, left bins, left stats, right stats) of each possible split
    slots = [(k, f) for k, f in enumerate(subset) if features[f][1] is not None]
    if slots:
        ones = np.stack([bins[k][0] for k, _ in slots])
        zeros = total - ones
        swap = np.zeros(len(slots), bool)
        # Two values are ordered by the mean, or by how many rows of class 1 they have; with more classes they are not.
        if task.numeric or task.classes == 2:
            with np.errstate(divide="ignore", invalid="ignore"):
                place = [np.where(task.weight(x) == 0, np.inf, x[:, 1] / x[:, 0] if task.numeric else x[:, 1]) for x in (zeros, ones)]
            swap = place[1] < place[0]
        lefts, rights = np.where(swap[:, None], ones, zeros), np.where(swap[:, None], zeros, ones)
        parts += [(k, f, (int(x),), a, b) for (k, f), x, a, b in zip(slots, swap, lefts, rights)]
    for k, f in enumerate(subset):
        if features[f][1] is None:
            below = np.cumsum(bins[k], axis=0)
            parts += [(k, f, tuple(range(j + 1)), a, below[-1] - a) for j, a in enumerate(below[:-1])]
    parts.sort(key=lambda x: x[0])
    best = None
    if parts:
        lefts, rights = (np.stack([x[i] for x in parts]) for i in (3, 4))
        n_left, n_right = task.weight(lefts), task.weight(rights)
        with np.errstate(divide="ignore", invalid="ignore"):
            n = n_left + n_right
            gain = node.impurity - n_left / n * task.impurity(lefts) - n_right / n * task.impurity(rights)
        valid = (n_left >= 1) & (n_right >= 1) & (gain >= 0)
        gain = np.where(valid, gain, -np.finfo(float).max)
        k = int(np.argmax(gain))
        best = float(gain[k]), *parts[k][1:], bool(valid[k])
    if best is None:
        node.gain, node.valid = -np.finfo(float).max, False
        return
    node.gain, node.valid = best[0], best[5]
    if node.gain > 0 and node.level < depth:
        node.feature, node.left = best[1], best[2]
        left, right = (Node(x, float(task.impurity(x)), node.level + 1) for x in best[3:5])
        node.children = left, right


def grow(bag: Bag, task: Task, depth: int, seed: int) -> list[Node]:
    """The roots of the bag's trees."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    features, trees = task.features(), bag.trees
    if trees == 1:
        wanted = len(features)
    else:
        wanted = math.ceil(len(features) / 3.0) if task.numeric else math.ceil(math.sqrt(len(features)))
    lines = [1 if slot is not None else task.attributes[i].codes for i, slot in features]
    room = [(3 if task.numeric else task.classes) * (2 if slot is not None else n) * 8 for n, (_, slot) in zip(lines, features)]
    random, roots = JavaRandom(seed), [Node(np.zeros(task.width), 0.0, 0) for _ in range(trees)]
    # The next node to train stands last; all nodes that fit into the memory of a step are trained together.
    stack = [(t, roots[t]) for t in range(trees)]
    while stack:
        group: dict[int, list[tuple[Node, list[int]]]] = {}
        held = 0
        while stack:
            t, node = stack[-1]
            subset = list(range(len(features)))
            if wanted < len(features):
                subset = drawn_features(spark, len(features), wanted, random.next_long())
            needed = sum(room[f] for f in subset)
            if held and held + needed > MEMORY:
                break
            stack.pop()
            group.setdefault(t, []).append((node, subset))
            held += needed
        steps, line, places = [], 0, {}
        for t, some in group.items():
            nodes = _nodes(roots[t])
            number = {id(x): i for i, x in enumerate(nodes)}
            at, go = _routes(task, nodes)
            place = np.full(len(nodes), -1, np.intp)
            step = _Step(t, at, go, max(x.level for x, _ in some), place, len(some), np.arange(line, line + len(some)))
            line += len(some)
            for k, (node, subset) in enumerate(some):
                place[number[id(node)]] = k
                places[id(node)] = []
                for f in subset:
                    i, slot = features[f]
                    places[id(node)].append((line, line + lines[f]))
                    step.cells.setdefault(i, []).extend((k, c, line + c - (slot or 0)) for c in ([slot] if slot is not None else range(lines[f])))
                    line += lines[f]
            steps.append(step)
        found = _counts(bag, task, steps, line)
        totals = {id(x): found[s.totals[k]] for s in steps for k, (x, _) in enumerate(group[s.tree])}
        for t in _order(spark, list(group)):
            for node, subset in group[t]:
                bins = [found[a:b] for a, b in places[id(node)]]
                if node.level == 0:
                    node.stats = totals[id(node)]
                _best(task, node, depth, subset, features, totals[id(node)], bins)
                if node.children:
                    for child in node.children:
                        if child.level < depth and abs(child.impurity) >= EPSILON:
                            stack.append((t, child))
    return [_pruned(task, root) for root in roots]


def _nodes(root: Node) -> list[Node]:
    found = [root]
    for x in found:
        found += x.children or ()
    return found


def _pruned(task: Task, node: Node) -> Node:
    """Two leaves that predict the same are one."""
    if node.children:
        node.children = tuple(_pruned(task, x) for x in node.children)
        left, right = node.children
        if not left.children and not right.children and task.prediction(left.stats) == task.prediction(right.stats):
            node.children = None
    return node


class Forest:
    """A grown forest; all that it lacks is asked of the ordinary ``pyspark.ml`` model, which is made when first needed."""

    def __init__(self, task: Task, roots: list[Node], **settings):
        self.task, self.roots, self.settings = task, roots, settings

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "model":
            raise AttributeError(name)
        return getattr(self.model, name)

    @cached_property
    def model(self) -> Model:
        """The ordinary model, on the features that ``VectorAssembler`` makes of the attributes in order."""
        spark, task = SparkSession.getActiveSession(), self.task
        jvm, features = spark._jvm.org.apache.spark, task.features()

        def numbers(x: np.ndarray):
            return _py2java(spark.sparkContext, Vectors.dense(x)).values()

        def made(x: Node):
            n = int(task.weight(x.stats))
            kind = jvm.mllib.tree.impurity.VarianceCalculator if task.numeric else jvm.mllib.tree.impurity.GiniCalculator
            stats, guess = kind(numbers(x.stats), n), task.prediction(x.stats)
            if not x.children:
                return jvm.ml.tree.LeafNode(guess, x.impurity if x.valid else -1.0, stats)
            i, slot = features[x.feature]
            if slot is None:
                split = jvm.ml.tree.ContinuousSplit(x.feature, task.attributes[i].thresholds[x.left[-1]])
            else:
                split = jvm.ml.tree.CategoricalSplit(x.feature, numbers(np.array(x.left, float)), 2)
            return jvm.ml.tree.InternalNode(guess, x.impurity, x.gain, *map(made, x.children), split, stats)

        settings = {"featuresCol": "features", "numTrees": len(self.roots), **self.settings}
        if task.numeric:
            fitter, one, all_, known = RandomForestRegressor(**settings), jvm.ml.regression.DecisionTreeRegressionModel, jvm.ml.regression.RandomForestRegressionModel, RandomForestRegressionModel
            sizes = [len(features)]
        else:
            fitter, one, all_, known = RandomForestClassifier(**settings), jvm.ml.classification.DecisionTreeClassificationModel, jvm.ml.classification.RandomForestClassificationModel, RandomForestClassificationModel
            sizes = [len(features), task.classes]
        trees = spark.sparkContext._gateway.new_array(one, len(self.roots))
        for t, root in enumerate(self.roots):
            trees[t] = one(made(root), *sizes)
        model = all_(trees, *sizes)
        fitter._transfer_params_to_java()
        fitter._java_obj.copyValues(model, jvm.ml.param.ParamMap())
        return fitter._copyValues(known(model))

    def score(self, rows: DataFrame, label: str) -> DataFrame:
        """Label and prediction of rows with a slot or a number per attribute."""
        task, tables = self.task, []
        for root in self.roots:
            nodes = _nodes(root)
            if task.numeric:
                worth = np.array([task.prediction(x.stats) for x in nodes])
            else:
                worth = np.stack([x.stats / (x.stats.sum() or 1.0) for x in nodes])
            tables.append((*_routes(task, nodes), max(x.level for x in nodes), worth))
        asked = [a if i in task.inputs else None for i, a in enumerate(task.attributes)]
        places = [i for i, a in enumerate(asked) if a]
        rows = rows.select(*[a.code(F.col(f"`{a.name}`")) for a in asked if a], F.col(f"`{label}`").cast("double").alias("label"))

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = np.zeros((len(asked), batch.num_rows), np.int32)
                for i, place in enumerate(places):
                    codes[place] = batch.column(i).to_numpy(zero_copy_only=False)
                votes = np.zeros(batch.num_rows if task.numeric else (batch.num_rows, task.classes))
                for at, go, steps, worth in tables:
                    votes += worth.take(_arrived(at, go, steps, codes), axis=0)
                guess = votes / len(tables) if task.numeric else votes.argmax(axis=1).astype(float)
                yield pa.record_batch({"label": batch.column(len(places)), "prediction": pa.array(guess)})

        return rows.mapInArrow(predicted, "label double, prediction double")
