"""Customer segments: distributed k-means and nearest-centre scoring."""

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.operators.encode import fit_standardizer
from basketlens.operators.profile import complete_cases, missing
from basketlens.schema import CLUSTER, CUSTOMER_ID, ROW_KEY, SEGMENT, numeric_columns
from basketlens.sources.files import materialised


#: Centres that get a distance column each; beyond that they stand in an array.
MOST_COLUMNS = 32
#: What rounding may take from a bound on distances.
SLACK = 1e-9
#: Rows that are handed over, and measured against all centres, as one array.
PACK = 2_000


@dataclass
class Segments:
    """Centres in standardised space, how to standardise, and the steps each fit took to come to rest."""

    columns: list[str]
    shift: list[float]
    scale: list[float]
    centres: list[list[float]]
    cost: float | None = None
    steps: list[int] = field(default_factory=list)

    def z(self, i: int) -> Column:
        """Standardised input, 0 where it is missing (such rows get no segment)."""
        c = F.col(f"`{self.columns[i]}`").cast("double")
        scaled = (c - F.lit(float(self.shift[i]))) / F.lit(float(self.scale[i] or 1.0))
        return F.coalesce(scaled, F.lit(0.0)) if self.scale[i] else F.lit(0.0)

    def assign(self, df: DataFrame, keep_distance: bool = False) -> DataFrame:
        """Add ``cluster`` 1..k and ``segment``; null where any input is null or NaN.

        The k squared distances are plain arithmetic in the scan's own stage, so complete
        and incomplete rows stay in one pass.  Ties go to the lowest id.  The steps are
        projections of their own and free of nulls, which keeps the generated code short
        enough to be compiled; "segment is known" reduces to null checks on the inputs.
        """
        k = len(self.centres)
        z = [f"_z{i}" for i in range(len(self.columns))]
        d = [f"_d{j}" for j in range(1, k + 1)]
        out = df.withColumns({name: self.z(i) for i, name in enumerate(z)})
        if k > MOST_COLUMNS:
            return self._assign_pruned(out, z, keep_distance)
        out = out.withColumns(
            {
                name: reduce(
                    lambda a, b: a + b,
                    [(F.col(v) - F.lit(float(x))) * (F.col(v) - F.lit(float(x))) for v, x in zip(z, centre)],
                )
                for name, centre in zip(d, self.centres)
            }
        )
        out = out.withColumn("_least", F.least(*d) if k > 1 else F.col(d[0]))
        best = F.lit(k)
        for j in range(k - 1, 0, -1):
            best = F.when(F.col(d[j - 1]) <= F.col("_least"), F.lit(j)).otherwise(best)
        known = reduce(lambda a, b: a & b, [~missing(df, c) for c in self.columns])
        out = out.withColumn("_best", best)
        added = {
            CLUSTER: F.when(known, F.col("_best")),
            SEGMENT: F.when(known, F.concat(F.lit("Segment "), F.col("_best").cast("string"))),
        }
        if keep_distance:
            added["distance"] = F.when(known, F.col("_least"))
        return out.withColumns(added).drop("_best", "_least", *z, *d)


    def _assign_pruned(self, out: DataFrame, z: list[str], keep_distance: bool) -> DataFrame:
        """``assign`` for many centres: they stand in groups around pivots, and a row looks into few of them.

        By the triangle inequality the nearest centre is no farther than the farthest one of any
        group, so a group whose nearest possible centre is beyond that is left out.  The number of
        expressions does not grow with the centres.
        """
        point = F.array(*z)
        near = F.transform(
            F.expr(self._groups()),
            lambda g: F.struct(_distance(point, g["pivot"]).alias("far"), g["radius"].alias("radius"), g["members"].alias("members")),
        )
        out = out.withColumn("_near", near).withColumn(
            "_reach", F.array_min(F.transform("_near", lambda g: g["far"] + g["radius"])) * (1 + SLACK) + SLACK
        )
        kept = F.filter("_near", lambda g: g["far"] - g["radius"] <= F.col("_reach"))
        measured = F.transform(
            F.flatten(F.transform(kept, lambda g: g["members"])),
            lambda m: F.struct(_squared(point, m["centre"]).alias("least"), m["id"].alias("id")),
        )
        known = reduce(lambda a, b: a & b, [~missing(out, c) for c in self.columns])
        out = out.withColumn("_best", F.array_min(measured))
        added = {
            CLUSTER: F.when(known, F.col("_best.id")),
            SEGMENT: F.when(known, F.concat(F.lit("Segment "), F.col("_best.id").cast("string"))),
        }
        if keep_distance:
            added["distance"] = F.when(known, F.col("_best.least"))
        return out.withColumns(added).drop("_best", "_near", "_reach", *z)

    def _groups(self) -> str:
        """SQL of the groups: every centre with the nearest of about sqrt(k) pivots, which lie far apart."""
        centres = np.array(self.centres, float)
        pivots, far = [0], np.linalg.norm(centres - centres[0], axis=1)
        while len(pivots) < round(len(centres) ** 0.5):
            pivots.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(centres - centres[pivots[-1]], axis=1))
        gaps = np.linalg.norm(centres[:, None] - centres[pivots][None], axis=2)
        home = gaps.argmin(axis=1)

        def listed(row: np.ndarray) -> str:
            return f"array({', '.join(f'{x!r}D' for x in row.tolist())})"

        groups = []
        for g, pivot in enumerate(pivots):
            inside = np.flatnonzero(home == g)
            if len(inside):
                members = ", ".join(f"named_struct('centre', {listed(centres[j])}, 'id', {j + 1})" for j in inside.tolist())
                radius = float(gaps[inside, g].max())
                groups.append(f"named_struct('pivot', {listed(centres[pivot])}, 'radius', {radius!r}D, 'members', array({members}))")
        return f"array({', '.join(groups)})"


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(_squared(a, b))


def segment_names(k: int) -> list[str]:
    return [f"Segment {i}" for i in range(1, k + 1)]


def cost_by_segment(df: DataFrame, segments: Segments) -> DataFrame:
    """Per segment: size, mean of each input, and the within-segment sum of squares."""
    scored = segments.assign(df, keep_distance=True).where(F.col(SEGMENT).isNotNull())
    return scored.groupBy(SEGMENT).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in segments.columns],
        F.sum("distance").alias("cost"),
    )


def fit_segments(
    df: DataFrame,
    k: int = 4,
    restarts: int = 25,
    seed: int = 42,
    columns: list[str] | None = None,
    include_id: bool = False,
    tolerance: float = 1e-4,
    max_iter: int = 10_000,
) -> Segments:
    """k-means on all standardised numeric columns of the complete rows; the least cost of all restarts wins.

    All restarts go together: a step is one scan and one aggregation for all sets of centres (a
    task sends k rows for each), and a restart leaves when no centre of it moves by
    more than ``tolerance``.  One that has not come to rest after ``max_iter`` steps is an error, never a
    result.  Every restart begins at k different rows, chosen by digests of the rows, so
    neither partitioning nor order matters.  Centres are sorted, so that segment numbers do not
    depend on the order they were found in.
    """
    if columns is None:
        skip = (ROW_KEY,) if include_id else (ROW_KEY, CUSTOMER_ID)
        columns = numeric_columns(df, exclude=skip)
    kept = materialised(complete_cases(df.select(*[f"`{c}`" for c in columns]), columns), "complete")
    standard = fit_standardizer(kept, columns)
    scaled = kept.select(*[standard.scaled(c).cast("double").alias(f"z{i}") for i, c in enumerate(columns)])
    pool = _starting_rows(scaled, restarts * k, seed)
    starts = [random.Random(seed + r).sample(pool, min(k, len(pool))) for r in range(restarts)]
    # One spillable copy for all steps.
    points = _packed(scaled).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres, steps = _at_rest(points, np.array(starts, float), tolerance, max_iter)
        costs = _step(points, centres)[2]
    finally:
        points.unpersist()
    best = int(np.argmin(costs))
    return Segments(
        columns,
        [standard.means[c] for c in columns],
        [standard.deviations[c] for c in columns],
        sorted(centres[best].tolist()),
        float(costs[best]),
        steps,
    )


def _starting_rows(scaled: DataFrame, wanted: int, seed: int) -> list[tuple[float, ...]]:
    """Up to ``wanted`` different rows, those with the smallest digests."""
    digest = F.xxhash64(F.lit(seed), *scaled.columns)
    found = dict.fromkeys(map(tuple, scaled.orderBy(digest, *scaled.columns).limit(4 * wanted).collect()))
    if len(found) < wanted:  # many equal rows came first
        found = dict.fromkeys(map(tuple, scaled.distinct().orderBy(digest, *scaled.columns).limit(wanted).collect()))
    if not found:
        raise ValueError("no complete row to find segments in")
    return list(found)[:wanted]


def _packed(scaled: DataFrame) -> RDD:
    """Many rows as one string of bytes, ``PACK`` rows at most in each, so that a step hands them to numpy as they are."""
    width = len(scaled.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            for start in range(0, len(z), PACK):
                yield pa.record_batch({"points": pa.array([z[start : start + PACK].tobytes()], pa.binary())})

    return scaled.mapInArrow(pack, "points binary").rdd.map(lambda row: bytes(row.points))


def _at_rest(points: DataFrame | RDD, centres: np.ndarray, tolerance: float, max_iter: int) -> tuple[np.ndarray, list[int]]:
    """Centres (restart, centre, column) once none moves any more, and the steps each restart took."""
    steps, moving = [0] * len(centres), list(range(len(centres)))
    while moving:
        sums, counts, _ = _step(points, centres[moving])
        # A centre without rows stays where it is.
        means = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres[moving])
        moved = np.sqrt(((means - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
        centres[moving] = means
        for r in moving:
            steps[r] += 1
        moving = [r for r, far in zip(moving, moved) if far > tolerance]
        if moving and steps[moving[0]] >= max_iter:
            raise RuntimeError(f"{len(moving)} restarts of k-means have not come to rest after {max_iter} steps")
    return centres, steps


def _step(points: DataFrame | RDD, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to each centre, and the cost, for all sets of centres in one scan.

    ``points`` are rows, or packed rows where several steps need them.  A row is nearest to the first
    centre of a set at the least distance.
    """
    if isinstance(points, DataFrame):
        points = _packed(points)
    sets, k, width = centres.shape
    squares = (centres**2).sum(axis=2)
    # Distances less the row's own square, as one product with (row, 1).
    forms = np.concatenate([-2 * centres, squares[:, :, None]], axis=2).reshape(sets * k, width + 1)

    def nearest(packs: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found, cost = np.zeros((sets * k, width + 1)), np.zeros(sets)
        for pack in packs:
            z = np.frombuffer(pack).reshape(-1, width)
            ones = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            far = (forms @ ones.T).reshape(sets, k, len(z))
            least = far.min(axis=1)
            mine = far <= least[:, None]
            if np.count_nonzero(mine) != sets * len(z):  # ties
                mine &= mine.cumsum(axis=1) == 1
            cost += np.maximum(least + (z**2).sum(axis=1), 0).sum(axis=1)
            found += mine.reshape(sets * k, len(z)).astype(float) @ ones
        yield found, cost

    # k rows a restart from each task, added up in two stages.
    total, cost = points.mapPartitions(nearest).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    total = total.reshape(sets, k, width + 1)
    return total[..., :width], total[..., width], cost


def run_parallel(spark: SparkSession, jobs: list[Callable], threads: int) -> list:
    """Submit Spark jobs from a few driver threads, so that small stages overlap."""
    if threads <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return [r.get() for r in [pool.apply_async(inheritable_thread_target(spark)(j)) for j in jobs]]
