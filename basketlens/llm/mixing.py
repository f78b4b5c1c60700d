"""Mixing to target weights by soft membership, in DataFrame expressions only.

1. A classifier from a labelled table: counts of hashed words per domain give every word a weight per
   domain; a text's weights are summed and tempered into posteriors over the domains.
2. Rates: nonnegative rates r of the documents, such that the expected tokens of each domain, the sum of
   r * tokens * posterior, match the targets.  Projected gradient on
   1/2 |totals - targets|^2 + ridge/2 * sum tokens (r - 1)^2 (in shares of all tokens), with spectral
   steps.  Each step is one aggregation over all documents; a rate depends on the steps so far and the
   row's own posteriors alone, so it is recomputed from them and nothing is kept per row.
3. Copies: the whole part of the rate, and one more with the chance of the rest, by a hash of the key.
   With ``keep_others`` the rates of documents that are not mostly of the domains to cut, and of ``spared``
   ones, stay at 1 or more, so each of them has a copy; the targets are then met as nearly as that allows.

Defined results: a null text is empty and has no tokens; texts without words have the prior shares as
posteriors; without labels there is one domain, ``all``, and every rate is 1; an empty table gives no
rows; a label without a document, or a null domain, counts for nothing; rows with equal texts have equal rates.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import SPACE, discard, saved, text_of

#: Buckets of the hashed words (the bound of the broadcast table) and labelled rows that fit the weights (at most).
BUCKETS, TRAIN_ROWS, DOMAINS = 1 << 14, 20_000, 32
#: Count that is added to those of every word, words after which a text's evidence stops adding up, and the pull of rates towards 1.
RARE, EVIDENCE, RIDGE = 5.0, 100.0, 1e-3
#: Change of the domain shares at which the rates stand still, and steps after which the fit is an error.
STILL, STEPS = 1e-6, 300
#: Steps that are evaluated from written rates.
WRITE_EVERY = 10


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class Domains:
    """Names with prior shares, and the table (bucket, w_0, w_1, ...) of log weights."""

    names: list[str]
    priors: list[float]
    weights: DataFrame | None


def fit_domains(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", train_rows: int = TRAIN_ROWS) -> Domains:
    """Weights from at most ``train_rows`` labelled rows, chosen by a hash of the key."""
    chosen = labels.filter(F.col(domain).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(domain).cast("string").alias("_domain"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_domain").limit(train_rows)
    chosen = saved(chosen, "mix-labels")
    counts = {r[0]: r[1] for r in chosen.groupBy("_domain").count().orderBy("_domain").limit(DOMAINS + 1).collect()}
    if len(counts) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    if not counts:
        return Domains(["all"], [1.0], None)
    names = list(counts)
    # The labelled sample is bounded by train_rows, so it may be broadcast.
    words = docs.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("_key")).select("_domain", F.explode(_words(text_of(text))).alias("w"))
    seen = words.groupBy(_bucket(F.col("w")).alias("bucket")).agg(*[F.count(F.when(F.col("_domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(names)])
    seen = saved(seen, "mix-words")
    totals = seen.agg(*[F.sum(f"n_{i}") for i in range(len(names))]).first()
    # Seen against expected counts, both raised so that rare words do not decide.
    everything = sum(F.col(f"n_{i}") for i in range(len(names)))
    whole = float(max(1, sum(t or 0 for t in totals)))
    weights = [F.log((F.col(f"n_{i}") + RARE) / (everything * (float(totals[i] or 0) / whole) + RARE)).alias(f"w_{i}") for i in range(len(names))]
    n = sum(counts.values())
    return Domains(names, [c / n for c in counts.values()], saved(seen.select("bucket", *weights), "mix-weights"))


def memberships(docs: DataFrame, domains: Domains, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: ``_key``, carried columns (``c_`` before the name), ``tokens`` (words) and posteriors ``p_0``, ``p_1``, ..."""
    k = len(domains.names)
    kept = ["_key", *[f"c_{c}" for c in carry]]
    rows = docs.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], text_of(text).alias("_text"))
    if domains.weights is None:
        return rows.select(*[f"`{c}`" for c in kept], F.size(_words(F.col("_text"))).cast("long").alias("tokens"), F.lit(1.0).alias("p_0"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    # One row a word; the weights (BUCKETS rows) are broadcast, sums are formed before the shuffle.
    kept = ["_at", *[f"`{c}`" for c in kept]]
    words = rows.select(*kept, F.explode_outer(_words(F.col("_text"))).alias("w")).withColumn("bucket", _bucket(F.col("w")))
    scored = words.join(F.broadcast(domains.weights), "bucket", "left")
    sums = scored.groupBy(*kept).agg(F.count("w").alias("tokens"), *[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(k)])
    kept = kept[1:]
    temper = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("tokens"), F.lit(1)))
    logits = [F.lit(math.log(p)) + F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) * temper for i, p in enumerate(domains.priors)]
    top = F.greatest(*logits) if k > 1 else logits[0]
    shifted = sums.select(*kept, "tokens", *[F.exp(x - top).alias(f"e_{i}") for i, x in enumerate(logits)])
    whole = sum(F.col(f"e_{i}") for i in range(k))
    return shifted.select(*kept, "tokens", *[F.round(F.col(f"e_{i}") / whole, 9).alias(f"p_{i}") for i in range(k)])


def _rate(steps: list[tuple[float, list[float]]], ridge: float, low: str = "0.0D", start: str = "named_struct('r', 1.0D, 'q', 1.0D)") -> Column:
    """(r now, r before) of a row after the steps (length, gradient of the domains); ``low`` is the least rate of the row."""
    if not steps:
        return F.expr(start)
    k = len(steps[0][1])
    listed = ", ".join(f"array({', '.join(f'{x!r}D' for x in (a, *c))})" for a, c in steps)
    slope = " + ".join(f"p_{i} * c[{i + 1}]" for i in range(k))
    return F.expr(f"aggregate(array({listed}), {start}, (z, c) -> named_struct('r', greatest({low}, z.r - c[0] * ({slope} + {ridge!r}D * (z.r - 1.0D))), 'q', z.r))")


def fit_rates(members: DataFrame, targets: list[float], ridge: float = RIDGE, low: str = "0.0D") -> tuple[list[tuple[float, list[float]]], list[float]]:
    """Steps of the projected gradient until the domain shares stand still, and the shares reached.

    Every ``WRITE_EVERY`` steps the rates are written and the next ones go on from there, so that the
    work grows with the number of steps and not with its square.
    """
    k = len(targets)
    whole = members.agg(F.sum("tokens")).first()[0] or 0
    steps: list[tuple[float, list[float]]] = []
    if not whole:
        return steps, [0.0] * k
    before: list[float] | None = None
    at = members.withColumns({"_r": F.lit(1.0), "_q": F.lit(1.0)})
    written: DataFrame | None = None
    since: list[tuple[float, list[float]]] = []
    for _ in range(STEPS):
        z = _rate(since, ridge, low, "named_struct('r', _r, 'q', _q)")
        if len(since) == WRITE_EVERY:
            at = saved(at.withColumn("_z", z).select(*members.columns, F.col("_z.r").alias("_r"), F.col("_z.q").alias("_q")), "mix-rates")
            if written is not None:
                discard(written)
            written, since, z = at, [], _rate([], ridge, low, "named_struct('r', _r, 'q', _q)")
        moved = at.select("tokens", *[f"p_{i}" for i in range(k)], z.alias("z"))
        weight = F.col("tokens") / float(whole)
        got = moved.agg(*[F.sum(weight * F.col("z.r") * F.col(f"p_{i}")) for i in range(k)], F.sum(weight * F.pow(F.col("z.r") - F.col("z.q"), 2))).first()
        shares, change = [float(x) for x in got[:k]], float(got[k])
        if before is not None and (change < STILL**2 or max(abs(a - b) for a, b in zip(shares, before, strict=True)) < STILL):
            if written is not None:
                discard(written)
            return steps, shares
        length = 1.0 / (1.0 + ridge)
        if before is not None:
            length = change / (sum((a - b) ** 2 for a, b in zip(shares, before, strict=True)) + ridge * change)
        steps.append((length, [s - t for s, t in zip(shares, targets, strict=True)]))
        since.append(steps[-1])
        before = shares
    raise RuntimeError(f"the rates did not stand still within {STEPS} steps")


def mix(
    docs: DataFrame,
    domains: Domains,
    shares: dict[str, float] | None = None,
    less: dict[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    seed: int = 0,
    keep_others: bool = False,
    spared: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs``: key, carried columns, ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies``.

    Targets are shares of all tokens by domain; or ``less`` multiplies the present share of some domains,
    and the others take what is set free in proportion.  With ``keep_others`` only rows that are mostly
    (by more than half) of the domains in ``less`` may have a rate below 1, and none whose key is in the first column of ``spared``.
    """
    members = memberships(docs, domains, key, text, carry)
    if spared is not None:
        members = members.join(spared.select(F.col(spared.columns[0]).alias("_spared")).distinct(), F.col("_key") == F.col("_spared"), "left")
    members = saved(members, "memberships")
    k = len(domains.names)
    now = members.agg(*[F.sum(F.col("tokens") * F.col(f"p_{i}")) for i in range(k)], F.sum("tokens")).first()
    whole = float(now[k] or 0)
    present = [float(x or 0) / whole if whole else 0.0 for x in now[:k]]
    if shares is not None:
        targets = [shares.get(d, 0.0) for d in domains.names]
    else:
        cut = [p * (less or {}).get(d, 1.0) for d, p in zip(domains.names, present, strict=True)]
        free, rest = sum(present) - sum(cut), sum(p for d, p in zip(domains.names, present, strict=True) if d not in (less or {}))
        targets = [c if d in (less or {}) or not rest else c + free * c / rest for d, c in zip(domains.names, cut, strict=True)]
    low = "0.0D"
    if keep_others:
        cut_share = " + ".join(["0.0D", *[f"p_{i}" for i, d in enumerate(domains.names) if d in (less or {})]])
        low = f"if({cut_share} > 0.5D{'' if spared is None else ' and _spared is null'}, 0.0D, 1.0D)"
    steps, _ = fit_rates(members, targets, low=low)
    rate = F.round(_rate(steps, RIDGE, low)["r"], 6)
    chance = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return members.select(
        F.col("_key").alias(key),
        *[F.col(f"`c_{c}`").alias(c) for c in carry],
        F.col("tokens").alias("n_tokens"),
        *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains.names)],
        rate.alias("rate"),
        (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long").alias("copies"),
    )
