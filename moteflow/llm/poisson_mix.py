"""Mixing sources to target weights by Poisson replication.

A source with a target weight gets the mean rate weight * total / size, where sizes count characters and weights are shares of
those that have text; sources without a target of their own share the weight of the rest. A document's number of copies
inverts the Poisson distribution of its source's rate at a number from [0, 1) that is hashed from the seed and its id. So
it depends on nothing else, and any task that is run again gives the same copies. Copies are exploded and sorted by a
hash of seed, id and copy over the whole cluster.

Only DataFrame functions are used. The driver holds a row for each named target and the rest, never one for each source.
The cumulated distributions are literal arrays of at most a few hundred numbers, whatever the rate. A weight that
would take more than ``MOST`` mean repetitions is refused with an error.

Null and empty texts count no characters; a null source belongs to the rest; a null id hashes as ``null``. Rows that
share an id get the same number of copies each. If no text has a character, every rate is the number of epochs. Columns
named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Share of the output for single sources, the rest, passes over the corpus, and the seed.
TARGETS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
REST = 0.60
EPOCHS = 1.0
SEED = "mix-1"
#: Largest rate that is inverted as a whole, and the mean repetition above which a target weight counts as unreachable.
PIECE = 64.0
MOST = 1_000_000


def cumulated(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the tail is far below the hash's resolution."""
    if rate <= 0:
        return [1.0]
    upto = int(rate + 12 * math.sqrt(rate) + 40)
    out, total = [], 0.0
    for k in range(upto):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out.append(min(total, 1.0))
    return out


def rates(docs: DataFrame, targets: dict[str, float] = TARGETS, rest: float = REST, epochs: float = EPOCHS) -> dict[str | None, float]:
    """Mean copies of a document by source; None: all others. One row for each named source comes to the driver."""
    group = F.when(F.col("source").isin(*targets), F.col("source")) if targets else F.lit(None).cast("string")
    size = {r[0]: r[1] or 0 for r in docs.groupBy(group.alias("g")).agg(F.sum(F.length("text")).alias("n")).collect()}
    share = {g: w for g, w in [*targets.items(), (None, rest)] if size.get(g)}
    total, weight = sum(size.values()), sum(share.values())
    if not total or not weight:
        return {g: epochs for g in [*targets, None]}
    return {g: epochs * share[g] / weight * total / size[g] if g in share else epochs for g in [*targets, None]}


def _uniform(key: Column) -> Column:
    """52 bits of an MD5 as a number from [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(rate: dict[str | None, float], seed: str = SEED) -> Column:
    """Number of copies of a row with ``doc_id`` and ``source``. A rate above ``PIECE`` is a sum of equal Poisson parts of at most that, each inverted at a hash of its own, so no
    list is longer than one of ``PIECE``."""
    high = max(rate.values())
    if high > MOST:
        raise ValueError(f"a document would have to be repeated {high:.0f} times on average, over {MOST}: its source has too little text for its weight")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))

    def drawn(r: float) -> Column:
        parts = max(1, math.ceil(r / PIECE))
        table = F.array(*[F.lit(x) for x in cumulated(r / parts)])
        first = _uniform(name.cast("binary"))
        if parts == 1:
            return F.size(F.filter(table, lambda c: c <= first))
        more = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda j: _uniform(F.concat(name, F.lit("#"), j.cast("string")).cast("binary")))
        return F.aggregate(more, F.lit(0), lambda n, u: n + F.size(F.filter(table, lambda c: c <= u)))

    out = drawn(rate[None])
    for g, r in rate.items():
        if g is not None:
            out = F.when(F.col("source") == g, drawn(r)).otherwise(out)
    return out


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, rest: float = REST, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` repeated to the target weights in random order, with ``copy`` (from 1) and ``shuffle_key``."""
    docs = docs.drop("copy", "shuffle_key")
    n = copies(rates(docs, targets, rest, epochs), seed)
    out = docs.withColumn("copy", n).where("copy > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy"))))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("copy").cast("string"))
    return out.withColumn("shuffle_key", F.md5(key.cast("binary"))).orderBy("shuffle_key")
