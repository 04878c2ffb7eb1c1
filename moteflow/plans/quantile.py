"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moteflow.session import cut

FEW = 2_000_000
BINS = 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    bound: int = FEW) -> DataFrame:
    """One row per group with linearly interpolated percentiles ``{name: p}`` of the non-null values.

    For groups without a bound (a movie, an axis, all rows). Each pass counts values per bin of a target's
    bracket (combined before the shuffle) and keeps the bin that holds the wanted rank, until the bracket is
    a single value or holds at most ``bound`` values, which are sorted. A null key is a group of its own.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_k"), F.col(value).cast("double").alias("_v"))
    out = _narrow(rows, ["_k"], probs, bound)
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *probs)


def _narrow(rows: DataFrame, keys: list[str], probs: dict[str, float], bound: int) -> DataFrame:
    span = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    pos = (F.col("_n") - 1) * F.col("_t.p")
    plan = span.withColumn("_t", F.explode(wanted)).select(
        *keys, F.col("_t.name").alias("_name"), (pos - F.floor(pos)).alias("_frac"), "_n", "_lo", "_hi",
        F.explode(F.array(F.floor(pos), F.least(F.floor(pos) + 1, F.col("_n") - 1))).alias("_rank"))
    # one target per (group, percentile, neighbouring rank): the value with _rank values below it
    target = cut(plan.groupBy(*keys, "_name", "_frac", "_rank").agg(
        F.first("_n").alias("_in"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.lit(0).cast("long").alias("_below")))
    ids = keys + ["_name", "_frac", "_rank"]
    while not target.where((F.col("_lo") < F.col("_hi")) & (F.col("_in") > bound)).isEmpty():
        live = target.where((F.col("_lo") < F.col("_hi")) & (F.col("_in") > bound))
        rest = target.where(~((F.col("_lo") < F.col("_hi")) & (F.col("_in") > bound)))
        hit = rows.join(live, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bin_ = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1))
        counts = hit.withColumn("_bin", bin_).groupBy(*ids, "_below", "_bin").agg(
            F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        # at most BINS rows per target from here on
        hist = counts.groupBy(*ids, "_below").agg(
            F.array_sort(F.collect_list(F.struct("_bin", "c", "lo", "hi"))).alias("h"))
        start = F.struct(F.col("_below").alias("below"), F.lit(0).cast("long").alias("n"),
                         F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(False).alias("found"))
        pick = F.aggregate("h", start, lambda s, x: F.when(s["found"], s).when(
            s["below"] + x["c"] > F.col("_rank"),
            F.struct(s["below"].alias("below"), x["c"].alias("n"), x["lo"].alias("lo"), x["hi"].alias("hi"),
                     F.lit(True).alias("found"))).otherwise(
            F.struct((s["below"] + x["c"]).alias("below"), s["n"].alias("n"), s["lo"].alias("lo"),
                     s["hi"].alias("hi"), s["found"].alias("found"))))
        step = hist.withColumn("s", pick).select(
            *ids, F.col("s.n").alias("_in"), F.col("s.lo").alias("_lo"), F.col("s.hi").alias("_hi"),
            F.col("s.below").alias("_below"))
        target = cut(rest.unionByName(step))
    single = target.where("_lo = _hi").select(*ids, F.col("_lo").alias("val"))
    few = target.where("_lo < _hi")
    sorted_ = rows.join(few, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))) \
        .groupBy(*ids, "_below").agg(F.array_sort(F.collect_list("_v")).alias("v")) \
        .select(*ids, F.element_at("v", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("val"))
    vals = single.unionByName(sorted_)
    both = vals.groupBy(*keys, "_name", "_frac").agg(F.min("val").alias("a"), F.max("val").alias("b")) \
        .withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("_frac"))
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("q"))).alias(n) for n in probs])


def group_robust_sd(df: DataFrame, keys: list[str], value: str, out: str = "sd", bound: int = FEW) -> DataFrame:
    """1.4826 x median absolute deviation per group, with its centre ``<out>_centre``."""
    centre = exact_quantiles(df, keys, value, {out + "_centre": 0.5}, bound)
    if keys:
        rows = df.join(centre, keys)
        dev = exact_quantiles(rows.withColumn("_d", F.abs(F.col(value) - F.col(out + "_centre"))), keys, "_d",
                              {out: 0.5}, bound)
        return centre.join(dev.withColumn(out, F.col(out) * F.lit(1.4826)), keys)
    mid = centre.first()[0]  # one number
    dev = exact_quantiles(df.withColumn("_d", F.abs(F.col(value) - F.lit(mid).cast("double"))), [], "_d", {out: 0.5}, bound)
    return dev.select(F.lit(mid).cast("double").alias(out + "_centre"), (F.col(out) * F.lit(1.4826)).alias(out))
