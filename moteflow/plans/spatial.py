"""Distance joins as equi-joins on grid cells.

Spark has no spatial join, so a radius join would otherwise be a nested loop. Both sides are put on a
grid of cells of the radius or twice that; one side is copied to the cells it reaches and the join is an ordinary
sort-merge join on (keys, cell) that adaptive execution can split when a cell is crowded. The copied side is
never broadcast: Spark estimates it by the rows before they are copied, and it would pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moteflow.session import cut

CELL = ["_cx", "_cy"]


def in_cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(x) / F.lit(size)), "_cy": F.floor(F.col(y) / F.lit(size))})


def in_reached_cells(df: DataFrame, x: str, y: str, size: float, radius: float) -> DataFrame:
    """A copy of each row for every cell that its square of +-``radius`` (a hair more, for rounding) touches."""
    r = F.lit(radius * (1 + 1e-9))
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / F.lit(size)), F.floor((F.col(c) + r) / F.lit(size))))
    return df.withColumn("_cx", cells(x)).withColumn("_cy", cells(y))


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def near_join(left: DataFrame, right: DataFrame, radius: float, on: list[str], lxy: tuple[str, str],
              rxy: tuple[str, str], extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of ``left`` and ``right`` equal on ``on`` and at most ``radius`` apart. ``right`` is the side
    that gets copied, so give the smaller one. Column names other than ``on`` must differ. ``extra`` is
    evaluated inside the join, before pairs are produced. Cells are twice the radius wide, so a row is copied to
    four of them on average."""
    a = in_cells(left, *lxy, 2.0 * radius)
    b = in_reached_cells(right, *rxy, 2.0 * radius, float(radius))
    b = b.select([F.col(c).alias("_r_" + c) if c in on + CELL else F.col(c) for c in b.columns])
    cond = (F.col(lxy[0]) - F.col(rxy[0])) * (F.col(lxy[0]) - F.col(rxy[0])) \
        + (F.col(lxy[1]) - F.col(rxy[1])) * (F.col(lxy[1]) - F.col(rxy[1])) <= F.lit(float(radius) ** 2)
    for c in on + CELL:
        cond = (F.col(c) == F.col("_r_" + c)) & cond
    if extra is not None:
        cond = cond & extra
    return a.join(b.hint("merge"), cond, how).drop(*CELL, *["_r_" + c for c in on + CELL])


def close_pairs(df: DataFrame, radius: float, on: list[str], x: str, y: str, id_: str) -> DataFrame:
    """Every unordered pair at most ``radius`` apart, once, as structs ``a`` and ``b`` with a.id < b.id.
    Only half of the neighbourhood is copied: a pair in two different cells meets in exactly one."""
    cols = [c for c in df.columns if c not in on]
    packed = in_cells(df, x, y, radius).select(*on, *CELL, F.struct(*cols).alias("a"))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                     for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    other = packed.withColumnRenamed("a", "b").withColumn("_o", F.explode(half)).select(
        *on, (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"), "b",
        ((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_same"))
    dx = F.col(f"a.{x}") - F.col(f"b.{x}")
    dy = F.col(f"a.{y}") - F.col(f"b.{y}")
    out = packed.join(other.hint("merge"), on + CELL).where(
        (dx * dx + dy * dy <= F.lit(float(radius) ** 2))
        & (~F.col("_same") | (F.col(f"a.{id_}") < F.col(f"b.{id_}"))))
    first = F.col(f"a.{id_}") < F.col(f"b.{id_}")
    return out.select(*on, F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"),
                      F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))


def nearest_k(left: DataFrame, right: DataFrame, k: int, on: list[str], lxy: tuple[str, str], rxy: tuple[str, str],
              left_id: str, distance: Column, radius: float, tie: str, extra: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``right`` for each row of ``left`` within the same ``on`` (fewer when the
    group has fewer). Radius joins with doubling radius: a row is finished once it has k partners no
    farther than the radius, or all partners its group offers; only unfinished rows go on. ``distance``
    may include further axes (it is at least the planar distance); ties go to the smaller ``tie``."""
    avail = right.groupBy(*on).agg(F.count("*").alias("_avail"))
    todo = cut(left.join(avail, on))
    done: list[DataFrame] = []
    r = float(radius)
    while not todo.isEmpty():
        pairs = near_join(todo, right, r, on, lxy, rxy, extra).withColumn("_d", distance)
        best = cut(pairs.groupBy(*on, left_id).agg(
            F.slice(F.array_sort(F.collect_list(F.struct(F.col("_d").alias("d"), F.col(tie).alias("t"),
                    F.struct(*[F.col(c) for c in right.columns if c not in on]).alias("row")))), 1, k).alias("best"),
            F.count_if(F.col("_d") <= r).alias("_in"), F.count("*").alias("_seen"), F.first("_avail").alias("_avail")))
        final = best.where((F.col("_in") >= k) | (F.col("_seen") >= F.col("_avail") - (1 if extra is not None else 0)))
        done.append(final.select(*on, left_id, F.posexplode("best").alias("rank", "b")))
        todo = cut(todo.join(final.select(*on, left_id), on + [left_id], "left_anti"))
        if extra is not None:  # a row whose only partner is itself has none
            todo = todo.where(F.col("_avail") > 1)
        r *= 2
    out = done[0] if done else None
    for d in done[1:]:
        out = out.unionByName(d)
    return None if out is None else out.select(*on, left_id, (F.col("rank") + 1).alias("rank"), F.col("b.d").alias("distance"), F.col("b.row").alias("row"))
