"""Group-wise helpers that never gather one whole group in a single task.

One scene may hold a third of all points, so scene-level statistics are partial
aggregates joined back, ranks are cut bucket by bucket, and percentiles sort only
the bucket that holds the wanted rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import col
from .lineage import cut, with_small

# Size on disk up to which a per-group table is sent to every executor.
BROADCAST_BYTES = 8 << 20


def attach(df: DataFrame, small: DataFrame, keys, how: str = "left", max_bytes: int | None = None) -> DataFrame:
    """Join a per-group table to many rows without gathering a group in one task.

    The table is computed once and kept; its bytes decide.  Up to ``max_bytes`` it is
    broadcast; beyond that it is a plain join, in which adaptive execution splits the partitions of hot keys.  Fine-grained
    keys, which have no hot key, are copied nowhere.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return with_small(df, small, keys, how, BROADCAST_BYTES if max_bytes is None else max_bytes)


def with_stats(df: DataFrame, by, *aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row (aggregate, then join on the key)."""
    keys = [by] if isinstance(by, str) else list(by)
    return attach(df, df.groupBy(*keys).agg(*aggregates), keys)


#: Distinct values of a bucket that one task sorts.
BUCKET = 1 << 16


def exact_percentiles(
    df: DataFrame, by, value, wanted: dict[str, float], buckets: int = 32, bound: int = BUCKET
) -> DataFrame:
    """Exact linearly interpolated percentiles per group.

    Groups of up to ``bound`` values are sorted, each in one task.  In larger ones a quantile sketch proposes bucket bounds and exact counts per bucket locate the bucket of each rank; buckets that are
    needed and hold more than ``bound`` distinct values are cut again in the same way, so no task sorts more than that, whatever
    the group.  The sketch only balances the work; the result does not depend on its accuracy.  Repeated
    values are collapsed to counts first.
    """
    keys = [by] if isinstance(by, str) else list(by)
    data = df.select(*keys, col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        keys = ["_all"]
        data = data.withColumn("_all", F.lit(0))
    data = cut(data)
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    ranks = _ranks(wanted)
    group = Window.partitionBy(*keys)
    if most <= bound:
        ordered = data.withColumn("_start", F.row_number().over(group.orderBy("_v")) - 1).withColumn("_total", F.count(F.lit(1)).over(group))
        return _interpolated(ordered.withColumn("_end", F.col("_start") + 1), keys, wanted, ranks)
    small = None
    if not sizes.where(F.col("_n") <= bound).isEmpty():
        large = cut(sizes.where(F.col("_n") > bound).select(*keys))
        small = exact_percentiles(attach(data, large, keys, "left_anti"), keys, "_v", wanted, buckets, bound)
        data = attach(data, large, keys, "left_semi")
    counts = cut(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    lows, highs = ranks

    def needed() -> Column:
        found = F.lit(False)
        for rank in [*lows.values(), *highs.values()]:
            found = found | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_size")))
        return found

    # ``_path`` names a bucket, ``_off`` counts the values before it.
    part = attach(counts, totals, keys).withColumns({"_path": F.lit(0).cast("long"), "_off": F.lit(0).cast("long")})
    at = [*keys, "_path"]
    settled = None
    grid = [i / buckets for i in range(1, buckets)]
    while True:
        part = cut(part)
        size = part.groupBy(*at).agg(F.count(F.lit(1)).alias("_distinct"))
        large = cut(size.where(F.col("_distinct") > bound))
        if large.isEmpty():
            settled = part if settled is None else settled.unionByName(part)
            break
        rest = attach(part, large, at).where(F.col("_distinct").isNull()).drop("_distinct")
        settled = rest if settled is None else settled.unionByName(rest)
        crowded = attach(part, large.drop("_distinct"), at, "left_semi")
        bounds = crowded.groupBy(*at).agg(F.percentile_approx("_v", grid, 1000).alias("_bounds"))
        placed = cut(attach(crowded, bounds, at).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds"))
        earlier = Window.partitionBy(*at).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = placed.groupBy(*at, "_bucket").agg(F.sum("_c").alias("_size"), F.first("_off").alias("_first"), F.first("_total").alias("_total"))
        sizes = sizes.withColumn("_before", F.col("_first") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        targets = sizes.where(needed()).select(*at, "_bucket", "_before")
        part = attach(placed, targets, [*at, "_bucket"], "inner").withColumns(
            {"_path": F.col("_path") * buckets + F.col("_bucket") + 1, "_off": F.col("_before")}).drop("_bucket", "_before")
    running = Window.partitionBy(*at).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = settled.withColumn("_end", F.col("_off") + F.sum("_c").over(running)).withColumn("_start", F.col("_end") - F.col("_c"))

    found = _interpolated(ranked, keys, wanted, ranks)
    return found if small is None else found.unionByName(small)


def _ranks(wanted: dict[str, float]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Ranks (from 0) of the values below and above each percentile of a group of ``_total`` values."""
    at = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in wanted.items()}
    return {name: F.floor(c) for name, c in at.items()}, {name: F.ceil(c) for name, c in at.items()}


def _interpolated(ranked: DataFrame, keys: list[str], wanted: dict[str, float], ranks) -> DataFrame:
    """Percentiles from values ``_v`` that hold the ranks from ``_start`` to before ``_end`` of ``_total``."""
    lows, highs = ranks

    def pick(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    aggs = [F.first("_total").alias("_total")]
    for name in wanted:
        aggs += [pick(lows[name]).alias(f"_lo_{name}"), pick(highs[name]).alias(f"_hi_{name}")]
    picked = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in wanted.items():
        exact = F.lit(float(p)) * (F.col("_total") - 1)
        share = exact - F.floor(exact)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * share).alias(name))
    return picked.select(*[k for k in keys if k != "_all"], *out)


def first_n(df: DataFrame, by, uniform, tie, n: Column, buckets: int = 1024, bound: int = BUCKET) -> DataFrame:
    """The ``n`` rows of each group that come first in order (uniform, tie).

    ``uniform`` lies in [0, 1); ``n`` is an expression over the column ``_group``
    (the group size).  Groups within their quota are kept as they are, those of up to ``bound`` rows are ranked.  Rows of larger ones are counted per slice of the uniform; slices wholly
    inside the quota are kept, and only the one slice on the border is ranked.
    """
    keys = [by] if isinstance(by, str) else list(by)
    columns = df.columns
    sizes = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_group")).withColumn("_quota", n))
    fits, small = F.col("_group") <= F.col("_quota"), F.col("_group") <= bound
    kinds = [fits, ~fits & small, ~fits & ~small]
    some = sizes.agg(*[F.coalesce(F.bool_or(k), F.lit(False)) for k in kinds]).first()
    ties = [col(t) for t in ([tie] if isinstance(tie, str) else tie)]
    at = Window.partitionBy(*keys).orderBy(col(uniform), *ties)
    ways = [
        lambda rows: rows, lambda rows: rows.withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") <= F.col("_quota")),
        lambda rows: _first_by_slices(rows, keys, col(uniform), ties, buckets),
    ]
    parts = [way(attach(df, sizes.where(k), keys, "inner")).select(*columns) for k, way, there in zip(kinds, ways, some) if there]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def _first_by_slices(df: DataFrame, keys: list[str], uniform: Column, ties: list[Column], buckets: int) -> DataFrame:
    """The first ``_quota`` rows of each group."""
    columns = df.columns
    sliced = df.withColumn("_slice", F.floor(uniform * buckets).cast("int"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    slices = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"), F.first("_quota").alias("_most"))
        .withColumn("_before", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .where(F.col("_before") < F.col("_most"))
        .select(*keys, "_slice", "_before", "_size")
    )
    candidates = sliced.join(slices, [*keys, "_slice"])
    inside = F.col("_before") + F.col("_size") <= F.col("_quota")
    border = Window.partitionBy(*keys, "_slice").orderBy(uniform, *ties)
    ranked = (
        candidates.where(~inside)
        .withColumn("_rank", F.row_number().over(border))
        .where(F.col("_before") + F.col("_rank") <= F.col("_quota"))
    )
    return candidates.where(inside).select(*columns).unionByName(ranked.select(*columns))


def running_index(df: DataFrame, by, order, width: int, name: str = "idx") -> DataFrame:
    """0-based position of each row in its group, ordered by the integer key ``order``.

    Rows are ranked inside key ranges of ``width`` and shifted by the count of the
    ranges before, so no task sees more than one range.
    """
    keys = [by] if isinstance(by, str) else list(by)
    ranged = df.withColumn("_range", F.floor(col(order) / width).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_range"])
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_range", "_pos", "_start")
    )
