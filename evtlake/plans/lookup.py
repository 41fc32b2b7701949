"""Find the interval a position falls into, for disjoint intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from evtlake.plans import ordering

#: Blocks whose last starts are accumulated together.
RUN = 1024


def interval_lookup(
    points: DataFrame,
    at: str,
    intervals: DataFrame,
    start: str,
    end: str,
    block: float,
    keys: Sequence[str] = (),
    contiguous: bool = False,
    rows: int = 0,
) -> DataFrame:
    """Join every point to the one interval with ``start <= at < end``.

    Points and interval starts are merged in one order per block of ``block`` units, and
    the last start seen so far is the match; a block begins with the last start of the
    blocks before it. Each row is shuffled once, and an interval of any length costs one
    row, so a giant interval spreads over as many blocks as it covers.
    Points outside every interval are dropped; ``contiguous`` says that there are none, so
    that rounding in computed bounds cannot open gaps. Columns of both sides are returned.
    ``rows`` is the number of points where it is known, so that they get as many tasks as they need.
    """
    keys = list(keys)
    payload = [c for c in intervals.columns if c not in keys]
    carried = [c for c in points.columns if c not in keys]
    live = intervals.where(F.col(end) > F.col(start))
    starts = live.select(
        *keys, F.floor(F.col(start) / block).alias("_b"), F.col(start).alias("_at"), F.lit(0).alias("_k"),
        F.struct(*payload).alias("_iv"))
    probes = points.select(
        *keys, F.floor(F.col(at) / block).alias("_b"), F.col(at).alias("_at"), F.lit(1).alias("_k"),
        F.struct(*carried).alias("_pt"))
    last_of_block = starts.groupBy(*keys, "_b").agg(F.max_by("_iv", "_at").alias("_last"))
    # every block with probes needs the last start before it, also blocks without starts
    blocks = probes.select(*keys, "_b").distinct().join(last_of_block, [*keys, "_b"], "full_outer")
    # in two levels, so that no task orders all blocks of a key: runs of blocks, and blocks of a run
    blocks = blocks.withColumn("_run", F.floor(F.col("_b") / RUN))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy(*keys, "_run").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_b"))).alias("_iv"))
    ahead = runs.select(*keys, "_run", F.last("_iv", ignorenulls=True).over(earlier(keys, "_run")).alias("_ahead"))
    inside = F.last("_last", ignorenulls=True).over(earlier([*keys, "_run"], "_b"))
    carry = blocks.withColumn("_in", inside).join(ahead, [*keys, "_run"]).select(*keys, "_b", F.coalesce("_in", "_ahead").alias("_iv"))
    opening = carry.where(F.col("_iv").isNotNull()).select(
        *keys, "_b", F.lit(None).cast(points.schema[at].dataType).alias("_at"), F.lit(0).alias("_k"), "_iv")
    merged = ordering.spread(starts.unionByName(opening).unionByName(probes, allowMissingColumns=True), rows, *keys, "_b")
    seen = Window.partitionBy(*keys, "_b").orderBy(F.col("_at").asc_nulls_first(), "_k").rowsBetween(
        Window.unboundedPreceding, 0)
    matched = merged.withColumn("_iv", F.last("_iv", ignorenulls=True).over(seen))
    inside = F.col("_iv").isNotNull() if contiguous else F.col("_at") < F.col(f"_iv.{end}")
    return matched.where((F.col("_k") == 1) & inside).select(*keys, "_pt.*", "_iv.*")
