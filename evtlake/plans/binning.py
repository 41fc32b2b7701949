"""Equal-width bins with a closed last edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evtlake.functions.expr import finite


def span(df: DataFrame, value: str, limits: tuple[float, float] | None = None) -> Column:
    """Struct (lo, hi): the given limits, or the finite minimum and maximum from one pass.

    A constant column is widened by half a unit each way.
    """
    if limits is not None:
        return F.struct(F.lit(float(limits[0])).alias("lo"), F.lit(float(limits[1])).alias("hi"))
    known = F.when(finite(F.col(value)), F.col(value))
    low, high = F.min(known), F.max(known)
    flat = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    return df.agg(F.struct((low - flat).alias("lo"), (high + flat).alias("hi"))).scalar()


def edge(ends: Column, bins: int, i: Column) -> Column:
    """Edge ``i``; the last one is the upper end itself, free of rounding."""
    return F.when(i == bins, ends["hi"]).otherwise(
        ends["lo"] + i * ((ends["hi"] - ends["lo"]) / F.lit(float(bins))))


def with_bin(df: DataFrame, value: str, ends: str, bins: int, out: str) -> DataFrame:
    """Add the 0-based bin of a value, NULL outside the range; the maximum is in the last bin.

    ``ends`` is a column made by ``span``. A division guesses the bin and the edges
    decide, so values on an edge go where the edges say. The steps are columns of their
    own, because inlining them would repeat the value's expression many times. For the
    same reason rows without a bin are not filtered: a filter would be pushed below the
    steps with all of them inlined. They form a NULL group that ``attach`` leaves out.
    """
    v, e = F.col(value), F.col(ends)
    guess = F.when(finite(v), (v - e["lo"]) / ((e["hi"] - e["lo"]) / F.lit(float(bins))))
    df = df.withColumn("_g", F.floor(F.least(F.greatest(guess, F.lit(0.0)), F.lit(bins - 1.0))).cast("int"))
    g = F.col("_g")
    down = F.when(v < edge(e, bins, g), 1).otherwise(0)
    up = F.when((g < bins - 1) & (v >= edge(e, bins, g + 1)), 1).otherwise(0)
    inside = (v >= e["lo"]) & (v <= e["hi"])
    return df.withColumn(out, F.when(inside, g - down + up).cast("int")).drop("_g")


def grid(like: DataFrame, **sizes: int) -> DataFrame:
    """All index combinations of small axes: one row unfolded by sequences."""
    out = like.sparkSession.range(1).select()
    for name, size in sizes.items():
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name))
    return out


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool = True) -> DataFrame:
    """Null-safe join. A plain one would add not-null filters on computed bins.

    ``small`` asks for a broadcast; the caller knows a bound for ``right``.
    """
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"_r_{k}" for k in keys])


def fill_grid(counts: DataFrame, cells: DataFrame, axes: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Give every cell of the grid a row; absent cells count zero. At most one count per cell."""
    return attach(cells, counts, axes).na.fill(0, list(measures))
