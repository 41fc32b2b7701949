"""Exact quantiles by radix selection.

The built-in exact percentile keeps every distinct value of a group in one task. Here the bits of a
double, turned so that they sort like the value, are selected digit by digit: a round counts the
values of every key by their next digit, map-side, and the counts tell in which digit each wanted
rank lies; only values with that prefix are counted again. After three rounds the digits are the
value. No value is ever collected or ordered, and a window holds the counts of one prefix, 2 ** 22
at most, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evtlake.functions.expr import finite
from evtlake.plans import binning, ordering

#: Bits that are still to be known after every round.
ROUNDS = (42, 21, 0)
BROADCAST_KEYS = ordering.BROADCAST_KEYS
_FLIP = np.int64((1 << 63) - 1)


@F.pandas_udf(T.LongType())
def _bits(values: pd.Series) -> pd.Series:
    """Integers that sort like the doubles; both zeros are one value."""
    raw = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ _FLIP, raw))


@F.pandas_udf(T.DoubleType())
def _value(bits: pd.Series) -> pd.Series:
    raw = bits.to_numpy(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ _FLIP, raw).view(np.float64))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    method: str = "linear",
    stats: Sequence[Column] = (),
    few: bool | None = None,
) -> DataFrame:
    """One row per key with the aliased aggregates ``stats`` and one column per entry of ``probs``.

    ``linear`` interpolates between neighbours, ``lower`` takes the lower one. NULL, NaN
    and infinite values are left out. A key without values gets NULLs. ``few`` says that the
    caller knows a bound for the number of keys, whose prefixes are then broadcast; otherwise
    a count of up to ``BROADCAST_KEYS`` keys decides, and more are joined by shuffle.
    """
    if method not in ("linear", "lower"):
        raise ValueError(f"unknown method {method!r}")
    names, ps = list(probs), list(probs.values())
    rows = df.withColumn("_v", F.col(value).cast("double"))
    rows = rows.withColumn("_v", F.when(finite(F.col("_v")), F.col("_v")))
    keys = list(keys)
    if few is None:
        few = not keys or rows.select(*keys).distinct().limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    by = keys or ["_all"]
    base = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), *stats)
    if not keys:
        rows, base = rows.withColumn("_all", F.lit(0)), base.withColumn("_all", F.lit(0))
    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in ps]
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(e).alias("_e"), F.least(F.floor(x) + e, F.col("_n") - 1).alias("_r"))
                      for i, x in enumerate(h) for e in ((0,) if method == "lower" else (0, 1))])
    bits = rows.where(F.col("_v").isNotNull()).select(*by, _bits("_v").alias("_b"))
    wanted = base.where("_n > 0").select(*by, F.inline(ranks))
    within, last = by, None
    for shift in ROUNDS:
        left = bits
        if last is not None:
            left = bits.withColumn("_p", F.shiftright("_b", last))
            left = binning.attach(left, wanted.select(*within).distinct(), within, "inner", few)
        counts = left.groupBy(*within, F.shiftright("_b", shift).alias("_d")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*within).orderBy("_d"))
        found = binning.attach(counts.withColumn("_u", upto), wanted, within, "inner", False)
        inside = found.where((F.col("_r") < F.col("_u")) & (F.col("_r") >= F.col("_u") - F.col("_c")))
        wanted = inside.select(*by, "_i", "_e", (F.col("_r") - F.col("_u") + F.col("_c")).alias("_r"), F.col("_d").alias("_p"))
        within, last = [*by, "_p"], shift
    at = wanted.withColumn("_x", _value("_p"))
    ends = at.groupBy(*by).agg(*[F.max(F.when((F.col("_i") == i) & (F.col("_e") == e), F.col("_x"))).alias(f"_q{i}_{e}") for i in range(len(ps)) for e in (0, 1)])
    joined = binning.attach(base, ends, by, "left", False)
    carried = [c for c in base.columns if c not in (*by, "_n")]
    low, high = [F.col(f"_q{i}_0") for i in range(len(ps))], [F.col(f"_q{i}_1") for i in range(len(ps))]
    linear = [a + (x - F.floor(x)) * (b - a) for a, b, x in zip(low, high, h)]
    return joined.select(*keys, *carried, *[q.alias(n) for q, n in zip(low if method == "lower" else linear, names)])
