"""Histograms, densities and binned profiles.

Bin edges are scalars from one min/max pass; bins are counted map-side, and only bin
counts are shuffled. All results have one row per bin, cell or grid point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from evtlake.functions.expr import finite
from evtlake.plans import binning
from evtlake.plans.quantiles import exact_quantiles

Range = tuple[float, float] | None
KERNEL_ROWS = 1024  # rows whose kernels are in memory at once
PROFILE_PROBS = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def histogram_1d(df: DataFrame, value: str, bins: int = 50, limits: Range = None, density: bool = False) -> DataFrame:
    """(bin, low, high, count) and, on request, density; every bin has a row."""
    rows = df.select(F.col(value).cast("double").alias("_v"))
    ends = binning.span(rows, "_v", limits)
    counts = binning.with_bin(rows.withColumn("_e", ends), "_v", "_e", bins, "bin").groupBy("bin").count()
    out = binning.fill_grid(counts, binning.grid(df, bin=bins), ["bin"], ["count"]).withColumn("_e", ends)
    out = out.withColumns({
        "low": binning.edge(F.col("_e"), bins, F.col("bin")),
        "high": binning.edge(F.col("_e"), bins, F.col("bin") + 1)}).drop("_e")
    if density:
        total = F.sum("count").over(Window.partitionBy())
        out = out.withColumn("density", F.col("count") / (total * (F.col("high") - F.col("low"))))
    return out


def zenith_histograms(errors: DataFrame, bins: int = 50) -> DataFrame:
    """Density histograms of the true and the predicted cosine of the zenith."""
    sides = [
        histogram_1d(errors, f"{side}_cos_zenith", bins, density=True).withColumn("series", F.lit(side))
        for side in ("true", "pred")]
    return sides[0].unionByName(sides[1])


def kde_1d(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule.

    A task sums all kernels of its rows in one array of grid points, so no value is unfolded and
    one partial sum per task and point is shuffled. Without finite values there are no rows.
    """
    rows = df.select(F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    low, high = F.col("_f.e.lo"), F.col("_f.e.hi")
    facts = rows.agg(F.struct(
        F.count("*").alias("n"), F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("e"),
        (F.stddev_samp("_v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"))).scalar()
    step = (high - low) / F.lit(float(points - 1))
    # kernels are evaluated in units of the bandwidth
    scaled = rows.withColumn("_f", facts).select(
        ((low - F.col("_v")) / F.col("_f.h")).alias("_s"), (step / F.col("_f.h")).alias("_d"))

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, grid = np.zeros(points), np.arange(points)
        for batch in batches:
            for at in range(0, len(batch), KERNEL_ROWS):
                z = batch["_s"].values[at:at + KERNEL_ROWS, None] + grid * batch["_d"].values[at:at + KERNEL_ROWS, None]
                total += np.exp(-0.5 * z * z).sum(axis=0)
        yield pd.DataFrame({"point": grid.astype(np.int32), "_k": total})

    sums = scaled.mapInPandas(kernels, "point int, _k double").groupBy("point").agg(F.sum("_k").alias("_k"))
    return sums.withColumn("_f", facts).where(F.col("_f.n") > 0).select(
        "point", (low + F.col("point") * step).alias("x"),
        (F.col("_k") / (F.col("_f.n") * F.col("_f.h") * sqrt(2 * pi))).alias("density"))


def _pairs(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Both values where both are finite, else NULLs."""
    rows = df.select(*keys, F.col(x).cast("double").alias("_a"), F.col(y).cast("double").alias("_b"))
    both = finite(F.col("_a")) & finite(F.col("_b"))
    return rows.select(*keys, F.when(both, F.col("_a")).alias("_x"), F.when(both, F.col("_b")).alias("_y"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: tuple[int, int], x_limits: Range = None,
                 y_limits: Range = None) -> DataFrame:
    """Counts of all cells (xb, yb)."""
    rows = _pairs(df, x, y)
    rows = rows.withColumns({
        "_ex": binning.span(rows, "_x", x_limits), "_ey": binning.span(rows, "_y", y_limits)})
    placed = binning.with_bin(binning.with_bin(rows, "_x", "_ex", bins[0], "xb"), "_y", "_ey", bins[1], "yb")
    counts = placed.groupBy("xb", "yb").count()
    return binning.fill_grid(counts, binning.grid(df, xb=bins[0], yb=bins[1]), ["xb", "yb"], ["count"])


def histogram_2d_colnorm(df: DataFrame, x: str, y: str, bins: tuple[int, int] = (50, 50),
                         x_limits: Range = None, y_limits: Range = None) -> DataFrame:
    """Cells normalised inside their x-bin; an empty x-bin gives zeros."""
    cells = histogram_2d(df, x, y, bins, x_limits, y_limits)
    column = F.sum("count").over(Window.partitionBy("xb"))
    return cells.withColumn("share", F.when(column > 0, F.col("count") / column).otherwise(F.lit(0.0)))


def histogram_2d_density(df: DataFrame, x: str, y: str, x_limits: tuple[float, float],
                         y_limits: tuple[float, float], bins: tuple[int, int] = (50, 50),
                         floor: float = 1e-5) -> DataFrame:
    """Cells as density over the area inside the limits; cells below ``floor`` are hidden."""
    cells = histogram_2d(df, x, y, bins, x_limits, y_limits)
    area = (x_limits[1] - x_limits[0]) / bins[0] * (y_limits[1] - y_limits[0]) / bins[1]
    total = F.sum("count").over(Window.partitionBy())
    return cells.withColumn("density", F.try_divide(F.col("count").cast("double"), total * area)).where(
        F.col("density") >= floor)


def kappa_maps(errors: DataFrame, bins: int = 50) -> DataFrame:
    """Concentration against angular error and against the predicted cosine of the zenith."""
    pairs = {"angular_error": "error_deg", "cos_zenith": "pred_cos_zenith"}
    maps = [histogram_2d_colnorm(errors, x, "kappa", (bins, bins)).withColumn("map", F.lit(name))
            for name, x in pairs.items()]
    return maps[0].unionByName(maps[1])


def sigma_calibration(errors: DataFrame, sigma: str, error: str, limit: float) -> DataFrame:
    """Density of predicted sigma against error on [0, limit]; 1000 for vertices, 2 for energies."""
    return histogram_2d_density(errors, sigma, error, (0.0, limit), (0.0, limit))


def binned_profile(df: DataFrame, x: str, y: str, bins: int = 20, keys: Sequence[str] = (),
                   limits: Range = None) -> DataFrame:
    """Per x-bin: centre, n, median, quartiles and RMS of y.

    Bins are half-open, so rows at the largest x belong to none. Empty bins have NULLs.
    """
    rows = _pairs(df, x, y, keys)
    ends = binning.span(rows, "_x", limits)
    placed = binning.with_bin(rows.withColumn("_e", ends), "_x", "_e", bins, "bin")
    binned = placed.select(*keys, F.when(F.col("_x") < F.col("_e.hi"), F.col("bin")).alias("bin"), "_y")
    by = [*keys, "bin"]
    stats = [F.count("_y").alias("n"), F.sqrt(F.avg(F.col("_y") * F.col("_y"))).alias("rms")]
    found = exact_quantiles(binned, "_y", PROFILE_PROBS, by, stats=stats, few=None if keys else True)
    measures = ["n", "rms", *PROFILE_PROBS]
    # a key's few bins as a map, unfolded over all bins
    known = F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct(*measures)))
    cells = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(known)).alias("_m")).select(
        *keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = cells.withColumns({"_c": F.try_element_at("_m", F.col("bin")), "_e": ends})
    middle = [binning.edge(F.col("_e"), bins, F.col("bin") + i) for i in (0, 1)]
    return out.select(
        *keys, "bin", ((middle[0] + middle[1]) / 2.0).alias("centre"), "_c.*").na.fill(0, ["n"])


def smooth_profile(profile: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), bins: int = 20,
                   sigma: float = 1.5, truncate: float = 4.0) -> DataFrame:
    """Fill gaps linearly and smooth with a Gaussian kernel, per key.

    Ends take the nearest value, edges are mirrored with the edge bin repeated, a series
    without values stays empty. Series have ``bins`` rows, so their windows are small.
    """
    radius = int(truncate * sigma + 0.5)
    raw = [exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    kernel = [w / sum(raw) for w in raw]
    whole = Window.partitionBy(*keys).orderBy("bin")
    back = whole.rowsBetween(Window.unboundedPreceding, 0)
    ahead = whole.rowsBetween(0, Window.unboundedFollowing)
    filled = profile
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("bin").alias("b"), F.col(c).alias("v")))
        left, right = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        filled = filled.withColumns({f"_l_{c}": left, f"_r_{c}": right})
    for c in columns:
        lo, hi = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        between = lo["v"] + F.try_divide((hi["v"] - lo["v"]) * (F.col("bin") - lo["b"]), hi["b"] - lo["b"])
        filled = filled.withColumn(f"_f_{c}", F.coalesce(
            F.col(c), F.when(lo.isNotNull() & hi.isNotNull(), between), lo["v"], hi["v"]))
    offsets = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w"))
                        for j, w in zip(range(-radius, radius + 1), kernel)])
    # bin i of the result reads bin i + j, folded back at both ends
    kept = [c for c in profile.columns if c not in (*keys, "bin")]
    spread = filled.withColumnRenamed("bin", "_from").select(
        *keys, "_from", *kept, *[f"_f_{c}" for c in columns], F.explode(
            F.sequence(F.lit(-radius), F.lit(bins - 1 + radius))).alias("_at"))
    folded = F.pmod(F.col("_at"), F.lit(2 * bins))
    source = F.when(folded < bins, folded).otherwise(2 * bins - 1 - folded)
    taps = spread.where(source == F.col("_from")).withColumn("_w", F.explode(offsets)).withColumn(
        "bin", F.col("_at") - F.col("_w.j")).where(F.col("bin").between(0, bins - 1))
    own = (F.col("_at") == F.col("bin")) & (F.col("_w.j") == 0)
    return taps.groupBy(*keys, "bin").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in kept],
        *[F.sum(F.col("_w.w") * F.col(f"_f_{c}")).alias(f"{c}_smooth") for c in columns])


def fractional_energy_error(df: DataFrame, pred_log: str, true_log: str, bins: int = 20,
                            keys: Sequence[str] = ()) -> DataFrame:
    """Profile of (E_pred - E_true) / E_true over the true log energy."""
    true = F.pow(F.lit(10.0), F.col(true_log))
    error = (F.pow(F.lit(10.0), F.col(pred_log)) - true) / true
    return binned_profile(df.withColumn("_fe", error), true_log, "_fe", bins, keys)


def energy_resolution(df: DataFrame, pred_log: str, true_log: str, bins: int = 20,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Profile of the log energy residual over the true log energy."""
    return binned_profile(
        df.withColumn("_res", F.col(pred_log) - F.col(true_log)), true_log, "_res", bins, keys)
