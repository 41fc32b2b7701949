"""Checks of converted tables and splits, and masked pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def integrity_checks(index: DataFrame, sensors: DataFrame, source_events: DataFrame,
                     key: str = "event_id", tolerance: float = 0.01) -> DataFrame:
    """One row of totals and violation counts.

    ``sensors`` needs the key of its event. ``source_events`` are the non-empty events
    that the conversion should have kept.
    """
    total = sensors.agg(F.count("*")).scalar()
    counted = sensors.groupBy(key).agg(F.count("*").alias("_c"))
    both = counted.join(index.withColumn("_i", F.lit(True)), key, "full_outer")
    indexed, size = F.col("_i").isNotNull(), F.col("sensor_end_idx") - F.col("sensor_start_idx")
    out = both.withColumn("_total", total).agg(
        F.count("_i").alias("events"),
        F.sum("num_sensors").alias("header_sensors"),
        F.count_if(indexed & (size < 0)).alias("reversed_ranges"),
        F.count_if(indexed & (F.col("sensor_end_idx") > F.col("_total"))).alias("ranges_past_end"),
        F.count_if(indexed & (size != F.col("num_sensors"))).alias("size_mismatches"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("sensors"),
        F.coalesce(F.sum(F.when(~indexed, F.col("_c"))), F.lit(0)).alias("orphan_sensors"),
        F.count_if(indexed & F.col("_c").isNull()).alias("events_without_sensors"),
    ).withColumn("source_events", source_events.agg(F.count("*")).scalar())
    return out.withColumn(
        "within_tolerance",
        F.abs(F.col("events") - F.col("source_events")) <= tolerance * F.greatest("source_events", F.lit(1)))


def split_checks(train: DataFrame, val: DataFrame, full: DataFrame) -> DataFrame:
    """One row: overlap of the two sides, their coverage, and what the full set misses or exceeds.

    All set comparisons come from one count of each event per side.
    """
    sides = {"train": train, "val": val, "full": full}
    tagged = None
    for name, side in sides.items():
        rows = side.withColumn("_side", F.lit(name))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    seen = tagged.groupBy(*full.columns).agg(*[F.count_if(F.col("_side") == s).alias(s) for s in sides])
    both = F.col("train") + F.col("val")
    surplus = lambda a, b: F.coalesce(F.sum(F.greatest(a - b, F.lit(0))), F.lit(0))
    return seen.agg(
        F.count_if((F.col("train") > 0) & (F.col("val") > 0)).alias("overlap"),
        F.count_if(both > 0).alias("covered"),
        surplus(F.col("full"), both).alias("missing"),
        surplus(both, F.col("full")).alias("extra"),
        F.coalesce(F.sum("full"), F.lit(0)).alias("full_events"))


def mean_pool(df: DataFrame, group: str, vector: str, mask: str | None = None) -> DataFrame:
    """Masked mean of vectors per group, one row per group and dimension; divisor at least 1."""
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    parts = df.select(group, weight.alias("_w"), F.posexplode(vector).alias("dim", "_v"))
    pooled = F.sum(F.col("_v").cast("double") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1.0))
    return parts.groupBy(group, "dim").agg(pooled.alias("pooled"))
