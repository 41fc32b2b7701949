"""Between nested events, sensor rows and packed batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evtlake.functions import codes
from evtlake.plans import lookup, ordering

CHUNK = 65_536


def explode_sensors(df: DataFrame, keep: Sequence[str], base: Column | None = None) -> DataFrame:
    """Parallel lists -> one row per sensor.

    The first sensor list sets the length; shorter lists are filled with 0, longer ones
    cut. ``base`` is the position of a row's first sensor where an event spans rows.
    """
    lists = list(codes.SENSOR_COLUMNS.items())
    shifted = F.col("_i").cast("long") + (base if base is not None else F.lit(0))
    rows = df.select("*", F.posexplode(lists[0][1]).alias("_i", "_x"))
    return rows.select(
        *keep, shifted.alias("pos"), F.coalesce("_x", F.lit(float("nan"))).alias("x"),
        *[F.when(F.col("_i") < F.size(c), F.coalesce(F.get(c, F.col("_i")), F.lit(float("nan"))))
          .otherwise(F.lit(0.0)).alias(f) for f, c in lists[1:]])


def nest_points(
    sensors: DataFrame, key: str, columns: Mapping[str, str], pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Sensor rows -> parallel lists in ``pos`` order.

    A row holds at most ``chunk`` points, so an event above that size continues in
    further rows (``chunk`` = 1, 2, ...) and never meets in one task.
    """
    points = F.sort_array(F.collect_list(F.struct(pos, *columns)))
    rows = sensors.groupBy(key, F.expr(f"{pos} div {chunk}").alias("chunk")).agg(points.alias("_p"))
    return rows.select(key, "chunk", *[F.col(f"_p.{c}").alias(n) for c, n in columns.items()])


def event_stats(sensors: DataFrame, key: str = "event_id", charge: str = "c_total") -> DataFrame:
    """Sensor count and total charge per event."""
    return sensors.groupBy(key).agg(
        F.count("*").alias("num_sensors"), F.sum(charge).alias("total_charge"))


def list_stats(first: str, charge: str) -> tuple[Column, Column]:
    """The same from the lists of a nested row, without unfolding them."""
    size = F.size(first)
    single = F.transform(F.slice(charge, F.lit(1), size), lambda c: c.cast("float").cast("double"))
    return size.cast("long"), F.aggregate(single, F.lit(0.0), lambda a, c: a + c)


def with_event_stats(events: DataFrame, sensors: DataFrame, key: str = "event_id") -> DataFrame:
    """``event_stats`` on all events; those without sensors get zeros."""
    return events.join(event_stats(sensors, key), key, "left").na.fill(
        {"num_sensors": 0, "total_charge": 0.0})


def sensor_offsets(
    events: DataFrame, levels: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Running ``[sensor_start_idx, sensor_end_idx)`` over the events in order."""
    return ordering.running_total(
        events, "sensor_start_idx", F.col("num_sensors").cast("long"), levels,
        [F.col(c) for c in order], keys,
    ).withColumn("sensor_end_idx", F.col("sensor_start_idx") + F.col("num_sensors"))


def slice_join(
    sensors: DataFrame, index: DataFrame, row: str = "sensor_idx", keys: Sequence[str] = (), block: int = 65_536, rows: int = 0
) -> DataFrame:
    """Attach to every sensor row the event whose offsets contain it, and its place there.

    ``rows`` is the number of sensors where it is known: it tells how many tasks they need.
    """
    joined = lookup.interval_lookup(
        sensors, row, index, "sensor_start_idx", "sensor_end_idx", block, keys, rows=rows)
    return joined.withColumn("pos", F.col(row) - F.col("sensor_start_idx"))


def assemble_points(
    df: DataFrame, features: Sequence[str] = codes.FEATURES,
    standard: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Add ``coords`` (x, y, z, t_first) and ``features`` arrays, one entry per point."""
    zipped = F.arrays_zip(*[F.col(codes.SENSOR_COLUMNS[f]) for f in dict.fromkeys((*codes.COORDINATES, *features))])

    def rows(fields: Sequence[str], scale: Mapping[str, tuple[float, float]]) -> Column:
        def value(point: Column, field: str) -> Column:
            v = point[codes.SENSOR_COLUMNS[field]].cast("double")
            mean, std = scale.get(field, (0.0, 1.0))
            return (v - mean) / std if field in scale else v
        return F.transform(zipped, lambda point: F.array(*[value(point, f) for f in fields]))

    return df.withColumns({"coords": rows(codes.COORDINATES, {}), "features": rows(features, standard or {})})


def rescale_points(df: DataFrame, coords: Sequence[str] = ("coords",), features: str = "features") -> DataFrame:
    """Coordinates to km and us (x 1e-3), features through log1p; log1p(-1) is -inf, below NaN."""
    def log1p(v: Column) -> Column:
        return (F.when(v > -1, F.log1p(v)).when(v == -1, F.lit(float("-inf")))
                .when(v.isNotNull(), F.lit(float("nan"))))
    out = {c: F.transform(c, lambda p: F.transform(p, lambda v: v * 1e-3)) for c in coords}
    out[features] = F.transform(features, lambda p: F.transform(p, log1p))
    return df.withColumns(out)


def standardise_features(
    df: DataFrame, parameters: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """(v - mean) / std for the named columns; the others stay."""
    return df.withColumns({
        c: (F.col(c) - mean) / std for c, (mean, std) in parameters.items() if c in df.columns})


def pad_to_max(points: Column, size: Column, empty: Column) -> Column:
    """Pad an array to ``size`` entries with ``empty``; longer arrays stay whole."""
    return F.concat(points, F.array_repeat(empty, F.greatest(size - F.size(points), F.lit(0)).cast("int")))


def assign_batches(
    events: DataFrame, batch_size: int, levels: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add ``batch_id`` and ``event_in_batch`` by position in the given order."""
    ranked = ordering.row_positions(events, "_r", levels, [F.col(c) for c in order])
    return ranked.withColumns({
        "batch_id": F.expr(f"_r div {batch_size}"),
        "event_in_batch": F.col("_r") % batch_size,
    }).drop("_r")


def to_sensors(sensors: DataFrame, events: DataFrame, key: str = "event_id", block: int = CHUNK) -> DataFrame:
    """Join event columns to sensor rows, one join partition per ``block`` sensors of an event.

    An event with more sensors is copied once per block, which its ``num_sensors`` tells
    beforehand, so a giant event spreads over many tasks. Other events are copied once.
    """
    copies = events.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(num_sensors - 1) div {block}"))))
    return sensors.withColumn("_b", F.expr(f"pos div {block}")).join(copies, [key, "_b"]).drop("_b")


def pack_batches(batched: DataFrame, sensors: DataFrame, key: str = "event_id", labels: Sequence[str] = ()) -> DataFrame:
    """Point rows of packed batches; ``event_in_batch`` is the segment id of every point.

    ``labels`` are columns of the event that every point carries along.
    """
    wanted = batched.where(F.col("num_sensors") > 0).select(key, "num_sensors", "batch_id", "event_in_batch", *labels)
    return to_sensors(sensors, wanted, key).drop("num_sensors")


def with_batch_coordinate(packed: DataFrame, coords: Sequence[str] = codes.COORDINATES) -> DataFrame:
    """The other packing: the event's number in its batch is coordinate 0."""
    return packed.withColumn(
        "coords", F.array(F.col("event_in_batch").cast("double"), *[F.col(c).cast("double") for c in coords]))


def pack_padded(batched: DataFrame, sensors: DataFrame, columns: Sequence[str], key: str = "event_id", block: int = CHUNK) -> DataFrame:
    """Packed batches with every event padded to its batch's largest one: zero rows, ``valid`` false.

    Only the padding is generated, ``block`` rows at a time; the points themselves are joined once.
    """
    counts = batched.select("batch_id", "event_in_batch", key, F.col("num_sensors").cast("long").alias("num_sensors"))
    widest = counts.groupBy("batch_id").agg(F.max("num_sensors").alias("n_max"))
    sized = counts.join(widest, "batch_id")
    head = ["batch_id", "event_in_batch", key, F.col("num_sensors").alias("count"), "n_max", "pos"]
    padding = sized.where(F.col("num_sensors") < F.col("n_max")).withColumn(
        "_b", F.explode(F.expr(f"sequence(num_sensors div {block}, (n_max - 1) div {block})"))).withColumn(
        "pos", F.explode(F.sequence(F.greatest("num_sensors", F.col("_b") * block), F.least("n_max", (F.col("_b") + 1) * block) - 1))).select(
        *head, F.lit(False).alias("valid"), *[F.lit(0.0).alias(c) for c in columns])
    filled = to_sensors(sensors.select(key, "pos", *columns), sized.where(F.col("num_sensors") > 0), key, block)
    return filled.select(*head, F.lit(True).alias("valid"), *columns).unionByName(padding)


def batch_summary(batched: DataFrame) -> DataFrame:
    """Per batch: events and smallest, largest and mean sensor count."""
    return batched.groupBy("batch_id").agg(
        F.count("*").alias("events"),
        F.min("num_sensors").alias("min_sensors"),
        F.max("num_sensors").alias("max_sensors"),
        F.avg("num_sensors").alias("mean_sensors"))


def batch_class_counts(batched: DataFrame, classes: Sequence[int], label: str = "label",
                       first: int | None = None) -> DataFrame:
    """Events of each class per batch, for the first batches or all."""
    rows = batched if first is None else batched.where(F.col("batch_id") < first)
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col(label) == c).alias(f"class_{c}") for c in classes])
