"""Conversion of nested events to an event index and a sensor table, and its manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from evtlake.functions import codes
from evtlake.operators import labels, nested
from evtlake.plans import ordering

#: Sensors whose events are written to one file of the index.
SLICE = 1 << 28
#: Sensors of one file of the sensor table, at most.
ZONE = 1 << 22
INDEX_TYPES = {
    "sensor_start_idx": "long", "sensor_end_idx": "long", "num_sensors": "long", "total_charge": "float",
    **{c: "float" for c in codes.TRUTH_COLUMNS},
    "morphology": "byte", "morphology_raw": "byte", "starting": "boolean", "dataset_id": "long",
}


def event_tables(
    nested_events: DataFrame, key: str, file: str, levels: Sequence[str], order: Sequence[str],
    starting_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Conformed nested events -> (event index, sensors).

    Events without sensors leave. Offsets run through all events in (``levels``, ``order``, key),
    which no two events may share. An event may span several rows (column ``first_pos``); its
    sensors keep one numbering. ``sensor_idx`` of a sensor is its place in the offsets. Both come
    dealt by ranges of the offsets; sensors are moved once, in lists of the floats that the table holds.
    """
    rows = labels.starting_only(nested_events) if starting_only else nested_events
    rows = rows.withColumn("dataset_id", labels.dataset_id_from_path(F.col(file)))
    base = F.col("first_pos") if "first_pos" in rows.columns else None
    order = list(dict.fromkeys([*order, key]))
    first = [] if base is None else ["first_pos"]
    lists = dict.fromkeys([key, "dataset_id", *levels, *order, *first, *codes.SENSOR_COLUMNS.values()])
    single = {c: F.col(c).cast("array<float>") for c in codes.SENSOR_COLUMNS.values()}
    placed = ordering.running_total_in_ranges(
        rows.select(*lists).withColumns(single), "_at", F.size(codes.SENSOR_COLUMNS["x"]).cast("long"), levels, [F.col(c) for c in [*order, *first]])
    sensors = nested.explode_sensors(placed, [key, "dataset_id", "_at", *first], base).select(
        key, "dataset_id", "pos", (F.col("_at") + F.col("pos") - (F.lit(0) if base is None else base)).alias("sensor_idx"),
        *[F.col(f).cast("float").alias(f) for f in codes.SENSOR_COLUMNS])
    kept = dict.fromkeys([key, file, "dataset_id", *levels, *order, *codes.TRUTH_COLUMNS, codes.MORPHOLOGY_COLUMN])
    size, charge = nested.list_stats(
        codes.SENSOR_COLUMNS["x"], codes.SENSOR_COLUMNS["c_total"])
    sized = rows.select(*kept, size.alias("num_sensors"), charge.alias("total_charge"))
    if base is not None and not rows.where(F.col("first_pos") > 0).isEmpty():
        sized = sized.groupBy(*kept).agg(
            F.sum("num_sensors").alias("num_sensors"), F.sum("total_charge").alias("total_charge"))
    filled = labels.morphology_codes(sized.where(F.col("num_sensors") > 0))
    offsets = ordering.running_total_in_ranges(filled, "sensor_start_idx", F.col("num_sensors").cast("long"), levels, [F.col(c) for c in order])
    index = offsets.withColumn("sensor_end_idx", F.col("sensor_start_idx") + F.col("num_sensors"))
    return index.select(key, *[F.col(c).cast(t).alias(c) for c, t in INDEX_TYPES.items()]), sensors


def write_event_tables(index: DataFrame, sensors: DataFrame, path: str, zone: int = ZONE, in_ranges: bool = False) -> None:
    """Persist both tables, one directory per dataset, in order of the offsets, and the map of the sensors' files.

    Sensors are dealt by ranges of (dataset, sensor_idx), so a file holds one run of them, ``zone`` at
    most; ``in_ranges`` says that both come in ranges, as ``event_tables`` gives them. The map, written beside
    the tables, says for every file its first and last ``sensor_idx``.
    """
    near = index if in_ranges else index.repartition("dataset_id", F.expr(f"sensor_start_idx div {SLICE}"))
    near = near.sortWithinPartitions("dataset_id", "sensor_start_idx")
    near.write.partitionBy("dataset_id").mode("errorifexists").parquet(f"{path}/event_index", compression="zstd")
    ranged = sensors if in_ranges else sensors.repartitionByRange("dataset_id", F.expr(f"sensor_idx div {max(1, zone // 64)}"))
    ranged = ranged.sortWithinPartitions("dataset_id", "sensor_idx")
    ranged.write.option("maxRecordsPerFile", zone).partitionBy("dataset_id").mode("errorifexists").parquet(f"{path}/sensors", compression="zstd")
    zone_map(sensors.sparkSession, f"{path}/sensors").coalesce(1).write.mode("errorifexists").parquet(f"{path}/zones")


def zone_map(spark: SparkSession, sensors: str) -> DataFrame:
    """dataset_id, file, first, last and rows of every file of a written sensor table; one column is read."""
    found = spark.read.parquet(sensors).select("dataset_id", "sensor_idx", F.col("_metadata.file_path").alias("file"))
    return found.groupBy("dataset_id", "file").agg(F.min("sensor_idx").alias("first"), F.max("sensor_idx").alias("last"), F.count("*").alias("rows"))


def read_event_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/event_index"), spark.read.parquet(f"{path}/sensors")


def read_slices(spark: SparkSession, path: str, events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The sensors of the chosen ``events`` (rows of the written index), with event columns and ``pos``.

    The map tells which files hold their offsets; only these are opened. A row of the map is a file
    of up to ZONE sensors, so it is broadcast to the events behind a count.
    """
    zones = ordering.broadcast_if_short(spark.read.parquet(f"{path}/zones").withColumnsRenamed({"dataset_id": "_set"}))
    wanted = events.select("dataset_id", "sensor_start_idx", "sensor_end_idx").where("sensor_end_idx > sensor_start_idx")
    overlap = (F.col("_set") == F.col("dataset_id")) & (F.col("first") < F.col("sensor_end_idx")) & (F.col("last") >= F.col("sensor_start_idx"))
    files = sorted(r.file for r in wanted.join(zones, overlap).select("file").distinct().collect())
    schema = spark.read.parquet(f"{path}/sensors").schema
    sensors = spark.read.schema(schema).option("basePath", f"{path}/sensors").parquet(*files) if files else spark.createDataFrame([], schema)
    if columns is not None:
        sensors = sensors.select("dataset_id", "sensor_idx", *columns)
    return nested.slice_join(sensors, events, keys=["dataset_id"], rows=sensors.count())


def dataset_manifest(index: DataFrame, dataset: str = "dataset_id", sources: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Events, sensors and success per dataset, and grand totals in the row without a dataset.

    With ``sources`` (the datasets asked for) a dataset that gave no events counts as failed. With
    ``files`` (a file table) its datasets are asked for, and ``files`` and ``failed_files`` are counted.
    """
    counts = index.groupBy(dataset).agg(
        F.count("*").alias("events"), F.sum("num_sensors").cast("long").alias("sensors"))
    measures = ["events", "sensors"]
    if files is not None:
        own = files.groupBy(labels.dataset_id_from_path(F.col("file")).cast(index.schema[dataset].dataType).alias(dataset)).agg(
            F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed_files"))
        measures += ["files", "failed_files"]
        counts = counts.join(own, dataset, "full_outer").na.fill(0, measures)
    if sources is not None:
        counts = sources.select(dataset).distinct().join(counts, dataset, "left").na.fill(0, measures)
    return counts.rollup(dataset).agg(
        F.sum("events").alias("events"), F.sum("sensors").alias("sensors"),
        F.count_if(F.col("events") > 0).alias("succeeded"),
        F.count_if(F.col("events") == 0).alias("failed"),
        *[F.sum(c).alias(c) for c in measures[2:]],
        F.grouping_id().cast("int").alias("is_total"))
