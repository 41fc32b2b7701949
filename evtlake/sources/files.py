"""A table of data files, read once from their footers, from which scans are planned without opening data.

One row per file: its folder, rows, bytes, row groups, columns with types, a digest of those
(``version``), and ``error`` where the footer could not be read or a column that is needed has a
type that holds no numbers. Ranges, samples, splits, recipes, row limits and positions are
expressions over this table; only what they choose is opened. A file that cannot be used fails
alone: it stays in the table with its error, and scans leave it out.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evtlake.functions import codes
from evtlake.functions.expr import seeded_hash
from evtlake.plans import ordering
from evtlake.sources import scan

FILES = ("file string, dir string, bytes bigint, modified timestamp, rows bigint, version string, "
         "columns array<struct<name:string,type:string>>, row_groups array<struct<first:bigint,rows:bigint,bytes:bigint>>, error string")
FOOTERS_PER_TASK = 200
NUMBERS = (*codes.SENSOR_COLUMNS.values(), *codes.TRUTH_COLUMNS)


def _footer(file: str) -> dict:
    """What the footer of one file says, or why it cannot be used."""
    from pyarrow import fs, parquet
    try:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as opened:
            found = parquet.ParquetFile(opened)
            schema, meta = found.schema_arrow, found.metadata
            sizes = [meta.row_group(i) for i in range(meta.num_row_groups)]
            ends = np.cumsum([g.num_rows for g in sizes])
            columns = [{"name": f.name, "type": str(f.type)} for f in schema]
            wrong = [f.name for f in schema if f.name in NUMBERS and not _numeric(f.type)]
            return {
                "rows": meta.num_rows, "columns": columns, "version": hashlib.md5(repr(sorted((c["name"], c["type"]) for c in columns)).encode()).hexdigest(),
                "row_groups": [{"first": int(e) - g.num_rows, "rows": g.num_rows, "bytes": g.total_byte_size} for e, g in zip(ends, sizes)],
                "error": f"no numbers in {', '.join(wrong)}" if wrong else None}
    except Exception as e:  # noqa: BLE001 - whatever is wrong with one file is told in its row
        return {"rows": 0, "columns": [], "version": None, "row_groups": [], "error": f"{type(e).__name__}: {e}"[:500]}


def _numeric(kind: pa.DataType) -> bool:
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return _numeric(kind.value_type)
    return pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind) or pa.types.is_null(kind)


def file_table(spark: SparkSession, paths: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """All data files below ``paths``, in path order. Tasks read the footers, FOOTERS_PER_TASK each.

    ``known`` is an earlier table: files of the same path, size and time are taken from it, unless
    they failed. Files that are gone leave the table; files of no bytes are not listed.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths)).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    same = ["file", "bytes", "modified"]
    new = listed if known is None else listed.join(known.where("error is null").select(*same), same, "left_anti")
    schema = listed.sparkSession.createDataFrame([], FILES).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(schema)
        for batch in batches:
            rows = [{**row, "dir": row["file"].rpartition("/")[0], **_footer(row["file"])} for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    tasks = max(1, -(-new.count() // FOOTERS_PER_TASK))
    found = new.repartition(tasks, "file").mapInArrow(read, FILES)
    return found if known is None else found.unionByName(known.join(listed, same, "left_semi"))


def usable(files: DataFrame) -> DataFrame:
    return files.where("error is null")


def failures(files: DataFrame) -> DataFrame:
    """file and error of the files that scans leave out."""
    return files.where("error is not null").select("file", "error")


def write_whole(spark: SparkSession, parts: str, file: str) -> None:
    """One Parquet file of all rows of the Parquet files in the folder ``parts``, which is beside ``file`` and stays there.

    The file is a footer: its row groups name the parts that hold their columns, as the format allows, so no task
    moves rows. Footers of parts, a few kB each, are put together here.
    """
    from pyarrow import fs, parquet
    folder = parts.rstrip("/").rpartition("/")[2]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(parts).select("path").sort("path")
    whole = None
    for row in found.toLocalIterator():
        store, path = fs.FileSystem.from_uri(row.path)
        with store.open_input_file(path) as opened:
            footer = parquet.read_metadata(opened)
        footer.set_file_path(f"{folder}/{path.rpartition('/')[2]}")
        if whole is None:
            whole, target = footer, f"{path.rpartition(f'/{folder}/')[0]}/{file.rpartition('/')[2]}"
        else:
            whole.append_row_groups(footer)
    with store.open_output_stream(target) as out:
        whole.write_metadata_file(out)


# --- plans over the table -----------------------------------------------------------


def numbered(files: DataFrame, within: Sequence[str] = (), out: str = "file_no", name: Column | None = None) -> DataFrame:
    """0-based number of every file in order of ``name``, by default its path. One row per file, so one window will do."""
    order = [F.col("file")] if name is None else [name, F.col("file")]
    return files.withColumn(out, (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))


def in_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """Files at positions ``[start, end)`` in path order; failed ones count, as they would in a listing."""
    return numbered(files).where((F.col("file_no") >= start) & (F.col("file_no") < end)).drop("file_no")


def per_folder(files: DataFrame, n: int, seed: int = 42, name: Column | None = None) -> DataFrame:
    """At most ``n`` seeded-random files of every folder; ``name`` is what the digest is made of, by default the path."""
    return numbered(files, ["dir"], "_no", seeded_hash(seed, F.col("file") if name is None else name)).where(F.col("_no") < n).drop("_no")


def split(files: DataFrame, val: float = 0.1, seed: int = 42, train: Sequence[str] | None = None,
          valid: Sequence[str] | None = None, name: Column | None = None) -> DataFrame:
    """Add ``split``: ``int(n * (1 - val))`` files train, the rest val; with glob lists a file belongs to the list that matches it, else it leaves."""
    if train is not None and valid is not None:
        matches = lambda patterns: F.col("file").rlike("|".join(fnmatch.translate(p) for p in patterns))
        return files.withColumn("split", F.when(matches(train), "train").when(matches(valid), "val")).where("split is not null")
    ranked = numbered(files, (), "_no", seeded_hash(seed, F.col("file") if name is None else name))
    n_train = F.floor(F.count("*").over(Window.partitionBy()) * F.lit(1.0 - val))
    return ranked.withColumn("split", F.when(F.col("_no") < n_train, "train").otherwise("val")).drop("_no")


def mix(files: DataFrame, recipe: Sequence[scan.Source]) -> DataFrame:
    """Files of a recipe with their ``source`` and whether only starting events are wanted; the first entry whose folder is in a path has the file."""
    entry = F.coalesce(*[F.when(F.array_contains(F.split("file", "/"), s.folder), F.lit(i)) for i, s in enumerate(recipe)])
    found = numbered(files.withColumn("_entry", entry).where("_entry is not null"), ["_entry"], "_no")
    chosen = reduce(Column.__or__, [
        (F.col("_entry") == i) & (F.lit(True) if s.files is None else F.col("_no").between(s.files[0], s.files[1] - 1)) for i, s in enumerate(recipe)])
    return found.where(chosen).withColumns({
        "source": codes.lookup({i: s.name for i, s in enumerate(recipe)}, F.col("_entry"), ""),
        "only_starting": codes.lookup({i: s.starting_only for i, s in enumerate(recipe)}, F.col("_entry"), False)}).drop("_entry", "_no")


def cumulative(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``take``, the rows used of a file, and ``start``, how many are used of all files before it in path order."""
    take = F.col("rows") if limit is None else F.least("rows", F.lit(limit))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("take", take).withColumn("start", F.coalesce(F.sum("take").over(before), F.lit(0)))


def locate(files: DataFrame, positions: DataFrame, position: str = "position", limit: int | None = None) -> DataFrame:
    """``positions`` with the ``file`` and ``row_index`` that each 0-based global position stands for; others are left out.

    The starts of the files, one number each, are searched in the tasks behind a count; beyond
    BROADCAST_KEYS files they are merged with the positions.
    """
    from evtlake.plans import lookup
    starts = cumulative(usable(files), limit).where("take > 0").select("file", "start", (F.col("start") + F.col("take")).alias("_end"))
    near = starts.limit(ordering.BROADCAST_KEYS + 1).count() <= ordering.BROADCAST_KEYS
    at = F.col(position)
    if near:
        found = positions.join(F.broadcast(starts), (at >= F.col("start")) & (at < F.col("_end")))
    else:
        size = starts.agg(F.max("_end")).first()[0]
        found = lookup.interval_lookup(positions, position, starts, "start", "_end", max(1.0, size / 4096))
    return found.withColumn("row_index", at - F.col("start")).drop("start", "_end")


# --- scans of chosen files ----------------------------------------------------------


def scan_files(spark: SparkSession, files: DataFrame, keep: Sequence[str] = (), file_columns: bool = False,
               carry: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Events of the given rows of a file table, in the full schema of ``conform_columns``, plus ``keep`` and the table's columns ``carry``.

    Only these files are opened. Files of one version, by names and types, are one pruned scan, so a
    float column beside a double one is read as what it is in each. Failed files are left out. With
    ``limit`` only the first rows of every file come, and only the row groups that hold them are read.
    """
    chosen = usable(files).where("rows > 0")
    versions = chosen.groupBy("version").agg(F.first("columns").alias("columns"), F.sort_array(F.collect_list("file")).alias("files")).orderBy("version").collect()
    if not versions:
        raise ValueError("no event files")
    metadata = ["file_path", "row_index"] if file_columns else ["file_path"] if carry else []
    parts = []
    for version in versions:
        names = {c.name for c in version.columns}
        wanted = [c for c in dict.fromkeys([*scan.REQUIRED, *keep]) if c in names]
        found = spark.read.parquet(*version.files).select(*wanted, *[F.col(f"_metadata.{c}").alias(c) for c in metadata])
        if limit is not None:
            found = first_rows(chosen.where(F.col("version") == version.version).select("file", F.least("rows", F.lit(limit)).alias("n")), found)
        parts.append(scan.conform_columns(found, [*(c for c in keep if c in names), *metadata]))
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not carry:
        return events
    facts = ordering.broadcast_if_short(chosen.select(F.col("file").alias("_file"), *carry))
    joined = events.join(facts, F.col("file_path") == F.col("_file")).drop("_file")
    return joined if file_columns else joined.drop("file_path")


def first_rows(files: DataFrame, like: DataFrame) -> DataFrame:
    """The first ``n`` rows of every file (file, n) in the columns of ``like``, row group by row group."""
    schema = like.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(schema)
        inside = [f.name for f in kinds if f.name not in ("file_path", "row_index")]
        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as opened:
                    source = parquet.ParquetFile(opened)
                    at = group = 0
                    while at < n:
                        for rows in source.iter_batches(8192, row_groups=[group], columns=inside):
                            rows = rows.slice(0, n - at)
                            own = {**{name: rows.column(name) for name in inside}, "file_path": pa.array([file] * len(rows)), "row_index": pa.array(range(at, at + len(rows)))}
                            if len(rows):
                                yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in kinds], schema=kinds)
                            at += len(rows)
                        group += 1

    return files.repartition(min(4096, max(1, files.count())), "file").mapInArrow(read, schema)
