"""Event sources: pruned scans, schema alignment, choice of files, unions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from evtlake.functions import codes
from evtlake.functions.expr import seeded_hash
from evtlake.plans import ordering

REQUIRED = (*codes.SENSOR_COLUMNS.values(), *codes.TRUTH_COLUMNS, codes.MORPHOLOGY_COLUMN)


def scan_events(
    spark: SparkSession,
    paths: Sequence[str],
    additional_columns: Iterable[str] = (),
    file_columns: bool = False,
    tolerate_absent: bool = False,
) -> DataFrame:
    """Read event files, only the required columns and the named extras.

    ``file_columns`` adds ``file_path`` and ``row_index`` from the scan's metadata.
    All files of the call must share a version; ``tolerate_absent`` leaves columns out that
    this version lacks, for ``conform_columns`` to fill. ``scan_versions`` reads files of any
    mixture of versions, and ``files.scan_files`` those that a file table chooses.
    """
    wanted = list(dict.fromkeys([*REQUIRED, *additional_columns]))
    if tolerate_absent:
        present = set(spark.read.parquet(*paths).columns)
        wanted = [c for c in wanted if c in present]
    if file_columns:
        wanted += [F.col("_metadata.file_path").alias("file_path"),
                   F.col("_metadata.row_index").alias("row_index")]
    return spark.read.parquet(*paths).select(*wanted)


def list_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """All data files below the paths, in path order, as Spark's own listing finds them; no data is read."""
    return sorted(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true").load(list(paths)).inputFiles())


def scan_versions(
    spark: SparkSession, paths: Sequence[str], keep: Sequence[str] = (), file_columns: bool = False
) -> DataFrame:
    """Events of files of any versions in the full schema of ``conform_columns``, plus ``keep``.

    Every file decides by its own footer which columns of which types it has, whatever stands
    beside it. A ``keep`` column that a file lacks is NULL there. Each version is one pruned scan.
    Files that cannot be used are left out; ``files.file_table`` and ``files.failures`` name them.
    """
    from evtlake.sources import files
    return files.scan_files(spark, ordering.cut_lineage(files.file_table(spark, paths)), keep, file_columns)


def conform_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Give a source of any version the full event schema.

    Absent numbers become 0 and an absent morphology ``Unknown``; a NULL number inside a
    present column is NaN. Absent or NULL sensor lists become empty lists.
    """
    present = set(df.columns)
    empty = F.array().cast(T.ArrayType(T.DoubleType()))
    out: list[Column] = [F.col(c) for c in keep]
    lists = T.ArrayType(T.DoubleType())
    leading, *others = codes.SENSOR_COLUMNS.values()
    # the first list present sets the number of sensors
    first = next((c for c in codes.SENSOR_COLUMNS.values() if c in present), None)
    size = F.size(F.coalesce(F.col(first).cast(lists), empty)) if first else F.lit(0)
    for c in (leading, *others):
        absent = F.array_repeat(F.lit(0.0), size) if c == leading else empty
        out.append((F.coalesce(F.col(c).cast(lists), empty) if c in present else absent).alias(c))
    for c in codes.TRUTH_COLUMNS:
        value = F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if c in present else F.lit(0.0)
        out.append(value.alias(c))
    name = F.col(codes.MORPHOLOGY_COLUMN) if codes.MORPHOLOGY_COLUMN in present else F.lit(codes.UNKNOWN_NAME)
    out.append(name.alias(codes.MORPHOLOGY_COLUMN))
    return df.select(*out, size.cast("long").alias("num_sensors"))


def parse_file_range(text: str | None) -> tuple[int, int] | None:
    """``"0-500"`` -> (0, 500)."""
    if text is None:
        return None
    start, _, end = text.partition("-")
    return int(start), int(end)


def file_table(df: DataFrame, file: str = "file_path", within: Sequence[str] = ()) -> DataFrame:
    """Distinct files numbered in path order (``file_no``); one row per file."""
    order = Window.partitionBy(*within).orderBy(file)
    return df.select(*within, file).distinct().withColumn("file_no", F.row_number().over(order) - 1)


def _digest(seed: int, text: str) -> str:
    """``seeded_hash`` of one path."""
    return hashlib.md5(f"{seed}-{text}".encode()).hexdigest()


def choose_range(files: Sequence[str], start: int, end: int) -> list[str]:
    """Files at positions ``[start, end)`` in path order, to be scanned alone."""
    return sorted(files)[start:end]


def choose_per_dir(files: Sequence[str], n: int, seed: int = 42) -> list[str]:
    """At most ``n`` seeded-random files of every directory, in path order."""
    by_dir: dict[str, list[str]] = {}
    for file in files:
        by_dir.setdefault(file.rpartition("/")[0], []).append(file)
    return sorted(f for own in by_dir.values() for f in sorted(own, key=lambda f: (_digest(seed, f), f))[:n])


def choose_split(files: Sequence[str], val: float = 0.1, seed: int = 42) -> tuple[list[str], list[str]]:
    """Train and val files: ``int(n * (1 - val))`` of them train."""
    shuffled = sorted(files, key=lambda f: (_digest(seed, f), f))
    n_train = int(len(shuffled) * (1.0 - val))
    return sorted(shuffled[:n_train]), sorted(shuffled[n_train:])


def choose_mix(files: Sequence[str], recipe: Sequence[Source]) -> dict[str, list[str]]:
    """Files of every recipe entry by its name; the first entry whose folder is in a path has the file."""
    chosen: dict[str, list[str]] = {s.name: [] for s in recipe}
    for file in sorted(files):
        entry = next((s for s in recipe if s.folder in file.split("/")), None)
        if entry:
            chosen[entry.name].append(file)
    return {s.name: chosen[s.name] if s.files is None else chosen[s.name][slice(*s.files)] for s in recipe}


def file_range(df: DataFrame, start: int, end: int, file: str = "file_path") -> DataFrame:
    """Rows of the files at positions ``[start, end)`` in path order."""
    chosen = file_table(df, file).where((F.col("file_no") >= start) & (F.col("file_no") < end))
    return df.join(ordering.broadcast_if_short(chosen), file, "left_semi")


def limit_per_file(df: DataFrame, n: int | None, file: str = "file_path", row: str = "row_index") -> DataFrame:
    """The first ``n`` rows of every file; with real scans ``row`` is the metadata index."""
    return df if n is None else df.where(F.col(row) < n)


def first_rows_per_file(df: DataFrame, n: int | None, order: Sequence[str], file: str = "file_path") -> DataFrame:
    """As ``limit_per_file`` where only an order is known; Spark keeps n per file map-side."""
    if n is None:
        return df
    rank = F.row_number().over(Window.partitionBy(file).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def sample_files_per_dir(
    df: DataFrame, n: int, seed: int = 42, directory: str = "dir", file: str = "file_path"
) -> DataFrame:
    """Rows of at most ``n`` seeded-random files of every directory."""
    order = Window.partitionBy(directory).orderBy(seeded_hash(seed, F.col(file)), file)
    chosen = (
        df.select(directory, file).distinct()
        .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    )
    return df.join(ordering.broadcast_if_short(chosen), [directory, file], "left_semi")


def union_sources(
    sources: Sequence[DataFrame | None], order: Sequence[str], levels: Sequence[Column] = ()
) -> DataFrame:
    """Concatenate sources and number events by source, inside the source and overall.

    ``None`` stands for a missing source and is skipped; its number is not used.
    ``levels`` coarsen ``order`` so that no source has to fit in one task.
    """
    given = [s for s in sources if s is not None]
    if not given:
        raise ValueError("no events: every source is missing")
    parts = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(given)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    if union.isEmpty():
        raise ValueError("no events: every source is empty")
    names = [f"_l{i}" for i in range(len(levels))]
    per_source = union.groupBy("source_no").agg(F.count("*").alias("_n"))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_source.select("source_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if levels:
        leveled = union.withColumns(dict(zip(names, levels)))
        local = ordering.row_positions(leveled, "local_idx", names, [F.col(c) for c in order], ["source_no"])
    else:
        local = ordering.number_rows(union, ["source_no"], order, "local_idx")
    return (
        local.join(F.broadcast(starts), "source_no")
        .withColumn("global_idx", F.col("_start") + F.col("local_idx"))
        .drop("_start", *names)
    )


@dataclass(frozen=True)
class Source:
    """One entry of a training recipe."""

    name: str
    folder: str
    files: tuple[int, int] | None = None
    starting_only: bool = False


# --- fixed values: the standard recipe -------------------------------------------
STANDARD_MIX = (
    Source("nugen_21217", "21217"),
    Source("nugen_21218", "21218"),
    Source("nugen_21219", "21219"),
    Source("muongun_21315", "21315", files=(0, 500)),
    Source("muongun_21317", "21317", files=(0, 500)),
    Source("muongun_21318", "21318", files=(0, 500)),
    Source("muongun_21316_extended", "21316_extended", files=(0, 500)),
    Source("siren_charms_starting", "SIREN_charms_nue", starting_only=True),
    Source("siren_inclusive_starting", "SIREN_inclusive_nue", starting_only=True),
    Source("nugen_22663_starting", "22663", starting_only=True),
)


def training_mix(
    df: DataFrame,
    recipe: Sequence[Source],
    file: str = "file_path",
    morphology: str = codes.MORPHOLOGY_COLUMN,
) -> DataFrame:
    """Select events by recipe and name their source in ``source``.

    A file belongs to the entry whose folder is a component of its path. File ranges
    count the files of the entry in path order.
    """
    entry = F.coalesce(*[
        F.when(F.array_contains(F.split(F.col(file), "/"), s.folder), F.lit(i)) for i, s in enumerate(recipe)])
    files = (
        df.select(file).distinct().withColumn("_entry", entry).where(F.col("_entry").isNotNull())
        .withColumn("_no", F.row_number().over(Window.partitionBy("_entry").orderBy(file)) - 1)
    )
    in_range = F.lit(False)
    for i, s in enumerate(recipe):
        span = F.lit(True) if s.files is None else F.col("_no").between(s.files[0], s.files[1] - 1)
        in_range = in_range | ((F.col("_entry") == i) & span)
    chosen = files.where(in_range).select(
        file,
        codes.lookup({i: s.name for i, s in enumerate(recipe)}, F.col("_entry"), "").alias("source"),
        codes.lookup({i: s.starting_only for i, s in enumerate(recipe)}, F.col("_entry"), False).alias("_only"))
    return (
        df.join(ordering.broadcast_if_short(chosen), file)
        .where(~F.col("_only") | F.col(morphology).isin(*codes.STARTING_NAMES))
        .drop("_only")
    )
