"""Running totals, positions and cut-offs without a single-task window.

A window needs all rows of its partition in one task. Here an ordering is cut into
blocks first: totals per block are aggregated map-side, the short list of blocks is
accumulated, and only rows of one block meet in one task. Blocks come from ordered
coarse columns of the data (``levels``) or, where no such column bounds the block
size, from a range partitioning that is checkpointed so that it is computed once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

HASH_DIGITS = 3
HOT_ROWS = 1_000_000
BROADCAST_KEYS = 100_000
#: Rows that one task sorts at a time, about.
ROWS_PER_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if configured is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="evtlake-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/evtlake/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back, for plans that read it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_short(df: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``rows`` rows; beyond that it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` to tasks of ROWS_PER_TASK rows or so, where its ``rows`` are too many for the usual number of tasks.

    A sort then stays in memory whatever ``spark.sql.shuffle.partitions`` says, and windows, groups and
    joins by the keys move nothing further. Fewer rows are left to Spark.
    """
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def null_safe_join(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on ``columns`` where NULL equals NULL; the columns come from the left."""
    other = right.withColumnsRenamed({c: f"_eq_{c}" for c in columns})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_eq_{c}")) for c in columns])
    return left.join(other, on).drop(*[f"_eq_{c}" for c in columns])


def block_starts(totals: DataFrame, names: Sequence[str], levels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``_o_`` columns: the sums of ``totals`` (keys, levels, names) over all earlier blocks of the same keys."""
    keys, levels, offsets = list(keys), list(levels), None
    for depth in range(1, len(levels) + 1):
        parent, here = keys + levels[: depth - 1], keys + levels[:depth]
        level = totals if depth == len(levels) else totals.groupBy(*here).agg(
            *[F.sum(n).alias(n) for n in names])
        before = Window.partitionBy(*parent).orderBy(levels[depth - 1]).rowsBetween(
            Window.unboundedPreceding, -1)
        level = level.select(*here, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
        if offsets is not None:
            above = offsets.withColumnsRenamed({f"_o_{n}": f"_p_{n}" for n in names})
            level = null_safe_join(level, above, parent).select(
                *here, *[(F.col(f"_o_{n}") + F.col(f"_p_{n}")).alias(f"_o_{n}") for n in names])
        offsets = level
    return offsets


def running_totals(
    df: DataFrame,
    values: Mapping[str, Column],
    levels: Sequence[str],
    order: Sequence[Column],
    keys: Sequence[str] = (),
    inclusive: bool = False,
) -> DataFrame:
    """Add one column per entry of ``values``: its sum over all earlier rows of the same ``keys``.

    ``levels`` coarsen ``order``: sorting by the levels and then by ``order`` is the
    intended order, NULL first. A NULL key or level is a value like any other. Every
    combination of keys and levels is one block, and must be small enough for one task.
    """
    keys, levels, names = list(keys), list(levels), list(values)
    valued = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = valued.groupBy(*keys, *levels).agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    offsets = block_starts(totals, names, levels, keys)
    within = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    summed = {n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in names}
    return null_safe_join(valued, offsets, keys + levels).withColumns(summed).drop(
        *[f"_{k}_{n}" for n in names for k in "vo"])


def running_total(df, out: str, value: Column, levels, order, keys=(), inclusive: bool = False) -> DataFrame:
    """``running_totals`` of one column."""
    return running_totals(df, {out: value}, levels, order, keys, inclusive)


def running_total_in_ranges(df: DataFrame, out: str, value: Column, levels: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``running_total`` of whole numbers, with the rows dealt by ranges of it: every partition is one run of ``out``.

    ``value`` is what a row stands for, and ROWS_PER_TASK of it go to a task. The rows are moved once:
    where blocks begin is known from their totals, and is broadcast where the blocks are few.
    """
    levels, valued = list(levels), df.withColumn("_v", value)
    totals = cut_lineage(valued.groupBy(*levels).agg(F.sum("_v").alias(out)))
    size = totals.agg(F.coalesce(F.sum(out), F.lit(0))).first()[0]
    placed = null_safe_join(valued, broadcast_if_short(block_starts(totals, [out], levels)), levels)
    tasks = max(-(-size // ROWS_PER_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = f"_o_{out}"
    within = Window.partitionBy(start, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.repartitionByRange(tasks, start).withColumn(
        out, F.col(start) + F.coalesce(F.sum("_v").over(within), F.lit(0))).drop("_v", start)


def row_positions(df: DataFrame, out: str, levels, order, keys=()) -> DataFrame:
    """0-based position of every row in the order (levels, order), per ``keys``."""
    return running_total(df, out, F.lit(1).cast("long"), levels, order, keys)


def sorted_blocks(df: DataFrame, order: Sequence[Column], out: str = "_blk") -> DataFrame:
    """Cut a global order of distinct rows into equal blocks, numbered in ``out``.

    Spark samples the range bounds, so the block number is checkpointed: later passes
    must see the same blocks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(
        df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "pos",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position of every row among the rows of its key.

    One window does it, except for keys of more than ``hot_rows`` rows, NULL among them,
    which are cut into sorted blocks. One map-side aggregated count finds out whether there are any,
    and how many tasks the rows need.
    """
    keys, order = list(keys), list(order)
    counts = df.groupBy(*keys).count()
    rows, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    plain = Window.partitionBy(*keys).orderBy(*order)
    number = (F.row_number().over(plain) - 1).cast("long")
    if most <= hot_rows:
        return spread(df, rows, *keys).withColumn(out, number)
    hot = counts.where(F.col("count") > hot_rows).select(*keys)
    hot = broadcast_if_short(cut_lineage(hot).withColumnsRenamed({k: f"_hot_{k}" for k in keys}))  # a shuffle by key would gather the very rows to be spread
    is_hot = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    cold_rows = spread(df.join(hot, is_hot, "left_anti"), rows, *keys).withColumn(out, number)
    hot_part = sorted_blocks(df.join(hot, is_hot, "left_semi"), [F.col(c) for c in keys + order])
    hot_part = row_positions(hot_part, out, ["_blk"], [F.col(c) for c in order], keys).drop("_blk")
    return cold_rows.unionByName(hot_part)


def hash_levels(df: DataFrame, digest: str = "_h", digits: int = HASH_DIGITS) -> DataFrame:
    """Add ``_hb``, the leading digits of a hex digest, as an even block column."""
    return df.withColumn("_hb", F.substring(F.col(digest), 1, digits))


def hash_cutoff(df: DataFrame, digest: str, rank: Column, digits: int = 4) -> Column:
    """The digest at 0-based ``rank`` as a scalar, NULL when there are not that many rows.

    Block counts tell which block holds the rank; only that block is sorted. Callers
    then split rows by comparing digests, without moving any row.
    """
    blocks = df.groupBy(F.substring(digest, 1, digits).alias("_hb")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_hb"))
    target = (
        blocks.withColumn("_upto", upto).withColumn("_rank", rank)
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        .select("_hb", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_at"))
    )
    inside = (
        df.withColumn("_hb", F.substring(digest, 1, digits))
        .join(F.broadcast(target), "_hb")
        .withColumn("_i", F.row_number().over(Window.partitionBy("_hb").orderBy(digest)) - 1)
    )
    return inside.where(F.col("_i") == F.col("_at")).agg(F.max(digest)).scalar()
