"""What several operators of this package need: stored intermediate tables and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evtlake.plans.ordering import scratch_path

#: A key is hot when it holds more than this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back: lineage ends, and its size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def release(table: DataFrame) -> None:
    """Delete what ``stored`` wrote as ``table``, when all that was made of it is stored itself."""
    hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table.stored_at)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality in all ``columns`` where NULL equals NULL."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in columns])


def add_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join ``rows`` with ``facts``, one row per ``key`` (NULL is a key); a key may hold a third of all rows.

    ``weight`` is the number of rows per key. Keys above HOT_SHARE of all rows are at
    most 1000 and are broadcast; their rows are spread by ``spread`` (any column that
    differs from row to row) over the shuffle that serves all other keys.
    """
    total = facts.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) >= F.greatest(total * HOT_SHARE, F.lit(1))
    values = [c for c in facts.columns if c not in (key, weight)]
    hot = facts.where(is_hot).select(F.col(key).alias("_hk"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    rest = facts.where(~is_hot).select(F.col(key).alias("_rk"), F.lit(0).alias("_rs"), *[F.col(c).alias(f"_r_{c}") for c in values])
    marked = rows.join(F.broadcast(hot), rows[key].eqNullSafe(F.col("_hk")), "left").withColumn(
        "_salt", F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(4096))).otherwise(0).cast("int"))
    joined = marked.join(rest, F.col(key).eqNullSafe(F.col("_rk")) & (F.col("_salt") == F.col("_rs")), "left")
    return joined.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_r_{c}")).alias(c) for c in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
