"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded column under its own name; engines differ in the last bits of a double."""
    return F.round(column, digits).alias(name or column)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, and widen small integers for the comparison."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(F.round(F.col(f.name).cast("double"), special.get(f.name, digits)).alias(f.name))
        elif kind in ("int", "tinyint", "smallint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
