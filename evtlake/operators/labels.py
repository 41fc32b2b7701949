"""Codes, classes, labels and row filters of events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evtlake.functions import codes
from evtlake.functions.expr import finite, log_energy

# first path component of five digits, alone or followed by an underscore
DATASET_PATTERN = r"(?:^|/)([0-9]{5})(?:_[^/]*)?(?=/|$)"


def dataset_id_from_path(path: Column) -> Column:
    found = F.regexp_extract(path, DATASET_PATTERN, 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def morphology_codes(df: DataFrame, name: str = codes.MORPHOLOGY_COLUMN) -> DataFrame:
    """Add ``morphology`` (topology), ``morphology_raw`` and ``starting``."""
    return df.withColumns({
        "morphology": codes.lookup(codes.TOPOLOGY_CODES, F.col(name), codes.UNKNOWN_CODE),
        "morphology_raw": codes.lookup(codes.RAW_CODES, F.col(name), codes.UNKNOWN_CODE),
        "starting": F.coalesce(F.col(name).isin(*codes.STARTING_NAMES), F.lit(False)),
    })


def class_label(key: Column, mapping: Mapping | None, policy: str) -> Column:
    """Class of an event by mapping.

    ``nested`` keys are names, and both absent names and names mapped to -1 give 0.
    ``flat`` keys are raw codes, absent codes give 0 and -1 stays, meaning "ignore";
    an empty mapping falls back to the default one.
    """
    if policy == "nested":
        table = codes.DEFAULT_NAMED_CLASSES if mapping is None else mapping
        found = codes.lookup({k: int(v) for k, v in table.items()}, key, -1) if table else F.lit(-1)
        return F.when(found == -1, 0).otherwise(found)
    if policy == "flat":
        return codes.lookup({k: int(v) for k, v in (mapping or codes.DEFAULT_CLASSES).items()}, key, 0)
    raise ValueError(f"unknown policy {policy!r}")


def raw_index(name: Column, mapping: Mapping | None, policy: str) -> Column:
    """Raw index of a name: rank among the mapping's names (``nested``) or fixed code (``flat``)."""
    if policy == "flat":
        return codes.lookup(codes.RAW_CODES, name, codes.UNKNOWN_CODE)
    return codes.lookup(codes.name_ranks(mapping), name, -1) if mapping else F.lit(-1)


def label_vector(
    df: DataFrame,
    mapping: Mapping | None,
    policy: str,
    vertex: str | None = None,
    rescale: bool = False,
) -> DataFrame:
    """Add ``labels``: log energy, direction, class, raw index and, on request, the vertex."""
    name = F.col(codes.MORPHOLOGY_COLUMN)
    raw = raw_index(name, mapping, policy)
    cls = class_label(name if policy == "nested" else raw, mapping, policy)
    parts = [
        log_energy(F.col("mc_primary_energy"), policy),
        *[F.col(c) for c in codes.TRUTH_COLUMNS[1:]],
        cls, raw,
    ]
    if vertex:
        scale = 1e-3 if rescale and policy == "nested" else 1.0
        parts += [F.get(F.col(vertex), F.lit(i)) * scale for i in range(3)]
    return df.withColumn("labels", F.array(*[p.cast("double") for p in parts]))


def starting_only(df: DataFrame, name: str = codes.MORPHOLOGY_COLUMN) -> DataFrame:
    return df.where(F.col(name).isin(*codes.STARTING_NAMES))


def drop_empty_events(df: DataFrame, size: Column) -> tuple[DataFrame, DataFrame]:
    """Events with sensors, and a one-row report of how many were kept and dropped."""
    report = df.agg(
        F.count_if(size > 0).alias("kept"),
        F.count_if(F.coalesce(size, F.lit(0)) <= 0).alias("dropped"))
    return df.where(size > 0), report


def event_lookup(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Metadata of chosen events with the morphology name restored from its code."""
    names = codes.lookup(codes.names_by_code(), F.col("morphology_raw"), codes.UNKNOWN_NAME)
    return index.join(wanted.select(key).distinct(), key, "left_semi").withColumn("morphology_name", names)


def finite_only(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose metric columns are all finite, and a one-row report."""
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(finite(F.col(c)), F.lit(False))
    report = df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))
    return df.where(good), report
