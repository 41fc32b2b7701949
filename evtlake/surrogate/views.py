"""Event, sensor and prediction views over the order tables.

Expressions are plain SQL that Spark and the oracle engine read alike; the oracle uses
them as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from evtlake.functions import codes
from evtlake.operators import nested
from evtlake.plans import ordering

_DIR = ("CASE o_orderstatus WHEN 'F' THEN '/data/v1/21217/' "
        "WHEN 'O' THEN '/data/v2/21316_extended/' ELSE '/data/charm/' END")
_Z = "((o_orderkey % 1000)/999.0e0*2-1)"
_PHI = "(((o_orderkey*7) % 360)*pi()/180)"
EVENT = {
    "event_id": "o_orderkey",
    "group_id": "o_custkey",
    "mc_primary_energy": "CAST(o_totalprice*4 AS DOUBLE)",
    "mc_primary_dir_x": f"sqrt(1-{_Z}*{_Z})*cos({_PHI})",
    "mc_primary_dir_y": f"sqrt(1-{_Z}*{_Z})*sin({_PHI})",
    "mc_primary_dir_z": _Z,
    "mc_event_morphology": (
        "CASE WHEN o_orderkey % 97 = 0 THEN 'Mystery' ELSE CASE o_orderkey % 9 WHEN 0 THEN '0T0C' "
        "WHEN 1 THEN '0T1C' WHEN 2 THEN '0TnC' WHEN 3 THEN '1T0C' WHEN 4 THEN '1T1C' WHEN 5 THEN '1TnC' "
        "WHEN 6 THEN '2TnC' WHEN 7 THEN 'Background' ELSE 'BackGround' END END"),
    "dir": _DIR,
    "file_path": f"CONCAT({_DIR}, 'part_', CAST(o_custkey % 20 AS VARCHAR(10)), '.parquet')",
    "o_orderpriority": "o_orderpriority",
}
_T = "((year(l_shipdate)-1995)*372.0e0 + month(l_shipdate)*31 + day(l_shipdate))"
SENSOR = {
    "x": "l_quantity",
    "y": "l_discount*100",
    "z": "l_tax*100",
    "t_first": _T,
    "t_last": f"{_T} + l_linenumber",
    "t20": f"{_T} + 0.2e0*l_linenumber",
    "t50": f"{_T} + 0.5e0*l_linenumber",
    "t_mean": f"{_T} + 0.6e0*l_linenumber",
    "t_std": f"{_T} + 0.3e0*l_linenumber",
    "c_total": "l_extendedprice",
    "c_500ns": "l_extendedprice*(1-l_discount)",
    "c_100ns": "l_extendedprice*(1-l_discount)*(1-l_tax)",
}
TIE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
#: The columns that SENSOR is made of. They are moved, and SENSOR is computed where it is needed.
RAW = ("l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
PREDICTION = {
    "event_id": "event_id", "mc_event_morphology": "mc_event_morphology", "group_id": "group_id", "dir": "dir",
    "true_log_energy": "log10(greatest(mc_primary_energy,1e-6))",
    "pred_log_energy": "log10(greatest(mc_primary_energy,1e-6)) + (((event_id*37) % 101)-50)/100.0e0",
    "raw_sigma": "(((event_id*13) % 41)-20)/10.0e0",
    "mc_primary_dir_x": "mc_primary_dir_x", "mc_primary_dir_y": "mc_primary_dir_y",
    "mc_primary_dir_z": "mc_primary_dir_z",
    "pred_x": "(mc_primary_dir_x + 0.05e0 + (((event_id*11) % 23)-11)/40.0e0)*(1+(event_id % 7))",
    "pred_y": "(mc_primary_dir_y - 0.03e0 + (((event_id*17) % 29)-14)/40.0e0)*(1+(event_id % 7))",
    "pred_z": "(mc_primary_dir_z + 0.02e0 + (((event_id*19) % 31)-15)/40.0e0)*(1+(event_id % 7))",
    "logit_0": "((event_id*3) % 17)/5.0e0",
    "logit_1": ("((event_id*5) % 19)/5.0e0 + CASE WHEN mc_event_morphology IN "
                "('0T1C','0TnC','1T1C','1TnC','2TnC') THEN 1.0e0 ELSE 0.0e0 END"),
}
EVENT_BLOCK = 4096  # consecutive event ids that form one ordering block


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def _cte(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_select(columns))} FROM {source}"


CTES = {
    "ev": _cte(EVENT, "orders"),
    "se": ("SELECT l_orderkey AS event_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY "
           f"{','.join(TIE)})-1 AS BIGINT) AS pos, {', '.join(_select(SENSOR))} FROM lineitem"),
    "pr": _cte(PREDICTION, "ev"),
    "ec": ("SELECT ev.*, coalesce(s.num_sensors,0) AS num_sensors, coalesce(s.total_charge,0) AS total_charge "
           "FROM ev LEFT JOIN (SELECT l_orderkey AS event_id, count(*) AS num_sensors, sum(l_extendedprice) AS "
           "total_charge FROM lineitem GROUP BY 1) s USING (event_id)"),
    "gp": ("SELECT ev.group_id, CAST(row_number() OVER (PARTITION BY ev.group_id ORDER BY se.event_id, se.pos)-1 "
           "AS BIGINT) AS pos, se.x, se.y, se.z, se.t_first AS t, se.c_total, se.c_500ns, se.t_last "
           "FROM se JOIN ev USING (event_id)"),
}
CTES["sp"] = ("SELECT l_suppkey AS group_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate)-1 "
              f"AS BIGINT) AS pos, {SENSOR['x']} AS x, {SENSOR['y']} AS y, {SENSOR['z']} AS z, {SENSOR['t_first']} AS t, {SENSOR['c_total']} AS c_total, "
              f"{SENSOR['c_500ns']} AS c_500ns, {SENSOR['t_last']} AS t_last FROM lineitem")
_NEEDS = {"pr": ["ev"], "ec": ["ev"], "gp": ["ev", "se"]}


def sql(body: str, *views: str, **extra: str) -> str:
    """Oracle text: the named views, further CTEs in order, then the body."""
    used: dict[str, str] = {}
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            used[name] = CTES[name]
    used |= extra
    recursive = "RECURSIVE " if any(f"FROM {n} " in q and "UNION ALL" in q for n, q in extra.items()) else ""
    ctes = ", ".join(f"{n} AS ({q})" for n, q in used.items())
    return f"WITH {recursive}{ctes} {body}" if ctes else body


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*_select(EVENT))


def sensor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors with their order columns but without positions."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey AS event_id", *TIE, *_select(SENSOR))


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors before anything is computed of them: what is moved between tasks."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("event_id"), *dict.fromkeys([*TIE, *RAW]))


def sensors(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.number_rows(raw_rows(spark, sf), ["event_id"], TIE).selectExpr("event_id", *_select(SENSOR), "pos")


def events_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    return nested.with_event_stats(events(spark, sf), sensor_rows(spark, sf))


def raw_nested(spark: SparkSession, sf: str, chunk: int = nested.CHUNK) -> DataFrame:
    """Rows of orders with lists of the RAW columns of their sensors; giant events continue in further rows."""
    numbered = ordering.number_rows(raw_rows(spark, sf), ["event_id"], TIE)
    lists = nested.nest_points(numbered, "event_id", {c: c for c in RAW}, chunk=chunk)
    found = spark.read.parquet(f"{sf}/orders.parquet").join(lists, F.col("o_orderkey") == F.col("event_id"), "left")
    return found.drop("event_id").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("long")))


def computed(rows: DataFrame, chunk: int = nested.CHUNK) -> DataFrame:
    """``raw_nested`` rows as events with their sensor lists."""
    of_point = lambda e: re.sub(r"\bl_\w+", r"p.\g<0>", e)
    lists = [f"coalesce(transform(_points, p -> {of_point(SENSOR[f])}), cast(array() AS array<double>)) AS {c}" for f, c in codes.SENSOR_COLUMNS.items()]
    return rows.withColumn("_points", F.arrays_zip(*RAW)).selectExpr(*_select(EVENT), "chunk", *lists, f"chunk * {chunk} AS first_pos")


def nested_events(spark: SparkSession, sf: str, chunk: int = nested.CHUNK) -> DataFrame:
    """One row per event with its sensor lists; giant events continue in further rows."""
    return computed(raw_nested(spark, sf, chunk), chunk)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    labelled = events(spark, sf).drop("file_path", "o_orderpriority")
    rows = stored(stored(labelled).selectExpr(*_select(PREDICTION)))
    return rows.withColumn("logits", F.array("logit_0", "logit_1"))


def stored(df: DataFrame) -> DataFrame:
    """Let a view behave like a stored table: its expressions are evaluated once per row.

    Otherwise every filter on a derived column is pushed below the view with all of the
    view's nested expressions inlined in it.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def group_points(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors of all events of a customer as one cloud."""
    rows, owner = raw_rows(spark, sf), events(spark, sf).select("event_id", "group_id")
    n = rows.count()
    owned = ordering.spread(rows, n, "event_id").join(ordering.spread(owner, n, "event_id"), "event_id")
    return _points(ordering.number_rows(owned, ["group_id"], ["event_id", *TIE]))


def supplier_points(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors of a supplier as one cloud: several hundred points each."""
    rows = raw_rows(spark, sf).withColumnRenamed("l_suppkey", "group_id")
    return _points(ordering.number_rows(rows, ["group_id"], ["event_id", "l_linenumber", "l_partkey", "l_shipdate"]))


def _points(numbered: DataFrame) -> DataFrame:
    return numbered.selectExpr("event_id", *_select(SENSOR), "group_id", f"{_T} AS t", "pos")


def in_blocks(events: DataFrame) -> DataFrame:
    return events.withColumn("block", F.expr(f"event_id div {EVENT_BLOCK}"))
