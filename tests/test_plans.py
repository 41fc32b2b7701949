"""Ordering, lookup, quantiles and bins, with block sizes that force the distributed paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtlake.functions.expr import softmax
from evtlake.plans import binning, lookup, ordering, quantiles
from evtlake.plans.quantiles import exact_quantiles


def column(df, *names):
    return [tuple(r) for r in df.select(*names).orderBy(*names).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows and more share key 0."""
    return spark.range(1000).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 50).alias("k"), "id",
        (F.col("id") * 37 % 1009).alias("o"))


def test_number_rows_hot_keys(spark, skewed):
    plain = ordering.number_rows(skewed, ["k"], ["o"])
    blocked = ordering.number_rows(skewed, ["k"], ["o"], hot_rows=30)
    assert column(plain, "k", "o", "pos") == column(blocked, "k", "o", "pos")
    assert plain.where("k = 0").agg(F.max("pos")).first()[0] == skewed.where("k = 0").count() - 1


def test_running_totals_levels(spark, skewed):
    df = skewed.withColumns({"l1": F.expr("o div 100"), "l2": F.expr("o div 10")})
    out = ordering.running_totals(
        df, {"before": F.col("id"), "seen": F.lit(1)}, ["l1", "l2"], [F.col("o")], ["k"]).toPandas()
    for _, group in out.sort_values("o").groupby("k"):
        assert (group.before == group.id.cumsum() - group.id).all()
        assert (group.seen == np.arange(len(group))).all()
    whole = ordering.running_total(df, "s", F.col("id"), ["l2"], [F.col("o")], inclusive=True).toPandas().sort_values("o")
    assert (whole.s == whole.id.cumsum()).all()


def test_hash_cutoff(spark):
    df = spark.range(777).select(F.md5(F.col("id").cast("string")).alias("h"))
    hashes = sorted(r.h for r in df.collect())
    for rank in (0, 1, 400, 776):
        cut = ordering.hash_cutoff(df, "h", F.lit(rank), digits=1)
        assert spark.range(1).select(cut).first()[0] == hashes[rank]
    assert spark.range(1).select(ordering.hash_cutoff(df, "h", F.lit(777))).first()[0] is None


def test_interval_lookup(spark):
    # one interval covers a third of the axis, one is empty, and there is a gap
    bounds = [(0, 5), (5, 5), (5, 40), (40, 41), (60, 61), (61, 100)]
    intervals = spark.createDataFrame([(i, f, a, b) for f in (0, 1) for i, (a, b) in enumerate(bounds)], "i int, f int, a long, b long")
    points = spark.range(-3, 110).select(F.col("id").alias("p"), (F.col("id") % 2).cast("int").alias("f"))
    expected = [(p, i) for p in range(-3, 110) for i, (a, b) in enumerate(bounds) if a <= p < b]
    for block in (4, 1000):
        out = lookup.interval_lookup(points, "p", intervals, "a", "b", block, ["f"])
        assert column(out, "p", "i") == sorted(expected)


@pytest.mark.parametrize("method,small", [("linear", 100), ("lower", 100), ("linear", 0)])
def test_exact_quantiles(spark, method, small, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_KEYS", small)
    rng = np.random.default_rng(5)
    groups = {
        1: rng.normal(size=4000), 2: np.full(500, 3.0), 3: np.array([1.0, 2.0]), 4: np.array([7.5]),
        5: np.concatenate([np.zeros(900), rng.normal(size=1100)]), 6: np.array([1.0, 2.0, 3.0, 10.0])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs]
    rows += [(1, float("nan")), (1, float("inf")), (1, None), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    found = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"], method, stats=[F.sum("k").alias("s")]).collect()}
    for k, xs in groups.items():
        expected = np.quantile(xs, list(probs.values()), method=method)
        assert np.allclose([found[k][n] for n in probs], expected, rtol=1e-12), k
    assert found[9].c is None and found[9].s == 9
    flat = exact_quantiles(df.where("k = 6"), "v", {"m": 0.5}, method=method).first()
    assert flat.m == (2.5 if method == "linear" else 2.0)


def test_quantiles_of_all_kinds_of_doubles(spark):
    values = [-1e308, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0 + 2 ** -52, 1e308]
    df = spark.createDataFrame([(x,) for x in values * 3], "v double")
    probs = {f"q{i}": i / 29 for i in range(30)}
    row = exact_quantiles(df, "v", probs, method="lower").first()
    assert [row[n] for n in probs] == sorted(values * 3)
    plan = exact_quantiles(df, "v", {"m": 0.5}, few=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    empty = exact_quantiles(df.where("v > 1e308"), "v", {"m": 0.5}, stats=[F.count("v").alias("n")]).first()
    assert empty.m is None and empty.n == 0


@pytest.mark.parametrize("bins", [1, 7, 50])
def test_bins_follow_numpy(spark, bins):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=300), np.round(rng.uniform(0, 1, 300), 2), np.full(20, 2.0), np.linspace(0, 1, bins + 1)):
        df = spark.createDataFrame([(float(x),) for x in values] + [(float("nan"),), (None,)], "v double")
        ends = binning.span(df, "v")
        placed = binning.with_bin(df.withColumn("e", ends), "v", "e", bins, "bin").groupBy("bin").count()
        out = binning.fill_grid(placed, binning.grid(df, bin=bins), ["bin"], ["count"]).orderBy("bin").collect()
        assert [r["count"] for r in out] == np.histogram(values, bins)[0].tolist()


def test_sorted_blocks_are_ordered(spark, skewed):
    ends = ordering.sorted_blocks(skewed.select("o"), [F.col("o").desc()]).groupBy("_blk").agg(
        F.min("o").alias("lo"), F.max("o").alias("hi")).orderBy("_blk").collect()
    assert all(a.lo > b.hi for a, b in zip(ends, ends[1:]))


def test_rows_with_null_keys_and_levels_are_kept(spark):
    rows = [(f, b, i) for f in ("a", None, "b") for b in (0, None, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "file string, block int, i int")
    out = ordering.row_positions(df, "pos", ["file", "block"], [F.col("i")]).collect()
    assert sorted(r.pos for r in out) == list(range(27))
    assert [(r.file, r.block) for r in sorted(out, key=lambda r: r.pos)][:4] == [(None, None)] * 3 + [(None, 0)]
    keyed = ordering.row_positions(df, "pos", ["block"], [F.col("i")], keys=["file"]).collect()
    assert sorted(r.pos for r in keyed if r.file is None) == list(range(9))


def test_softmax_of_many_classes(spark):
    out = spark.range(2000).select(softmax(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: (i % 7).cast("double"))).alias("p")).select(
        F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(out[0] - 1) < 1e-9 and abs(out[1] - 1) < 1e-9


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 20)
    rows = spark.range(900).selectExpr("id % 70 as k", "id as o")
    numbered = ordering.number_rows(rows, ["k"], ["o"])
    assert numbered.rdd.getNumPartitions() == 45 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.k, r.o): r.pos for r in numbered.collect()} == {(i % 70, i): i // 70 for i in range(900)}


def test_running_total_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 50)
    sizes = [(i * 7) % 5 for i in range(300)]
    files_ = [f"f{i // 100}" if i % 50 else None for i in range(300)]
    rows = spark.createDataFrame([(files_[i], i // 10, i, sizes[i]) for i in range(300)], "f string, b int, i int, n int").repartition(7)
    order = sorted(range(300), key=lambda i: (files_[i] is not None, files_[i] or "", i // 10, i))
    expected, at = {}, 0
    for i in order:
        expected[i], at = at, at + sizes[i]
    for few in (100_000, 0):
        monkeypatch.setattr(ordering, "BROADCAST_KEYS", few)
        found = ordering.running_total_in_ranges(rows, "at", F.col("n"), ["f", "b"], [F.col("i")])
        assert {r.i: r["at"] for r in found.collect()} == expected
        runs = found.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("n")).alias("z"), F.sum("n").alias("n")).orderBy("a").collect()
        assert len(runs) > 5 and all(r.z - r.a == r.n for r in runs)


def test_raw_columns_are_moved(spark):
    """What is computed of a sensor is computed where it is needed, not before rows are sorted and moved."""
    from evtlake.surrogate import views
    for df in (views.sensors, views.group_points, views.supplier_points):
        plan = df(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "c_100ns" not in plan[plan.index("Window"):]
