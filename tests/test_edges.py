"""Hand-made edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtlake.functions import codes
from evtlake.functions.expr import log_energy, softplus
from evtlake.operators import distributions, evaluation, labels, losses, nested, quality, sampling
from evtlake.plans import ordering
from evtlake.sources import scan, tables

S = codes.SENSOR_COLUMNS
NAN = float("nan")


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def event(event_id, n=3, **changes):
    row = {"event_id": event_id, "file_path": "/d/21217/a.parquet", "mc_primary_energy": 10.0, "mc_primary_dir_x": 0.0,
           "mc_primary_dir_y": 0.0, "mc_primary_dir_z": 1.0, "mc_event_morphology": "0T1C",
           **{c: [float(i + j) for i in range(n)] for j, c in enumerate(S.values())}}
    return row | changes


SCHEMA = ("event_id long, file_path string, mc_primary_energy double, mc_primary_dir_x double, mc_primary_dir_y double, "
          "mc_primary_dir_z double, mc_event_morphology string, " + ", ".join(f"{c} array<double>" for c in S.values()))


def frame(spark, *events):
    return spark.createDataFrame([tuple(e.values()) for e in events], SCHEMA)


def test_paths(spark):
    cases = {
        "/a/21217/f.parquet": 21217, "/a/21316_extended/f.parquet": 21316, "21217/f": 21217, "/a/2121/x": 0,
        "/a/212177/x": 0, "/a/v21217/x": 0, "/a/12345_x_y/67890/f": 12345, "/a/b/21999": 21999, "/a/21217.parquet": 0}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    found = {r.p: r.d for r in df.select("p", labels.dataset_id_from_path(F.col("p")).alias("d")).collect()}
    assert found == cases


def test_log_energy(spark):
    for value, nested_log, flat in ((100.0, 2.0, 2.0), (0.0, -6.0, 0.0), (-5.0, -6.0, 0.0)):
        assert one(spark, log_energy(F.lit(value), "nested")) == pytest.approx(nested_log)
        assert one(spark, log_energy(F.lit(value), "flat")) == pytest.approx(flat)
    assert math.isnan(one(spark, log_energy(F.lit(NAN), "nested")))
    assert one(spark, log_energy(F.lit(NAN), "flat")) == 0.0


def test_classes(spark):
    label = lambda key, mapping, policy: one(spark, labels.class_label(F.lit(key), mapping, policy))
    assert label("zzz", {"a": 3}, "nested") == 0
    assert label("a", {"a": -1}, "nested") == 0
    assert label("Mixed", None, "nested") == 2
    assert label("a", {}, "nested") == 0
    assert label(2, {2: -1}, "flat") == -1
    assert label(5, {2: 1}, "flat") == 0
    assert label(5, {}, "flat") == 1
    assert label(None, {}, "flat") == 0
    assert one(spark, labels.raw_index(F.lit("BackGround"), {"Background": 0, "BackGround": 0}, "nested")) == 0
    assert one(spark, labels.raw_index(F.lit("0T1C"), None, "nested")) == -1
    assert codes.class_names({0: 0, 4: 1, 5: 1, 6: -1}, 3) == ["0T0C", "1T1C+1TnC", "Class 2"]


def test_unknown_morphology(spark):
    row = labels.morphology_codes(spark.createDataFrame([("odd",), (None,)], "mc_event_morphology string")).collect()
    assert [(r.morphology, r.morphology_raw, r.starting) for r in row] == [(-1, -1, False)] * 2


def test_conform_and_explode(spark):
    ragged = frame(spark, event(1, **{S["c_100ns"]: [9.0], S["t20"]: [1.0, 2.0, 3.0, 4.0], S["t50"]: None}),
                   event(2, 0), event(3, **{S["x"]: None}), event(4, mc_primary_energy=None, **{S["y"]: [1.0, None, 2.0]}))
    rows = nested.explode_sensors(scan.conform_columns(ragged, ["event_id"]), ["event_id"]).orderBy("event_id", "pos").collect()
    assert [(r.event_id, r.pos) for r in rows] == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1), (4, 2)]
    assert [r.c_100ns for r in rows[:3]] == [9.0, 0.0, 0.0]
    assert [r.t20 for r in rows[:3]] == [1.0, 2.0, 3.0]
    assert [r.t50 for r in rows[:3]] == [0.0] * 3
    assert math.isnan(rows[4].y)
    conformed = {r.event_id: r for r in scan.conform_columns(ragged, ["event_id"]).collect()}
    assert math.isnan(conformed[4].mc_primary_energy)
    assert conformed[2].num_sensors == 0


def test_absent_columns(spark):
    old = frame(spark, event(1)).drop(S["x"], S["c_total"], codes.MORPHOLOGY_COLUMN, "mc_primary_energy")
    row = scan.conform_columns(old, ["event_id"])
    first = row.first()
    assert first[codes.MORPHOLOGY_COLUMN] == "Unknown" and first.mc_primary_energy == 0.0
    assert [r.x for r in nested.explode_sensors(row, ["event_id"]).collect()] == [0.0] * 3
    bare = frame(spark, event(1)).drop(*S.values())
    assert nested.explode_sensors(scan.conform_columns(bare, ["event_id"]), ["event_id"]).count() == 0


def test_tables_round_trip(spark, tmp_path):
    source = frame(spark, event(1), event(2, 0), event(3, 2, mc_event_morphology="0T0C"), event(4, 1, file_path="/d/x/b.parquet"))
    conformed = scan.conform_columns(source, ["event_id", "file_path"])
    index, sensors = tables.event_tables(conformed, "event_id", "file_path", ["file_path"], ["event_id"])
    tables.write_event_tables(index, sensors, str(tmp_path / "t"))
    index, sensors = tables.read_event_tables(spark, str(tmp_path / "t"))
    rows = {r.event_id: r for r in index.collect()}
    assert set(rows) == {1, 3, 4}
    assert [(rows[i].sensor_start_idx, rows[i].sensor_end_idx) for i in (1, 3, 4)] == [(0, 3), (3, 5), (5, 6)]
    assert (rows[1].dataset_id, rows[4].dataset_id, rows[3].starting) == (21217, 0, False)
    assert dict(index.dtypes)["morphology_raw"] == "tinyint" and dict(sensors.dtypes)["x"] == "float"
    checks = quality.integrity_checks(index, sensors, conformed.where("num_sensors > 0")).first()
    assert (checks.events, checks.sensors, checks.reversed_ranges, checks.orphan_sensors, checks.within_tolerance) == (3, 6, 0, 0, True)
    starting, _ = tables.event_tables(conformed, "event_id", "file_path", ["file_path"], ["event_id"], starting_only=True)
    assert {r.event_id for r in starting.collect()} == {1, 4}
    manifest = tables.dataset_manifest(index, sources=spark.createDataFrame([(21217,), (0,), (99999,)], "dataset_id long"))
    found = {r.dataset_id: (r.events, r.sensors, r.succeeded, r.failed) for r in manifest.collect()}
    assert found == {21217: (2, 5, 1, 0), 0: (1, 1, 1, 0), 99999: (0, 0, 0, 1), None: (3, 6, 2, 1)}


def test_chunked_events_give_the_same_tables(spark):
    from evtlake.surrogate import views
    whole, cut = (views.nested_events(spark, "/root/testdata/sf0.001", chunk) for chunk in (65_536, 2))
    assert cut.count() > whole.count()
    out = []
    for df in (whole, cut):
        conformed = views.in_blocks(scan.conform_columns(df, ["event_id", "file_path", "first_pos"]))
        index, sensors = tables.event_tables(conformed, "event_id", "file_path", ["file_path", "block"], ["event_id"])
        out.append((index, sensors))
    assert out[0][0].exceptAll(out[1][0]).count() == 0
    assert out[0][1].exceptAll(out[1][1]).count() == 0


def test_padding_in_blocks(spark):
    batched = spark.createDataFrame([(1, 0, 0, 7), (2, 0, 1, 0), (3, 0, 2, 3), (4, 1, 0, 2)], "event_id long, batch_id long, event_in_batch long, num_sensors long")
    sensors = batched.select("event_id", F.expr("explode(filter(sequence(0L, num_sensors), x -> x < num_sensors)) as pos"), F.lit(1.5).alias("x"))
    whole, cut = ({tuple(r) for r in nested.pack_padded(batched, sensors, ["x"], block=b).collect()} for b in (65_536, 2))
    assert whole == cut and len(whole) == 3 * 7 + 2
    assert {r.event_id: r.n for r in nested.pack_padded(batched, sensors, ["x"], block=2).where("valid").groupBy("event_id").agg(F.count("*").alias("n")).collect()} == {1: 7, 3: 3, 4: 2}


def test_file_metadata_limit(spark, tmp_path):
    for i in range(3):
        frame(spark, *[event(10 * i + j) for j in range(4 if i else 1)]).coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
    df = scan.scan_events(spark, [str(tmp_path / f"d{i}") for i in range(3)], ["event_id"], file_columns=True)
    assert sorted(r.event_id for r in scan.limit_per_file(df, 2).collect()) == [0, 10, 11, 20, 21]
    assert scan.limit_per_file(df, None).count() == 9


def test_versions_with_absent_columns(spark, tmp_path):
    frame(spark, event(1)).drop(S["t_std"], codes.MORPHOLOGY_COLUMN).write.parquet(str(tmp_path / "old"))
    df = scan.scan_events(spark, [str(tmp_path / "old")], ["event_id"], tolerate_absent=True)
    assert S["t_std"] not in df.columns and scan.conform_columns(df, ["event_id"]).first()[codes.MORPHOLOGY_COLUMN] == "Unknown"


def test_standard_mix(spark):
    paths = ["/m/21217/a.parquet", "/m/21316_extended/b.parquet", "/m/21316/c.parquet", "/m/22663/d.parquet"]
    df = spark.createDataFrame([(p, m) for p in paths for m in ("0T1C", "0T0C")], "file_path string, mc_event_morphology string")
    found = sorted((r.source, r.mc_event_morphology) for r in scan.training_mix(df, scan.STANDARD_MIX).collect())
    assert found == [("muongun_21316_extended", "0T0C"), ("muongun_21316_extended", "0T1C"), ("nugen_21217", "0T0C"),
                     ("nugen_21217", "0T1C"), ("nugen_22663_starting", "0T1C")]


def test_giant_event_meets_its_sensors_in_blocks(spark):
    events = spark.createDataFrame([(1, 10, 0), (2, 3, 1), (3, 0, 2)], "event_id long, num_sensors long, tag int")
    sensors = spark.createDataFrame([(e, p) for e, n in ((1, 10), (2, 3)) for p in range(n)], "event_id long, pos long")
    out = nested.to_sensors(sensors, events.where("num_sensors > 0"), block=4)
    assert sorted((r.event_id, r.pos, r.tag) for r in out.collect()) == [(1, p, 0) for p in range(10)] + [(2, p, 1) for p in range(3)]


def test_file_range_text():
    assert scan.parse_file_range("0-500") == (0, 500)
    assert scan.parse_file_range(None) is None


def test_union_of_nothing(spark):
    with pytest.raises(ValueError):
        scan.union_sources([None], ["event_id"])
    with pytest.raises(ValueError):
        scan.union_sources([spark.range(0).toDF("event_id")], ["event_id"])
    out = scan.union_sources([spark.range(3).toDF("event_id"), spark.range(2).toDF("event_id")], ["event_id"])
    assert sorted((r.source_no, r.local_idx, r.global_idx) for r in out.collect()) == [
        (0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4)]


@pytest.mark.parametrize("n,val", [(1, 0.2), (4, 0.2), (10, 0.2), (99, 0.1), (50, 0.0), (7, 1.0)])
def test_split_sizes(spark, n, val):
    df = spark.range(n).toDF("event_id")
    out = sampling.split_events(df, val, 7)
    sides = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sides.get("val", 0) == int(n * val)
    assert sum(sides.values()) == n
    again = sampling.split_events(df.repartition(3), val, 7)
    assert out.exceptAll(again).count() == 0
    other = sampling.split_events(df, val, 8)
    assert n < 50 or val == 0.0 or out.exceptAll(other).count() > 0


def test_explicit_file_lists(spark):
    df = spark.createDataFrame([("/a/1.parquet",), ("/a/2.parquet",), ("/b/1.parquet",)], "file_path string")
    out = sampling.split_files(df, train=["/a/*.parquet"], valid=["/b/*.parquet"])
    assert {r.file_path: r.split for r in out.collect()} == {"/a/1.parquet": "train", "/a/2.parquet": "train", "/b/1.parquet": "val"}


def test_weights(spark):
    rows = [(1, 1e6, 0.5), (1, 1e5, 0.5), (1, 1e4, 0.5), (1, 9e3, 0.5), (1, 1e7, 0.0), (0, 1e7, 1.0), (2, 1e7, 1.0), (1, NAN, 1.0), (1, 1e7, NAN)]
    df = spark.createDataFrame(rows, "label int, mc_primary_energy double, mc_primary_dir_z double")
    out = sampling.sample_weights(df).collect()
    assert [r.weight for r in out] == [20.0, 10.0, 3.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert [r.category for r in out] == ["very_high_upgoing", "high_upgoing", "med_upgoing", "low_upgoing", "starting_downgoing",
                                         "background", "background", "low_upgoing", "starting_downgoing"]
    tiers = codes.WeightTiers.from_options({"e_high": "2e5", "w_med_upgoing": 4, "w_default": 0.5})
    assert tiers.tiers[1] == ("high_upgoing", 2e5, 10.0) and tiers.tiers[2][2] == 4.0 and tiers.default == 0.5


def test_weighted_sample_follows_weights(spark):
    df = spark.range(200).select(F.col("id").alias("event_id"), F.when(F.col("id") < 2, 100.0).when(F.col("id") < 4, 0.0).otherwise(0.5).alias("weight"))
    drawn = sampling.weighted_sample(df, 3, n=20_000).groupBy("event_id").count().collect()
    counts = {r.event_id: r["count"] for r in drawn}
    assert sum(counts.values()) == 20_000
    assert 2 not in counts and 3 not in counts
    assert counts[0] / 20_000 == pytest.approx(100 / 298, abs=0.02)


def test_shuffles_are_permutations(spark):
    df = spark.range(500).select(F.col("id").alias("event_id"), (F.col("id") % 7).cast("string").alias("file_path"))
    for out in (sampling.shuffle_events(df, 1, "event_id", df.count()), sampling.shuffle_by_file(df, 1, ["event_id"])):
        assert sorted(r.position for r in out.collect()) == list(range(500))
    laid = sampling.lay_out(sampling.shuffle_events(df, 1, "event_id", df.count())).select("position", F.spark_partition_id().alias("p")).collect()
    assert [r.position for r in laid] == sorted(r.position for r in laid)


def test_padding(spark):
    row = spark.range(1).select(
        nested.pad_to_max(F.array(F.lit(1.0), F.lit(2.0)), F.lit(4), F.lit(0.0)).alias("short"),
        nested.pad_to_max(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1), F.lit(0.0)).alias("long")).first()
    assert row.short == [1.0, 2.0, 0.0, 0.0] and row.long == [1.0, 2.0]


def test_rescale_edges(spark):
    df = spark.range(1).select(
        F.array(F.array(F.lit(1000.0))).alias("coords"),
        F.array(F.array(F.lit(0.0), F.lit(-1.0), F.lit(-2.0), F.lit(NAN))).alias("features"))
    row = nested.rescale_points(df).first()
    assert row.coords == [[1.0]]
    assert row.features[0][:2] == [0.0, float("-inf")] and all(math.isnan(v) for v in row.features[0][2:])


def test_losses_by_name(spark):
    df = spark.createDataFrame([([2.0, 1.0], 0, 1.0, 2.0, 0.3), ([0.0, 3.0], -1, 2.0, 2.5, -40.0)], "logits array<double>, label int, p double, t double, s double")
    p, t, s = [F.col("p")], [F.col("t")], F.col("s")
    value = lambda c: df.agg(c).first()[0]
    assert value(losses.task_loss("morphology_classification", "anything", F.col("logits"), F.col("label"))) == pytest.approx(math.log(1 + math.exp(-1)))
    assert value(losses.task_loss("energy_reco", "mse", p, t)) == pytest.approx((1 + 0.25) / 2)
    sigma = [math.log1p(math.exp(0.3)) + 1e-6, math.exp(-40) + 1e-6]
    expected = np.mean([math.log(g) + d * d / 2 / g / g for g, d in zip(sigma, (1.0, 0.5))])
    assert value(losses.task_loss("energy_reco", "gaussian_nll", p, t, s)) == pytest.approx(expected)
    with pytest.raises(ValueError):
        losses.task_loss("deposited_energy_reco", "mse", p, t)
    assert one(spark, softplus(F.lit(800.0))) == pytest.approx(800.0)


def test_roc_ties_and_missing_class(spark):
    tied = spark.createDataFrame([([0.5, 0.5, 0.0], i % 2) for i in range(10)], "probs array<double>, label int")
    assert {r["class"]: r.auc for r in evaluation.roc_auc(tied, "probs", "label", 3).collect()} == {0: 0.5, 1: 0.5}
    points = evaluation.roc_curve(tied, "probs", "label", 3).where("class = 0").orderBy("tpr").collect()
    assert [(p.fpr, p.tpr) for p in points] == [(0.0, 0.0), (1.0, 1.0)]
    rng = np.random.default_rng(0)
    scores, truth = rng.uniform(size=400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([([1 - s, s], int(y)) for s, y in zip(scores.tolist(), truth)], "probs array<double>, label int")
    pairs = (scores[truth == 1][:, None] > scores[truth == 0][None, :]).mean()
    assert {r["class"]: r.auc for r in evaluation.roc_auc(df, "probs", "label", 2).collect()}[1] == pytest.approx(pairs)


def test_zenith_beyond_one(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0000001), (0.0, 0.0, 0.5)], "x double, y double, z double")
    cols = [F.col(c) for c in "xyz"]
    rows = evaluation.angular_errors(df, cols, cols).collect()
    assert math.isnan(rows[0].true_cos_zenith) and rows[1].true_cos_zenith == pytest.approx(0.5)
    assert rows[0].error_deg < 0.1


def test_confusion_shapes(spark):
    df = spark.createDataFrame([(3, 0, 0), (3, 0, 1), (9, 1, 1), (7, 1, 5)], "morphology_raw int, label int, predicted int")
    raw = evaluation.confusion_raw(df, range(8), 3).collect()
    assert {(r.morphology_raw, r.predicted): r["count"] for r in raw} == {(3, 0): 1, (3, 1): 1, (3, 2): 0}
    mapped = {(r.label, r.predicted): r.percent for r in evaluation.confusion_mapped(df, 3).collect()}
    assert len(mapped) == 9 and mapped[(0, 0)] == 50.0 and mapped[(1, 1)] == 100.0 and mapped[(2, 2)] == 0.0


def smooth(y, sigma=1.5):
    gaps = np.isnan(y)
    if gaps.all():
        return y
    at = np.arange(len(y))
    filled = np.where(gaps, np.interp(at, at[~gaps], y[~gaps]), y)
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(filled, radius, mode="symmetric")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def test_smoothing(spark):
    rng = np.random.default_rng(2)
    series = {"full": rng.normal(size=20), "ends": np.r_[[NAN] * 3, rng.normal(size=12), [NAN] * 5],
              "middle": np.r_[1.0, [NAN] * 17, 5.0, NAN], "none": np.full(20, NAN)}
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    out = distributions.smooth_profile(spark.createDataFrame(rows, "k string, bin int, v double"), ["v"], ["k"]).orderBy("bin")
    for k, ys in series.items():
        found = [NAN if r.v_smooth is None else r.v_smooth for r in out.where(F.col("k") == k).collect()]
        assert np.allclose(found, smooth(ys), equal_nan=True), k


def test_profile_leaves_the_last_edge_out(spark):
    x = np.r_[np.zeros(3), np.full(2, 0.25), np.full(4, 1.0)]
    y = np.arange(9.0)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())) + [(NAN, 1.0), (0.3, NAN)], "x double, y double")
    rows = distributions.binned_profile(df, "x", "y", bins=4).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 2, 0, 0]
    assert rows[0].median == 1.0 and rows[1].p25 == 3.25 and rows[3].median is None
    assert rows[0].rms == pytest.approx(math.sqrt(5 / 3)) and rows[1].centre == pytest.approx(0.375)


def test_density_and_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 10, "v double")
    rows = distributions.histogram_1d(df, "v", 50, density=True).orderBy("bin").collect()
    assert (rows[0].low, rows[-1].high) == (1.5, 2.5)
    assert sum(r.density * (r.high - r.low) for r in rows) == pytest.approx(1.0)
    assert sum(r["count"] for r in rows) == 10


def test_kde(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=300)
    grid = np.linspace(v.min(), v.max(), 200)
    h = v.std(ddof=1) * len(v) ** -0.2
    expected = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    rows = distributions.kde_1d(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").orderBy("point").collect()
    assert np.allclose([r.density for r in rows], expected)


def test_histogram_2d(spark):
    rng = np.random.default_rng(6)
    x, y = np.round(rng.uniform(0, 1, 500), 2), rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    counts, xe, ye = np.histogram2d(x, y, bins=[10, 12])
    rows = distributions.histogram_2d_colnorm(df, "x", "y", (10, 12)).collect()
    found = np.zeros((10, 12))
    for r in rows:
        found[r.xb, r.yb] = r.share
    assert np.allclose(found, counts / counts.sum(axis=1, keepdims=True))


def test_shared_dir_reads_the_session(spark):
    assert ordering.scratch_path(spark, "t").startswith(ordering.shared_dir(spark))


def test_files_to_draws(spark, tmp_path):
    """The flow of the README on files with metadata order."""
    frame(spark, *[event(i, i % 4, mc_primary_energy=10.0 ** (i % 7)) for i in range(40)]).repartition(3).drop(
        "file_path").write.parquet(str(tmp_path / "21217"))
    raw = scan.scan_events(spark, [str(tmp_path / "21217")], ["event_id"], file_columns=True)
    events = scan.conform_columns(raw, ["event_id", "file_path", "row_index"]).withColumn(
        "block", F.expr("row_index div 65536"))
    index, sensors = tables.event_tables(events, "event_id", "file_path", ["file_path", "block"], ["row_index"])
    tables.write_event_tables(index, sensors, str(tmp_path / "out"))
    index, sensors = tables.read_event_tables(spark, str(tmp_path / "out"))
    assert index.count() == 30 and sensors.count() == sum(i % 4 for i in range(40))
    assert {r.dataset_id for r in index.select("dataset_id").distinct().collect()} == {21217}
    spans = sorted((r.sensor_start_idx, r.sensor_end_idx) for r in index.collect())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(r.sensor_idx for r in sensors.collect()) == list(range(sensors.count()))
    at = sensors.select("sensor_idx", "pos", F.col("event_id").alias("owner"))
    sliced = nested.slice_join(at.drop("pos"), index.select("event_id", "sensor_start_idx", "sensor_end_idx")).join(at.select("sensor_idx", F.col("pos").alias("said")), "sensor_idx")
    assert sliced.count() == sensors.count() and sliced.where("event_id != owner or pos != said").isEmpty()
    coded = index.withColumn("label", labels.class_label(F.col("morphology_raw").cast("int"), None, "flat"))
    train = sampling.split_events(coded, val=0.1, seed=42).where("split = 'train'")
    assert train.count() == 27
    weighted = sampling.sample_weights(train)
    assert weighted.agg(F.max("weight")).first()[0] == 20.0
    assert sampling.weighted_sample(weighted, seed=42).count() == 27


def test_versions_of_one_folder(spark, tmp_path):
    """Every file decides by its own columns, whichever file is listed first."""
    new, nulls = frame(spark, event(1), event(2)), frame(spark, event(3, mc_primary_energy=None), event(4))
    old = frame(spark, event(5)).drop("mc_primary_energy", codes.MORPHOLOGY_COLUMN, S["x"])
    for order in ((new, nulls, old), (old, new, nulls)):
        folder = tmp_path / f"in{'new' if order[0] is new else 'old'}"
        for i, df in enumerate(order):
            df.coalesce(1).write.parquet(f"{folder}/{i}")
        found = {r.event_id: r for r in scan.scan_versions(spark, [str(folder)], ["event_id"], file_columns=True).collect()}
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert math.isnan(found[3].mc_primary_energy) and found[5].mc_primary_energy == 0.0 and found[1].mc_primary_energy == 10.0
        assert found[5].mc_event_morphology == "Unknown" and found[1].mc_event_morphology == "0T1C"
        assert found[5].num_sensors == 3 and found[5][S["x"]] == [0.0] * 3 and found[1][S["x"]] == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        scan.scan_versions(spark, [str(tmp_path / "none")])


def test_choice_of_files_before_the_scan(spark, tmp_path):
    for d in ("21217", "charm"):
        spark.range(12).repartition(6).write.parquet(str(tmp_path / d))
    files = scan.list_files(spark, [str(tmp_path)])
    assert files == sorted(files) and len(files) == 12
    chosen = scan.choose_range(files, 2, 5)
    assert sorted(spark.read.parquet(*chosen).inputFiles()) == files[2:5]
    rows = spark.createDataFrame([(f, f.rpartition("/")[0]) for f in files], "file_path string, dir string")
    names = lambda df: sorted(r.file_path for r in df.collect())
    assert names(scan.file_range(rows, 2, 5)) == chosen
    assert names(scan.sample_files_per_dir(rows, 2, 7)) == scan.choose_per_dir(files, 2, 7)
    train, val = scan.choose_split(files, 0.25, 3)
    split = sampling.split_files(rows, 0.25, 3)
    assert names(split.where("split = 'train'")) == train and names(split.where("split = 'val'")) == val and len(val) == 3
    recipe = (scan.Source("tracks", "21217", files=(1, 4)), scan.Source("charm", "charm"))
    mix = scan.choose_mix(files, recipe)
    mixed = scan.training_mix(rows.withColumn("mc_event_morphology", F.lit("0T1C")), recipe)
    assert {s: names(mixed.where(F.col("source") == s)) for s in mix} == mix
    assert "SortMergeJoin" not in scan.file_range(rows, 2, 5)._jdf.queryExecution().executedPlan().toString()


def test_keys_of_several_columns(spark):
    df = spark.range(100).selectExpr("CAST(id % 10 AS STRING) AS source", "id div 10 AS event_id", "1.0D AS weight")
    out = sampling.split_events(df, 0.25, 7, ["source", "event_id"])
    assert out.where("split = 'val'").count() == 25 and out.count() == 100
    together = sampling.split_events(df, 0.25, 7).groupBy("event_id").agg(F.countDistinct("split").alias("n"))
    assert {r.n for r in together.collect()} == {1}
    drawn = sampling.weighted_sample(df, 3, key=["source", "event_id"])
    assert drawn.columns == ["draw", "source", "event_id"] and drawn.count() == 100
    assert drawn.select("source", "event_id").distinct().count() > 40


@pytest.mark.parametrize("parts", [1, 5])
def test_thin_roc(spark, parts):
    scores = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4), (0, 0.3), (0, 0.2), (0, 0.1)]
    df = spark.createDataFrame([(l, [1 - s, s]) for l, s in scores], "label int, probs array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        full, thin = ([(r.fpr, r.tpr) for r in evaluation.roc_curve(df, "probs", "label", 2, thin=t).where("class = 1").orderBy(
            "fpr", "tpr").collect()] for t in (False, True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(full) == 10
    assert thin == [full[i] for i in (0, 3, 5, 6, 9)]


def test_class_names_of_cells(spark):
    df = spark.createDataFrame([(0, 0, 0), (4, 1, 0), (4, 1, 1)], "morphology_raw int, label int, predicted int")
    names = codes.class_names({0: 0, 4: 1}, 2)
    raw = {(r.morphology_raw_name, r.predicted_name): r["count"] for r in evaluation.confusion_raw(df, range(8), 2, class_names=names).collect()}
    assert raw == {("0T0C", "0T0C"): 1, ("0T0C", "1T1C"): 0, ("1T1C", "0T0C"): 1, ("1T1C", "1T1C"): 1}
    mapped = {(r.label_name, r.predicted_name): r["count"] for r in evaluation.confusion_mapped(df, 2, class_names=names).collect()}
    assert mapped == raw


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 17, 100, 101, 997])
def test_permutations_of_any_size(spark, n):
    df = spark.range(n).toDF("i")
    found = {seed: [r.position for r in sampling.shuffle_events(df, seed, "i", n).orderBy("i").collect()] for seed in (1, 2)}
    assert all(sorted(p) == list(range(n)) for p in found.values())
    if n > 90:
        assert found[1] != found[2]
        # positions are spread: neighbours do not stay together
        assert np.mean(np.abs(np.diff(found[1])) < n / 10) < 0.4


def test_a_shuffle_sorts_nothing(spark):
    df = spark.range(1000).toDF("i")
    plan = sampling.shuffle_events(df, 3, "i", df.agg(F.count("*")).scalar())
    assert "Sort" not in plan._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert sorted(r.position for r in plan.collect()) == list(range(1000))
    large = spark.createDataFrame([(10 ** 18 - 1,), (0,)], "i long")
    out = [r.position for r in sampling.shuffle_events(large, 3, "i", 10 ** 18).collect()]
    assert all(0 <= p < 10 ** 18 for p in out) and len(set(out)) == 2
