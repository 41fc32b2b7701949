"""Point clouds against brute force, in one task and spread over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtlake.operators import points

TOKENS, K = 6, 3


def brute_force(cloud, features):
    picks = [0]
    gap = lambda c: sum((cloud[:, a] - cloud[c, a]) ** 2 for a in range(4))
    closest = gap(0)
    for _ in range(TOKENS - 1):
        picks.append(int(closest.argmax()))
        closest = np.minimum(closest, gap(picks[-1]))
    near = [np.argsort(gap(c), kind="stable")[:K] for c in picks]
    pooled = [features[n].max(axis=0) for n in near]
    return picks, near, [np.where(np.isfinite(p), p, 0.0) for p in pooled]


@pytest.fixture(scope="module")
def clouds_data():
    rng = np.random.default_rng(3)
    out = {}
    for key, n in enumerate([1, TOKENS - 1, TOKENS, TOKENS + 1, 40, 203]):
        cloud = np.round(rng.uniform(0, 4, (n, 4)))  # coarse, so that distances tie
        features = rng.normal(size=(n, 2))
        if n == 40:
            features[7, 0] = np.inf
            features[9, 1] = np.nan
        out[key] = (cloud, features)
    out[9] = (np.ones((12, 4)), np.arange(24.0).reshape(12, 2))  # identical points
    return out


@pytest.fixture(scope="module")
def rows(spark, clouds_data):
    data = [(k, i, *map(float, c[i]), *map(float, f[i])) for k, (c, f) in clouds_data.items() for i in range(len(c))]
    return spark.createDataFrame(data, "key int, pos long, x double, y double, z double, t double, f0 double, f1 double").repartition(7)


@pytest.mark.parametrize("chunk, broadcast, candidates", [
    (points.CHUNK, 10_000, 1 << 16), (11, 10_000, 1 << 16), (11, 0, 60), (11, 10_000, 1), (1, 0, 30), (256, 10_000, 1 << 16)])
def test_tokens(spark, rows, clouds_data, chunk, broadcast, candidates, monkeypatch):
    monkeypatch.setattr(points, "BROADCAST_CLOUDS", broadcast)
    monkeypatch.setattr(points, "CANDIDATES", candidates)
    monkeypatch.setattr(points, "TOKEN_BLOCK", 4)
    cloud = points.clouds(rows, "key", ["f0", "f1"], chunk=chunk)
    far, near, tokens = {}, {}, {}
    for r in points.farthest_points(cloud, "key", TOKENS).orderBy("key", "token_no").collect():
        far.setdefault(r.key, []).append(r.pos)
    for r in points.knn(cloud, "key", TOKENS, K).orderBy("key", "token_no", "rank").collect():
        near.setdefault(r.key, {}).setdefault(r.token_no, []).append(r.pos)
    for r in points.tokenize_events(cloud, "key", TOKENS, K, 2).orderBy("key", "token_no").collect():
        tokens.setdefault(r.key, []).append(r)
    for key, (c, f) in clouds_data.items():
        rows_ = tokens[key]
        assert [r.token_no for r in rows_] == list(range(TOKENS))
        if len(c) <= TOKENS:
            assert far[key] == list(range(len(c)))
            assert key not in near
            assert [r.valid for r in rows_] == [i < len(c) for i in range(TOKENS)]
            assert all(r.features == [0.0, 0.0] for r in rows_ if not r.valid)
            assert np.allclose([r.features for r in rows_ if r.valid], f)
            continue
        picks, neighbours, pooled = brute_force(c, f)
        assert far[key] == picks
        assert [near[key][t] for t in range(TOKENS)] == [n.tolist() for n in neighbours]
        assert np.allclose([r.features for r in rows_], pooled)


def test_slabs_cover_all_rows(monkeypatch):
    monkeypatch.setattr(points, "SLAB", 50)
    sizes = np.array([3, 40, 2, 60, 5, 5, 1])
    parts = list(points.slabs(sizes))
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(sizes)))
    assert all(len(p) * sizes[p].max() <= 50 or len(p) == 1 for p in parts)


def test_score_events(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"))
    out = points.score_events(df, lambda frame: frame.assign(s=frame.v * 2)[["id", "s"]], "id long, s double")
    assert {r.id: r.s for r in out.collect()} == {i: 2.0 * i for i in range(10)}


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(x, v):
            assert x.shape[1:] == (2, 3) and len(x) <= 7
            return x.sum(axis=(1, 2)) + v
        return predict

    df = spark.range(200).repartition(20).select("id", F.array_repeat(F.col("id").cast("double"), 6).alias("x"), (F.col("id") * 0.5).alias("v"))
    out = points.score_batches(df, load, {"x": (2, 3), "v": ()}, "double", batch=7)
    assert all(r.prediction == r.id * 6.5 for r in out.collect())
    loads = [name.split("-")[0] for name in __import__("os").listdir(folder)]
    assert len(loads) == len(set(loads)) < 20


def test_clouds_of_one_row_are_not_searched_for_larger_ones(spark, rows):
    whole, cut = points.clouds(rows, "key", ["f0"]), points.clouds(rows, "key", ["f0"], chunk=11)
    assert "LocalRelation <empty>" in whole.where("chunks > 1")._jdf.queryExecution().optimizedPlan().toString()
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and cut.count() > whole.count()
