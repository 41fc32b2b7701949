"""Boxes of a k-d partition: same results as without, and far fewer distances."""

import numpy as np
import pytest

from evtlake.operators import boxes, points


def brute_picks(cloud, count):
    picks, closest = [0], np.full(cloud.shape[1], np.inf)
    for _ in range(count - 1):
        closest = np.fmin(closest, boxes.gaps(cloud, cloud[:, picks[-1]]))
        picks.append(int(closest.argmax()))
    return picks


def a_cloud(n, coarse, seed=1):
    cloud = np.random.default_rng(seed).uniform(0, 6 if coarse else 100, (4, n))
    return np.round(cloud) if coarse else cloud


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 9000])
@pytest.mark.parametrize("coarse", [False, True])
def test_every_point_is_in_one_box(n, coarse):
    at = boxes.split(a_cloud(n, coarse), 64)
    assert sorted(at[at >= 0].tolist()) == list(range(n))
    assert at.shape[1] <= 64


@pytest.mark.parametrize("n", [1, 100, 3000, 20000])
@pytest.mark.parametrize("coarse", [False, True])
def test_farthest_points(n, coarse):
    cloud = a_cloud(n, coarse)
    if n == 3000:
        cloud[0, 7], cloud[2, 9] = np.inf, np.nan
    for make in (boxes.Field, boxes.Plain):
        near, picks = make(cloud, np.arange(n)), []
        for _ in range(40):
            picks.append(near.best()[1])
            near.add(near.point(picks[-1]))
        assert picks == brute_picks(cloud, 40)


@pytest.mark.parametrize("n,k", [(3, 8), (600, 8), (5000, 1), (9000, 8)])
@pytest.mark.parametrize("coarse", [False, True])
def test_nearest_points(n, k, coarse):
    cloud = a_cloud(n, coarse)
    pos = np.random.default_rng(2).permutation(10 * n)[:n]
    centres = np.concatenate([cloud[:, :20], a_cloud(5, coarse, 9)], axis=1)
    found, d2 = boxes.nearest_of(cloud, pos, centres, k)
    for c in range(centres.shape[1]):
        gap = boxes.gaps(cloud, centres[:, c])
        order = np.lexsort((pos, gap))[:k]
        assert found[c][:len(order)].tolist() == pos[order].tolist() and (found[c][len(order):] == boxes.NONE).all()
        assert d2[c][:len(order)].tolist() == gap[order].tolist()


def test_few_distances_are_compared():
    cloud = a_cloud(8192, False)
    picks = brute_picks(cloud, 196)
    index = boxes.Boxes(cloud, leaf=boxes.NEAR_LEAF)
    boxes.nearest(index, cloud[:, picks], 8)
    assert index.compared / len(picks) < cloud.shape[1] / 10
    wide = a_cloud(65536, False)
    near = boxes.Field(wide)
    for pick in brute_picks(wide, 196):
        near.add(wide[:, pick])
    assert near.compared / 196 < wide.shape[1] / 8


def test_rounds_pick_many_points(spark, monkeypatch):
    """A cloud beyond CANDIDATES takes far fewer rounds than picks."""
    cloud = a_cloud(6000, False)
    monkeypatch.setattr(points, "CANDIDATES", 2000)
    rounds = []
    plain = points._picked
    monkeypatch.setattr(points, "_picked", lambda *a: rounds.append(1) or plain(*a))
    rows = spark.createDataFrame([("a", i, *map(float, cloud[:, i]), 1.0) for i in range(6000)], "key string, pos long, x double, y double, z double, t double, f double")
    found = points.farthest_points(points.clouds(rows, "key", ["f"], chunk=500), "key", 100).orderBy("token_no").collect()
    assert [r.pos for r in found] == brute_picks(cloud, 100)
    assert len(rounds) <= 20


def test_neighbours_of_centres_that_are_not_finite(spark):
    cloud = np.ones((4, 30))
    cloud[0] = np.arange(30)
    cloud[1, 4] = np.nan
    rows = spark.createDataFrame([(1, i, *map(float, cloud[:, i]), float(i)) for i in range(30)], "key int, pos long, x double, y double, z double, t double, f double")
    answers = [sorted((r.token_no, r.pos, tuple(n.pos for n in r.neighbours), tuple(r.pooled)) for r in points._reduced(points.clouds(rows, "key", ["f"], chunk=chunk), "key", 5, 3).collect())
               for chunk in (8192, 7)]
    assert answers[0] == answers[1]
