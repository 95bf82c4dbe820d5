import numpy as np
import pytest

from reelgrain.llm import neighbours

SCHEMA = "row_id long, scene string, x float, y float, z float, note string"


def brute(rows, k):
    out = {}
    rows = sorted({r[:5] for r in rows if r[0] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[2:5])})
    for scene in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == scene]
        xyz = np.array([[np.float64(np.float32(v)) for v in r[2:5]] for r in own])
        ids = np.array([r[0] for r in own])
        for i in range(len(own)):
            d = np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.fixture
def cloud():
    rng = np.random.default_rng(4)
    rows = []
    for scene, n in (("a", 700), ("b", 90), ("c", 5), ("d", 1)):
        for _ in range(n):
            p = rng.normal(0, 3, 3) if rng.random() < 0.95 else rng.normal(0, 30, 3)
            rows.append((len(rows), scene, *[float(v) for v in np.float32(p)], "n"))
    rows += [(5000 + i, "a", 1.0, 2.0, 3.0, "n") for i in range(40)]  # many points at one place
    rows += [(6000 + i, "b", float(i % 4), float(i // 4), 0.0, "n") for i in range(16)]  # ties on a grid
    rows += rows[:30]
    rows += [(9001, "a", None, 0.0, 0.0, "n"), (9002, "a", float("nan"), 0.0, 0.0, "n"), (None, "a", 0.0, 0.0, 0.0, "n"), (9003, None, 0.0, 0.0, 0.0, "n"), (9004, "a", float("inf"), 0.0, 0.0, "n")]
    return rows


@pytest.mark.parametrize("cover,most", [(0.99, 6), (0.3, 1)])
def test_all_points_over_several_parts(spark, cloud, cover, most):
    found = neighbours.neighbours(spark.createDataFrame(cloud, SCHEMA), k=8, part=60, salted=200, cover=cover, most=most)
    got = {r.row_id: list(r.near) for r in found.collect()}
    assert got == brute(cloud, 8)


def test_parts_held_as_slices(spark, cloud):
    found = neighbours.neighbours(spark.createDataFrame(cloud, SCHEMA), k=8, part=20, max_parts=4)
    assert {r.row_id: list(r.near) for r in found.collect()} == brute(cloud, 8)


def test_asked_points(spark, cloud):
    asked = spark.createDataFrame([(i,) for i in (0, 0, 5, 701, 5003, 6005, 9002, 123456, None)], "row_id long")
    found = neighbours.neighbours(spark.createDataFrame(cloud, SCHEMA), k=8, asked=asked)
    want = brute(cloud, 8)
    got = {r.row_id: list(r.near) for r in found.collect()}
    assert got == {i: want[i] for i in (0, 5, 701, 5003, 6005)}
    pairs = {(r.row_id_a, r.row_id_b) for r in neighbours.pairs(found).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a in got for b in got[a]}


def test_classifier_alone_finds_most(cloud):
    """Held-out accuracy of the routing, without the exact check."""
    rng = np.random.default_rng(1)
    points = rng.normal(0, 3, (6000, 3))
    model = neighbours.train(points[:1500], 20)
    routes = neighbours.route(points, model)
    part = routes[:, 0]
    sizes = np.bincount(part, minlength=20)
    assert sizes.max() < 4 * 6000 / 20
    hit = total = 0
    for i in range(0, 6000, 40):
        d = ((points - points[i]) ** 2).sum(axis=1)
        near = np.argsort(d)[1:9]
        hit += np.isin(part[near], routes[i][routes[i] >= 0]).sum()
        total += 8
    assert hit / total > 0.9


def test_empty(spark):
    assert neighbours.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
