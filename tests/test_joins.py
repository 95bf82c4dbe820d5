import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrain.operators import joins, matching


def test_bounded_asof(spark):
    rng = random.Random(2)
    spans = [("a", s, s + rng.randrange(50)) for s in rng.sample(range(3000), 40)]
    points = [("a", p) for p in rng.sample(range(3000), 30)] + [("b", 5)]
    got = joins.bounded_asof(spark.createDataFrame(spans, "k string, s long, e long"), spark.createDataFrame(points, "k string, p long"), ["k"], "s", "e", "p", 100)
    for r in got.collect():
        own = [p for k, p in points if k == r.k]
        assert r.before == max((p for p in own if r.s - 100 <= p <= r.s), default=None)
        assert r.after == min((p for p in own if r.e <= p <= r.e + 100), default=None)
    assert got.count() == 40


def test_outside_spans(spark):
    rng = random.Random(3)
    spans = [("a", s, s + rng.randrange(60)) for s in rng.sample(range(2000), 30)] + [("a", 9, 3)]
    rows = [("a", t) for t in range(0, 2100, 3)] + [("b", 5), (None, 5), ("a", None)]
    got = joins.outside_spans(spark.createDataFrame(rows, "k string, t long"), spark.createDataFrame(spans, "k string, lo long, hi long"), ["k"], "t", "lo", "hi", 25)
    want = [r for r in rows if r[0] is None or r[1] is None or not any(k == r[0] and lo <= r[1] <= hi for k, lo, hi in spans)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_within_radius_border(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (3.0, 4.1), (-5.0, 0.0)], "x double, y double")
    c = spark.createDataFrame([(0.0, 0.0)], "cx double, cy double")
    assert sorted(map(tuple, joins.within_radius(rows, c, "x", "y", 5.0).collect())) == [(-5.0, 0.0), (0.0, 0.0), (3.0, 4.0)]


def test_top_first_override_reconcile(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(6)] + [("b", 9, 1.0), (None, 1, 1.0)], "k string, i long, v double")
    top = joins.top_per(df, ["k"], [F.desc("v"), F.col("i")], 4)
    assert {(r.k, r.extra) for r in top.collect()} == {("a", True), ("b", False), (None, False)}
    assert [r.i for r in top.where("k = 'a'").orderBy("rank").collect()] == [2, 5, 1, 4]
    assert {r.k: r.i for r in joins.first_per(df, ["k"], [F.desc("v"), F.col("i")]).collect()} == {"a": 2, "b": 9, None: 1}
    o = spark.createDataFrame([("a", 100.0), ("b", None)], "k string, v double")
    assert {r.v for r in joins.overridden(df, o, ["k"], "v").collect()} == {100.0, 1.0}
    got = joins.reconcile(df, spark.createDataFrame([("a",)], "k string"), "k", [("big", F.col("v") > 1)])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("a", "big"), ("a", "big"), ("b", "missing"), (None, "missing")]))


def test_unordered(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "a")], "x string, y string")
    assert [r.p for r in df.select(joins.unordered(F.col("x"), F.col("y")).alias("p")).collect()] == ["a+b", "a"]


@pytest.mark.parametrize("limit", [100, 1])
def test_nearest_centre_both_ways(spark, limit):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    c = spark.createDataFrame([(7, [0.0, 0.0]), (8, [2.0, 2.0]), (9, [6.0, 5.0])], "label int, centre array<double>")
    got = {r.id: (r.label, r.distance) for r in joins.nearest_centre(rows, c, "v", "id", "label", limit).collect()}
    assert got[1] == (7, 0.0) and got[2] == (9, 1.0) and got[3][0] == 7


def test_grid_knn(spark):
    rng = np.random.default_rng(0)
    rows = [("s", i, *map(float, rng.normal(0, 2, 3))) for i in range(150)] + [("s", 500 + i, 1.0, 1.0, 1.0) for i in range(20)] + [("t", 900, 0.0, 0.0, 0.0), ("t", 901, 50.0, 0.0, 0.0), ("u", 950, 0.0, 0.0, 0.0)]
    rows += rows[:10] + [("s", 999, None, 0.0, 0.0), ("s", 998, float("nan"), 0.0, 0.0)]
    got = {r.i: [n.other for n in r.near] for r in joins.grid_knn(spark.createDataFrame(rows, "s string, i long, x double, y double, z double"), ["s"], "i", 4, 0.5).collect()}
    pts = sorted({r for r in rows if r[2] is not None and r[2] == r[2]})
    for s, i, *p in pts:
        near = sorted((float(np.sqrt(((np.array(q) - p) ** 2).sum())), j) for t, j, *q in pts if t == s and j != i)[:4]
        assert got[i] == [j for _, j in near]


def test_greedy_assign(spark):
    rows = [("f", 0, 0, 5.0), ("f", 0, 1, 1.0), ("f", 1, 1, 0.5), ("f", 1, 0, 9.0), ("f", 2, 2, None), ("f", 3, 3, float("inf")), ("g", 0, 0, 2.0), ("g", 1, 0, 2.0)]
    got = matching.greedy_assign(spark.createDataFrame(rows, "f string, a int, b int, c double"), ["f"], "a", "b", "c").collect()
    assert sorted((r.f, r.a, r.b) for r in got) == [("f", 0, 0), ("f", 1, 1), ("g", 0, 0)]
    assert matching.greedy_pairs(np.array([[5.0, 1.0], [9.0, 0.5]])) == [(1, 1), (0, 0)]


def test_true_boxes_choose_in_order_and_ties_take_the_later(spark):
    schema = "image long, k long, box array<int>"
    t = spark.createDataFrame([(1, 0, [0, 0, 10, 10]), (1, 1, [0, 0, 10, 10]), (1, 2, [100, 100, 110, 110]), (2, 0, [0, 0, 10, 10])], schema)
    f = spark.createDataFrame([(1, 0, [0, 0, 10, 10]), (1, 1, [0, 0, 10, 10]), (1, 2, [0, 0, 10, 9]), (1, 3, [300, 300, 310, 310])], schema)
    rows = matching.detections_matched(t, f, ["image"]).collect()
    assert [r.hit for r in sorted(rows, key=lambda r: (r.image, r.k if r.k is not None else 9)) if r.k is not None] == [True, True, False, False]
    assert {r.image: r.extra for r in rows if r.k is None} == {1: 2, 2: 0}


def test_detections_matched(spark):
    schema = "image long, k long, box array<int>"
    t = spark.createDataFrame([(1, 0, [0, 0, 10, 10]), (1, 1, None), (2, 0, [0, 0, 10, 10])], schema)
    f = spark.createDataFrame([(1, 0, [0, 0, 10, 10]), (1, 1, [50, 50, 60, 60]), (3, 0, [0, 0, 5, 5]), (3, 1, None)], schema)
    rows = matching.detections_matched(t, f, ["image"]).collect()
    assert {(r.image, r.k): r.hit for r in rows if r.k is not None} == {(1, 0): True, (1, 1): False, (2, 0): False}
    assert {r.image: r.extra for r in rows if r.k is None} == {1: 1, 2: 0, 3: 1}


def test_suppress(spark):
    df = spark.createDataFrame([(1, 0, [0, 0, 10, 10]), (1, 1, [0, 0, 10, 9]), (1, 2, [5, 5, 15, 15]), (2, 0, None)], "i long, k long, box array<int>")
    assert sorted(r.k for r in matching.suppress(df, ["i"], ["k"], "box").collect()) == [0, 2]


def test_suppress_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        x, y, w, h = int(rng.integers(0, 60)), int(rng.integers(0, 60)), int(rng.integers(0, 40)), int(rng.integers(1, 40))
        rows.append((i % 3, i, [x, y, x + w, y + h], "x"))
    rows += [(1, 600 + i, [5, 5, 25, 25], "y") for i in range(50)] + [(1, 700, None, "z"), (1, 701, [1, None, 3, 4], "z")]
    for most in (0.7, 0.3, 0.01):
        want = set()
        for key in range(3):
            kept = []
            for _, k, b, _ in sorted((r for r in rows if r[0] == key and r[2] and None not in r[2]), key=lambda r: r[1]):
                iou = lambda a: max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0) / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0) + 1e-9)  # noqa: B023, E731
                if all(iou(a) <= most for a in kept):
                    kept.append(b)
                    want.add((key, k))
        got = matching.suppress(spark.createDataFrame(rows, "i long, k long, box array<int>, note string"), ["i"], ["k"], "box", most).collect()
        assert {(r.i, r.k) for r in got} == want and len(got) == len(want)


def test_nearest_centre_in_blocks(spark):
    rng = np.random.default_rng(1)
    c, p = rng.normal(size=(40, 3)), rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, v array<double>")
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "label long, centre array<double>")
    for limit in (1000, 7):
        got = {r.id: r.label for r in joins.nearest_centre(rows, centres, "v", "id", "label", limit).collect()}
        assert got == {i: int(((c - v) ** 2).sum(axis=1).argmin()) for i, v in enumerate(p)}
    assert joins.nearest_centre(rows, centres.limit(0), "v", "id", "label").count() == 0
