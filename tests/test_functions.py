import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelgrain.functions import geometry as g
from reelgrain.functions import numeric as num
from reelgrain.functions import pixels, splat, text
from reelgrain.operators import aggregates, cloud, rules, sampling


def values(spark, column, **given):
    names = list(given)
    rows = list(zip(*given.values()))
    return [r[0] for r in spark.createDataFrame(rows, names).select(column).collect()]


def test_even_round_like_python(spark):
    xs = [0.745, 2.675, 0.125, 0.375, 2.5, 3.5, -0.745, -2.5, 0.5, 1.005, 999.995, 0.0, -0.0, 12345.675, 0.55, 0.15] + [i / 1000 for i in range(0, 3000, 7)] + list(np.random.default_rng(0).uniform(-900, 900, 200))
    xs = [float(x) for x in xs]
    for digits in (0, 1, 2):
        got = values(spark, num.even_round(F.col("x"), digits), x=xs)
        assert [a for a, b in zip(got, xs) if abs(b) < 1000 and a != round(b, digits)] == []


def test_truncation_and_modulo(spark):
    assert values(spark, num.trunc(F.col("x")), x=[2.7, -0.7, -2.5]) == [2, 0, -2]
    assert values(spark, num.floor_div(F.col("x"), 8), x=[-7, 7, -8]) == [-1, 0, -1]
    assert values(spark, num.in_hue_range(F.col("x"), 345.0, 70.0), x=[350.0, 0.0, 70.0, 71.0, 344.0]) == [True, True, True, False, False]
    assert values(spark, num.hue(F.col("x"), F.col("y")), x=[1.0, 0.0], y=[0.0, -1.0]) == [0.0, 270.0]


def test_share_tolerance(spark):
    # the mix of a full run strays by chance only; a third would not
    out = values(spark, num.share_off(F.col("s"), F.col("t"), F.col("n")), s=[0.845, 0.110, 0.046, 0.30], t=[0.85, 0.10, 0.05, 0.10], n=[3000.0] * 4)
    assert out == [False, False, False, True]


def test_boxes(spark):
    a, b, c = [0, 0, 10, 10], [10, 10, 20, 20], [12, 0, 20, 8]
    df = spark.createDataFrame([(a, b), (a, c), (a, None)], "a array<int>, b array<int>")
    got = df.select(g.touches(F.col("a"), F.col("b")).alias("t"), g.touches(F.col("a"), F.col("b"), 2).alias("r"), g.iou(F.col("a"), F.col("b")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(True, True, 0.0), (False, True, 0.0), (None, None, None)]
    row = spark.createDataFrame([([0, 0, 1439, 761],)], "b array<int>").select(g.label_row(F.col("b"), 1440, 762).alias("l"), g.grown(F.col("b"), 0.1, 1440, 762).alias("g")).first()
    assert row.l == "0 0.500000 0.500000 1.000000 1.000000" and row.g == [0, 0, 1439, 761]


def test_homography_round_trip(spark):
    src = [(0.0, 0.0), (100.0, 5.0), (110.0, 90.0), (-5.0, 80.0), (50.0, 50.0)]
    h0 = [[1.1, 0.1, 3.0], [0.05, 0.9, -2.0], [0.0004, 0.0002, 1.0]]
    at = lambda h, p: tuple((np.array(h) @ [*p, 1])[:2] / (np.array(h) @ [*p, 1])[2])
    h = g.homography(src, [at(h0, p) for p in src])
    assert np.allclose(h, h0, atol=1e-6)
    got = spark.createDataFrame([(20.0, 30.0)], "x double, y double").select(g.project(h, F.col("x"), F.col("y")).alias("m")).select("m.*").first()
    back = at(g.inverse(h), tuple(got))
    assert np.allclose(back, (20, 30))
    for bad in ([(0, 0)] * 3, [(0, 0), (1, 1), (2, 2), (3, 3)]):
        with pytest.raises(ValueError):
            g.homography(bad, bad)


def test_polygon_and_hull(spark):
    h = g.hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [4, 2]]))
    assert len(h) == 4
    got = values(spark, g.inside_polygon(F.col("x"), F.col("y"), [tuple(p) for p in h.tolist()]), x=[2.0, 5.0, -1.0], y=[2.0, 2.0, 2.0])
    assert got == [True, False, False]


def test_keys(spark):
    s = ["cutout:r:p:c:1", "mesh:r", "new:r", "pair:r:p:c:1", "still:r", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in s], "s string").select(text.source_key(F.col("s"))).collect()] == ["r:p", "mesh:r", "new:r", "pair:r:p", "still:r", None]
    assert values(spark, text.reason_key(F.col("x")), x=["a: b", "c"]) == ["a", "c"]
    assert values(spark, text.rate(F.col("x")), x=["30000/1001", "25"]) == [30000 / 1001, 25.0]


def test_harmonics_turn_with_the_scene(spark):
    rng = np.random.default_rng(3)
    r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r *= np.linalg.det(r)
    c = rng.normal(size=45)
    turned = np.array(spark.createDataFrame([(c.tolist(),)], "c array<double>").select(splat.turned_harmonics(F.col("c"), r)).first()[0])
    d = rng.normal(size=(20, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    for ch in range(3):
        assert np.allclose(splat.harmonics(d) @ c[15 * ch : 15 * ch + 15], splat.harmonics(d @ r.T) @ turned[15 * ch : 15 * ch + 15], atol=1e-9)
    # the harmonics are orthonormal
    n = 20000
    d = rng.normal(size=(n, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    y = splat.harmonics(d)
    assert np.allclose(y.T @ y / n * 4 * math.pi, np.eye(15), atol=0.12)


def test_quaternions(spark):
    r = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    q = splat.matrix_quaternion(r)
    row = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double").select(*splat.turned([F.col(c) for c in "abcd"], r)).first()
    assert np.allclose(list(row), q)
    t = spark.createDataFrame([(*q.tolist(), 1.0, 2.0, 3.0)], "w double, x double, y double, z double, a double, b double, c double")
    centre = t.select(*splat.camera_centre([F.col(c) for c in "wxyz"], [F.col(c) for c in "abc"])).first()
    assert np.allclose(list(centre), -r.T @ [1, 2, 3])


def test_verdicts(spark):
    cols = "n int, ratio double, dom double, err double, gap double"
    rows = [(4, 0.654, 0.838, 0.935, 103 / 428), (1, 0.959, 1.0, 0.988, 0.01), (0, 0.9, 1.0, 0.1, 0.0), (1, 0.9, 1.0, 1.0, 0.0), (1, 0.39, 1.0, 0.5, 0.0)]
    got = spark.createDataFrame(rows, cols).select(rules.reconstruction_verdict(*[F.col(c) for c in ("n", "ratio", "dom", "err", "gap")])).collect()
    assert [r[0] for r in got] == ["MARGINAL", "GO", "NO-GO", "MARGINAL", "NO-GO"]
    s = spark.createDataFrame([(True, 22.0, 0.808, 0.202, True), (True, 25.0, 0.85, 0.05, True), (False, 30.0, 0.9, 0.0, True), (None, 30.0, 0.9, 0.0, True)], "i boolean, p double, s double, f double, o boolean")
    assert [r[0] for r in s.select(rules.splat_verdict(*[F.col(c) for c in "ipsfo"])).collect()] == ["MARGINAL", "GO", "NO-GO", "NO-GO"]


def test_outline_rules(spark):
    shape = "robots array<struct<area:int,on_change:double,moving:double,at_edge:boolean,bbox:array<int>,mean:double>>, extra boolean, missed boolean, unlabelled double"
    big, bit = (10000, 0.9, 0.5, False, [0, 0, 100, 100], 1.0), (600, 0.9, 0.5, False, [115, 0, 130, 10], 1.0)
    rows = [(None, False, False, 0.0), ([], False, True, 0.3), ([big], False, False, 0.0), ([big, bit], False, False, 0.0), ([big, big, bit], None, None, None), ([big[:2] + (0.1, True) + big[4:]], True, False, 0.0)]
    got = [list(r[0]) for r in spark.createDataFrame(rows, shape).select(rules.outline_reasons()).collect()]
    assert got == [[rules.REASONS[k] for k in keys.split()] for keys in ("none", "none missed change", "one", "piece", "many", "one many static edge")]


def test_aggregates(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 100, 500)
    y = 3 * x + 7 + rng.normal(0, 1, 500)
    y[:20] += 200
    row = aggregates.robust_fit(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), [], "x", "y").first()
    a, b = np.polyfit(x, y, 1)
    r = y - (a * x + b)
    keep = np.abs(r) <= 2 * r.std()
    assert np.allclose((row.slope, row.intercept), np.polyfit(x[keep], y[keep], 1)) and row.kept == keep.sum()
    k = aggregates.kind_shares(spark.createDataFrame([("two",)] * 9 + [("one",)], "kind string"), "kind", spark.createDataFrame([("two", 0.9), ("one", 0.1), ("empty", 0.0)], "kind string, target double"))
    assert {r.kind: (r.n, r.share, r.off) for r in k.collect()} == {"two": (9, 0.9, False), "one": (1, 0.1, False), "empty": (0, 0.0, False)}
    h = aggregates.histogram(spark.createDataFrame([(v,) for v in (0.0, 0.1, 9.99, 10.0, 10.1, None)], "v double"), [], F.col("v"), 0.0, 10.0, 10)
    assert {r["bin"]: r.n for r in h.collect()} == {0: 2, 9: 2}
    d = aggregates.dominance(spark.createDataFrame([(0, 22), (1, 280)], "index int, images int")).first()
    assert (round(d.dominance, 3), round(d.largest, 3)) == (0.073, 0.927)
    assert aggregates.recall(spark.createDataFrame([("a", True)] * 360 + [("a", False)] * 180, "k string, h boolean"), ["k"], F.col("h")).first().recall == pytest.approx(2 / 3)
    c = aggregates.grid_coverage(spark.createDataFrame([(-1.0, 0.0), (99.9, 99.9), (500.0, 0.0)], "x double, y double"), [], F.col("x"), F.col("y"), (0, 0, 99, 99), (6, 3)).first()
    assert c.cells == 2


def test_sampling(spark):
    images = spark.range(4000).withColumnRenamed("id", "image")
    pool = spark.createDataFrame([("a", f"a{i}") for i in range(100)] + [("b", "b0"), (None, "x")], "robot string, file string")
    got = sampling.two_level(images, pool, "image", "robot", "file", 1)
    n = {r.robot: r["count"] for r in got.groupBy("robot").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["a"] - 2000) < 150
    assert sorted(got.collect()) == sorted(sampling.two_level(images.repartition(7), pool, "image", "robot", "file", 1).collect())
    kinds = {r.k: r["count"] for r in images.select(sampling.draw_kind("image", [("x", 0.7), ("y", 0.3)], 2).alias("k")).groupBy("k").count().collect()}
    assert abs(kinds["x"] / 4000 - 0.7) < 0.03
    tried = sampling.first_accepted(images, "image", 30, {"u": num.unit("image", "attempt", seed=4)}, F.col("u") < 0.3)
    rows = tried.collect()
    assert len(rows) == 4000 and all(r.u is None or r.u < 0.3 for r in rows) and sum(r.u is None for r in rows) < 5
    assert abs(np.mean([r.attempt for r in rows if r.attempt is not None]) - 7 / 3) < 0.2


def test_floor_and_floaters(spark):
    rng = np.random.default_rng(2)
    floor = [(i, "s", *map(float, (*rng.uniform(-3, 3, 2), 0.0)), 1.0) for i in range(800)]
    floor = [(i, s, x, y, float(0.05 * x + rng.normal(0, 0.004)), o) for i, s, x, y, z, o in floor]
    air = [(1000 + i, "s", *map(float, rng.uniform(-3, 3, 3)), 1.0) for i in range(200)] + [(2000, "s", 90.0, 90.0, 90.0, 1.0), (2001, "s", None, 0.0, 0.0, 1.0), (2002, "t", 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(floor + air, "row_id long, scene string, x double, y double, z double, opacity double")
    planes = {r.scene: r for r in cloud.floor_plane(df, ["scene"]).collect()}
    assert set(planes) == {"s"}
    n = np.array([-0.05, 0, 1]) / math.hypot(0.05, 1)
    assert np.allclose([planes["s"].nx, planes["s"].ny, planes["s"].nz], n, atol=0.01) and planes["s"].inliers > 700
    marked = cloud.outside(["scene"], df, cloud.region(df, ["scene"]))
    assert [r.row_id for r in marked.where("outside").collect()] == [2000]
    iso = cloud.isolated(df, ["scene"], "row_id", 0.3).where("isolated").collect()
    assert 2000 in {r.row_id for r in iso}
    cover = cloud.floor_cover(df.where("row_id < 800"), [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)], 1.0).first()
    assert (cover.inside, cover.covered, cover.cover) == (16, 16, 1.0)
    near = cloud.near_camera(df.where("x is not null"), spark.createDataFrame([(90.0, 90.0, 90.01)], "cx double, cy double, cz double")).where("cam_near").collect()
    assert [r.row_id for r in near] == [2000]
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    q = df.where("x is not null").withColumns({f"rot_{i}": F.lit(float(i == 0)) for i in range(4)})
    out = cloud.cleaned(q, F.col("row_id") == 2000, turn, np.array([0, 0, 1.0]))
    c = cloud.compared(q, out, turn, np.array([0, 0, 1.0])).first()
    assert c.rows == 1001 and c.lost == 0 and c.worst < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_components_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    m = rng.random((9, 11)) < 0.45
    got, seen, n = pixels.components(m), np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m)):
        if not seen[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 9 and 0 <= b < 11 and m[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert got.max() == n and len({(p, q) for p, q in zip(got[m], seen[m])}) == n


def test_pixels(spark):
    rng = np.random.default_rng(0)
    plate = rng.integers(0, 255, (60, 80)).astype(np.uint8)
    assert pixels.texture_match(plate, plate)[30, 40] == pytest.approx(1, abs=1e-6)
    frame = plate.copy()
    frame[20:45, 30:60] = 200
    mask = np.full(plate.shape, 255)
    hit = pixels.changed(frame, plate, mask)
    assert hit[32, 45] or abs(int(plate[32, 45]) - 200) <= 28
    assert not hit[2, 2]
    assert pixels.sharpness(plate) > pixels.sharpness(np.full((60, 80), 7, np.uint8)) == 0
    disc = np.hypot(*np.mgrid[-20:21, -20:21]) <= 15
    d = pixels.distance(disc)
    y, x = np.nonzero(~disc)
    want = np.sqrt(((np.mgrid[0:41, 0:41][:, :, :, None] - np.array([y, x])[:, None, None, :]) ** 2).sum(0)).min(-1)
    assert np.allclose(d, want)
    assert pixels.square_gap(np.ones((10, 10), bool)) == pytest.approx(0)
    two = np.zeros((20, 20), np.uint8)
    two[2:10, 2:10] = two[10:14, 10:14] = 255
    found = pixels.blobs(two, two, 10, 1000)
    assert len(found) == 1 and found[0][2:7] == (2, 2, 12, 12, 80)
    rows = spark.createDataFrame([(two.tobytes(), two.tobytes(), 20), (None, None, 20)], "m binary, g binary, w int")
    out = rows.select(pixels.blobs_of("m", "g", "w").alias("b"), pixels.sharpness_of("g", "w").alias("s")).collect()
    assert out[0].b == [] and out[0].s > 0 and out[1].s is None
    assert pixels.arena(np.pad(np.full((40, 40), 220, np.uint8), 20)).sum() == 1600
