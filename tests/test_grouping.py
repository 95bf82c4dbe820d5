import numpy as np
from pyspark.sql import functions as F

from reelgrain.operators import aggregates, grouping, sampling


def brute(f0, f1, a0, a1, decides, rounds=20):
    x = np.concatenate([f0, f1])
    z = lambda f: (f - x.mean(0)) / (x.std(0) + 1e-9)
    f0, f1 = z(f0), z(f1)
    w0, w1 = np.minimum(1, a0 / 4000), np.minimum(1, a1 / 4000)
    swapped = f1[:, decides] > f0[:, decides]
    for _ in range(rounds):
        p, q = np.where(swapped[:, None], f1, f0), np.where(swapped[:, None], f0, f1)
        wp, wq = np.where(swapped, w1, w0), np.where(swapped, w0, w1)
        c, d = (p * wp[:, None]).sum(0) / wp.sum(), (q * wq[:, None]).sum(0) / wq.sum()
        straight = w0 * ((f0 - c) ** 2).sum(1) + w1 * ((f1 - d) ** 2).sum(1)
        crossed = w0 * ((f0 - d) ** 2).sum(1) + w1 * ((f1 - c) ** 2).sum(1)
        new = crossed < straight
        if (new == swapped).all():
            break
        swapped = new
    return swapped


def test_two_groups_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for clip in "ab":
        n = 60
        one, two = rng.normal([5, 1, 0], 1.5, (n, 3)), rng.normal([3, -1, 1], 1.5, (n, 3))
        flip = rng.random(n) < 0.5
        f0, f1 = np.where(flip[:, None], two, one), np.where(flip[:, None], one, two)
        a0, a1 = rng.integers(500, 9000, n), rng.integers(500, 9000, n)
        got = brute(f0, f1, a0, a1, 0)
        for i in range(n):
            rows.append((clip, i, f0[i].tolist(), f1[i].tolist(), int(a0[i]), int(a1[i])))
            want[clip, i] = bool(got[i])
    rows += [("a", 999, None, [0.0] * 3, 5, 5), ("c", 0, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 10, 10)]
    df = spark.createDataFrame(rows, "clip string, frame long, f0 array<double>, f1 array<double>, a0 int, a1 int")
    got = grouping.two_groups(df, ["clip"], ["frame"], 3, 0).collect()
    assert {(r.clip, r.frame): r.swapped for r in got} == {**want, ("c", 0): False}
    assert all(r.sound for r in got if r.clip != "c") and not any(r.sound for r in got if r.clip == "c")
    assert grouping.two_groups(df.limit(0), ["clip"], ["frame"], 3, 0).count() == 0


def test_layout_helpers(spark):
    px = spark.createDataFrame([(1, 0, 5, 7, True), (1, 0, 6, 9, True), (1, 0, 6, 10, False), (1, 1, 0, 0, False)], "image long, k int, x int, y int, seen boolean")
    got = {r.k: r for r in aggregates.visible_boxes(px, ["image", "k"]).collect()}
    assert got[0].box == [5, 7, 6, 9] and abs(got[0].share - 2 / 3) < 1e-9 and got[1].box is None and got[1].share == 0
    seen = spark.createDataFrame([(1, 45, 100), (1, 90, 100), (2, 44, 100), (3, None, 5)], "image long, seen int, whole int")
    assert [r.image for r in aggregates.accepted_layout(seen, "image", "seen", "whole").collect()] == [1]
    rows = spark.createDataFrame([(1, 0.2), (2, 0.0)], "image long, gain double")
    met = sampling.meeting(rows, "image", F.col("step") * F.col("gain"), F.col("step") * 50, F.lit(0.0)).collect()
    assert [(r.image, r.step) for r in met] == [(1, 3)]
    pool = spark.createDataFrame([("a", "1", "c1"), ("a", "2", "c2"), ("b", "1", "c2"), ("d", "1", None)], "robot string, file string, clip string")
    assert sorted({r.robot for r in sampling.pool_avoiding(pool, "robot", "clip", "c1").collect()}) == ["b", "d"]
