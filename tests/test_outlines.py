import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrain.functions import numeric as num
from reelgrain.functions import pixels as px
from reelgrain.functions import splat
from reelgrain.operators import aggregates, cloud, grouping, outlines, sampling, sequences
from reelgrain.sources import documents, sinks

PIX = "frame long, k int, x int, y int, v int, fg boolean, moved boolean, outside boolean"


def window(mask, size, test):
    r = size // 2
    h, w = mask.shape
    return np.array([[test(mask[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]) for x in range(w)] for y in range(h)])


def test_grown_and_shrunk_against_brute_force():
    mask = np.random.default_rng(0).random((17, 23)) > 0.7
    for size in (3, 5):
        assert (px.grown(mask, size) == window(mask, size, np.any)).all()
        assert (px.shrunk(mask, size) == window(mask, size, np.all)).all()


def test_smoothed_keeps_a_flat_picture_and_a_spike():
    assert (px.smoothed(np.full((9, 9), 77)) == 77).all()
    spike = np.zeros((9, 9), int)
    spike[4, 4] = 256
    assert px.smoothed(spike)[4].tolist() == [0, 0, 6, 24, 36, 24, 6, 0, 0]


def test_changed_finds_a_robot_under_another_light():
    rng = np.random.default_rng(1)
    plate = rng.integers(90, 130, (80, 100)).astype(np.uint8)
    mask = np.ones((80, 100), np.uint8)
    gray = np.clip(np.rint(plate * 0.8), 0, 255).astype(np.uint8)
    gray[30:52, 40:66] = rng.integers(180, 250, (22, 26))
    gray[5, 5] = 255  # a speck
    on = px.changed(gray, plate, mask)
    assert on[34:48, 44:62].all() and not on[:22].any() and not on[:, :30].any()
    mask[:, 50:] = 0
    assert not px.changed(gray, plate, mask)[:, 60:].any()
    assert not px.changed(gray, plate, np.zeros_like(mask)).any()


def test_patch_is_found_where_it_went():
    rng = np.random.default_rng(2)
    gray = rng.integers(0, 255, (120, 160)).astype(np.uint8)
    patch = px.patch_at(gray, 70, 60, 15)
    assert patch.shape == (30, 30)
    moved = np.roll(gray, (7, -11), (0, 1))
    assert px.find_patch(moved, patch, (70, 60), 30, 0.7) == (59, 67)
    assert px.find_patch(rng.integers(0, 255, (120, 160)), patch, (70, 60), 30, 0.7) is None
    assert px.patch_at(gray, 3, 3, 5) is None
    flat = px.find_patch(np.zeros((120, 160)), patch, (70, 60), 30, 0.7)
    assert flat is None


def test_band_rotations_turn_harmonics():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    d = rng.normal(size=(40, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    for (lo, hi), m in zip(((0, 3), (3, 8), (8, 15)), splat.band_rotations(q)):
        assert np.allclose(splat.harmonics(d @ q.T)[:, lo:hi] @ m, splat.harmonics(d)[:, lo:hi])
        assert np.allclose(m @ m.T, np.eye(hi - lo))


def test_measures_with_nulls_and_nothing(spark):
    rows = [(1, 0, x, y, 10 * x, x > 1, None, None) for x in range(4) for y in range(2)] + [(1, 1, 5, 5, None, None, True, True)]
    df = spark.createDataFrame(rows, PIX)
    got = {r.k: r for r in outlines.described(df, ["frame", "k"]).collect()}
    assert (got[0].area, got[0].on_change, got[0].moving, got[0].at_edge, got[0].bbox, got[0].mean, got[0].centre) == (8, 0.5, 0.0, False, [0, 0, 3, 1], 15.0, [1, 0])
    assert (got[1].on_change, got[1].moving, got[1].at_edge, got[1].mean) == (0.0, 1.0, True, None)
    for f in (outlines.described, outlines.features):
        assert f(df.limit(0), ["frame", "k"]).count() == 0
    assert outlines.shared_pixels(df.limit(0), ["frame"], "k").count() == 0
    assert outlines.uncovered(df.limit(0), ["frame"], "k").count() == 0


def test_uncovered_takes_outlines_in_order(spark):
    rows = [(1, k, x, 0, 0, False, False, False) for k, xs in ((0, range(10)), (1, range(4, 10)), (2, range(8, 14)), (3, range(5, 10))) for x in xs] + [(1, None, 0, 0, 0, False, False, False), (1, 9, None, 0, 0, False, False, False)]
    got = outlines.uncovered(spark.createDataFrame(rows + rows, PIX), ["frame"], "k").collect()
    assert sorted(r.k for r in got) == [0, 2]


def test_kept_frames_stop_at_the_limit(spark):
    df = spark.createDataFrame([("a", i, i != 6) for i in range(20)] + [("b", 3, None)], "clip string, frame long, ok boolean")
    got = outlines.kept_frames(df, ["clip"], "frame", F.lit(2), 2, F.col("ok"), F.floor(F.col("frame") / 5), 4)
    assert sorted(r.frame for r in got.collect()) == [2, 4, 8, 10]
    assert outlines.kept_frames(df, ["clip"], "frame", F.lit(2), 2, F.col("ok"), F.floor(F.col("frame") / 5)).count() == 8


def test_points_on_a_mask_are_truncated_towards_zero(spark):
    mask = spark.createDataFrame([(0, 0), (3, 4)], "x int, y int")
    pts = spark.createDataFrame([(1, -0.5, 0.9), (2, 3.99, 4.0), (3, 4.0, 4.0), (4, None, 1.0)], "id int, cx double, cy double")
    assert sorted(r.id for r in outlines.on_mask(pts, "cx", "cy", mask).collect()) == [1, 2]


def test_signature_and_uniform_numbers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 6.0]), (2, [3.0, 3.0, 3.0])], "i long, v array<double>")
    got = {r.i: r.s for r in df.select("i", num.signature(F.col("v")).alias("s")).collect()}
    v = np.array([1.0, 2, 6])
    assert np.allclose(got[1], (v - v.mean()) / (v.std() + 1e-9)) and got[2] == [0, 0, 0]
    u = np.array([r.u for r in spark.range(4000).select(num.unit("id", seed=2).alias("u")).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02


def test_held_out_is_what_an_even_sample_leaves(spark):
    rows = [(k, i) for k, n in (("a", 1), ("b", 2), ("c", 10), ("d", 37)) for i in range(n)]
    for train in (0.9, 0.5, 1.0, 0.05):
        want = set()
        for k, n in (("a", 1), ("b", 2), ("c", 10), ("d", 37)):
            m = int(np.ceil(round(n * train, 9)))
            kept = {j * (n - 1) // (m - 1) if m > 1 else 0 for j in range(m)}
            want |= {(k, i) for i in range(n) if i not in kept}
        got = sequences.held_out(spark.createDataFrame(rows, "k string, i long"), ["k"], ["i"], F.floor(F.col("i") / 7), train)
        assert {(r.k, r.i) for r in got.collect()} == want


def test_camera_distance_in_blocks(spark):
    rng = np.random.default_rng(4)
    p, c = rng.normal(size=(50, 3)), rng.normal(size=(30, 3))
    pts = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(99, None, 0.0, 0.0)], "row_id long, x double, y double, z double")
    cams = spark.createDataFrame([tuple(map(float, v)) for v in c] + [(None, 0.0, 0.0)], "cx double, cy double, cz double")
    want = np.sqrt(((p[:, None] - c) ** 2).sum(axis=2)).min(axis=1)
    for block in (1000, 7):
        got = {r.row_id: r.cam_dist for r in cloud.camera_distance(pts, cams, block=block).collect()}
        assert got[99] is None and np.allclose([got[i] for i in range(50)], want)
    assert cloud.camera_distance(pts, cams.limit(0)).where("cam_dist is not null").count() == 0


def test_floor_is_refitted_to_all_points(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(-3, 3, (3000, 2))
    z = 0.1 * xy[:, 0] - 0.05 * xy[:, 1] + 0.5 + rng.normal(0, 0.004, 3000)
    rows = [(i, "s", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z))] + [(5000 + i, "s", *map(float, rng.uniform(-3, 3, 3))) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, scene string, x double, y double, z double")
    plane = cloud.floor_plane(df, ["scene"], sample=300, tries=400).first()
    p = np.array([r[2:] for r in rows])
    n = np.array([plane.nx, plane.ny, plane.nz])
    assert plane.inliers == (np.abs(p @ n - plane.d) < 0.02).sum() > 2900  # far more than the sample
    want = np.array([-0.1, 0.05, 1]) / np.linalg.norm([-0.1, 0.05, 1])
    assert np.allclose(n, want, atol=1e-3)
    assert cloud.floor_plane(df, ["scene"], tilt=1).count() == 0 and cloud.floor_plane(df.limit(0), ["scene"]).count() == 0


def test_named_groups(spark):
    frames = spark.createDataFrame([("a", 1, [5.0], None), ("a", 2, [6.0], [5.0]), ("a", 3, [1.0], [9.0]), ("a", 4, [9.0], None), ("b", 5, [1.0], None), ("a", 6, None, None)], "clip string, i int, f0 array<double>, f1 array<double>")
    centres = spark.createDataFrame([("a", [0.0], [10.0])], "clip string, c0 array<double>, c1 array<double>")
    got = {r.i: (r.first, r.second) for r in grouping.named(frames, centres, ["clip"]).collect()}
    assert got == {1: (0, None), 2: (1, 0), 3: (0, 1), 4: (1, None), 5: (None, None), 6: (None, None)}


def test_draws(spark):
    images = spark.range(3000).select(F.col("id").alias("image"), F.when(F.col("id") % 3 == 0, "c1").when(F.col("id") % 3 == 1, "c2").alias("clip"))
    pool = spark.createDataFrame([("a", "f1", "c1"), ("a", "f2", "c2"), ("b", "f0", "c1"), ("c", "f5", "c2"), ("d", "f9", None), (None, "f7", "c1")], "robot string, file string, clip string")
    got = sampling.other_group(images, pool, "image", "robot", "file", "clip", 1).join(images, "image").groupBy("clip", "robot").count().collect()
    n = {(r.clip, r.robot): r["count"] for r in got}
    assert ("c1", "a") not in n and ("c1", "b") not in n and ("c2", "c") not in n and sum(n.values()) == 3000
    assert abs(n["c1", "c"] - 500) < 90 and abs(n[None, "a"] - 250) < 70
    assert sampling.other_group(images, pool.where("robot = 'b'"), "image", "robot", "file", "clip", 1).count() == 2000
    assert sampling.two_level(images, pool.limit(0), "image", "robot", "file", 1).count() == 0
    out = sampling.accepted_until(spark, 50, {"u": num.unit("attempt", seed=3)}, F.col("u") < 0.01, start=7).collect()
    assert sorted(r.number for r in out) == list(range(7, 57)) and all(r.u < 0.01 for r in out)
    with pytest.raises(ValueError):
        sampling.accepted_until(spark, 5, {"u": F.lit(1.0)}, F.col("u") < 0, most=10_000)


def test_means_of_nothing_and_files(spark, tmp_path):
    o = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.5), (2, 1, 1.0)], "image long, point long, error double")
    r = aggregates.reconstruction_means(o, o).first()
    assert (r.error, r.track_length, r.seen_mean, r.seen_min, r.seen_max) == (1.0, 1.5, 1.5, 1, 2)
    assert aggregates.reconstruction_means(o.limit(0), o.limit(0)).first().error == float("inf")
    h = [[1.0, 0.0, 2.0], [0.0, 1.0, 3.5], [0.0, 0.0, 1.0]]
    sinks.homography(h, f"{tmp_path}/new/h.json")
    assert documents.homography(spark, f"{tmp_path}/new/h.json") == h
    with pytest.raises(ValueError):
        sinks.homography(h[:2], f"{tmp_path}/h.json")
    t = spark.createDataFrame([("a: 1\n train_split_fraction: 0.9\n",), ("none",), (None,)], "t string").select(documents.train_share(F.col("t")).alias("s"))
    assert [r.s for r in t.collect()] == [0.9, None, None]
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "f string"), spark.createDataFrame([("y",), ("z",)], "g string")
    assert sorted(r.name for r in documents.file_names(a, b).collect()) == ["x", "y", "z"]


def test_pace():
    from reelgrain.streaming import tracks

    class Query:
        recentProgress = [{"numInputRows": 50, "durationMs": {"triggerExecution": 500}}, {"numInputRows": 0, "durationMs": {"triggerExecution": 9}}]

    assert tracks.pace(Query) == {"batches": 1, "rows": 50, "rows_per_second": 100.0}
