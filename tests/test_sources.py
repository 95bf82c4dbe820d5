import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrain.functions import geometry as g
from reelgrain.sources import documents, schemas, sinks, video
from reelgrain.sources.tables import latest


def outline_doc(clip, frames):
    robot = {"area": 5, "on_change": 0.9, "moving": 0.2, "at_edge": False, "bbox": [0, 0, 9, 9], "mean": 4.0}
    return {"clip": clip, "source": "x.avi", "lit": [0, 90], "keep_every": 30, "seconds": 3, "items": [{"frame": f, "robots": [robot] * n, "missed": False, "extra": False, "unlabelled": 0.0} for f, n in frames]}


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(outline_doc("a", [(0, 2), (30, 0)])))
    got = documents.outline_items(spark, [f"{tmp_path}/a.json", f"{tmp_path}/missing.json"]).collect()
    assert [(r.clip, r.frame, len(r.robots), r.accepted) for r in got] == [("a", 0, 2, None), ("a", 30, 0, None)]
    assert documents.outline_items(spark, [f"{tmp_path}/none*.json"]).count() == 0
    for start in (0, 7):
        (tmp_path / f"manifest_{start}.json").write_text(json.dumps({"run": "r", "seed": 1, "start": start, "classes": {"0": "x"}, "items": [{"image": f"{start}.jpg", "kind": "one", "robots": [{"source": "mesh:a", "class": "o", "bbox": [1, 2, 3, 4], "visible": 1.0}]}]}))
    items = documents.composed_items(spark, [f"{tmp_path}/manifest_*.json"]).orderBy("image").collect()
    assert [(i.image, i.robots[0]["class"]) for i in items] == [("0.jpg", "o"), ("7.jpg", "o")]
    track = {"clip": "a", "tracks": [{"names": ["x", "y"], "frames": [{"frame": 5, "robots": [{"bbox": [0, 0, 1, 1]}, {"bbox": [2, 2, 3, 3]}, {"bbox": [4, 4, 5, 5]}]}]}]}
    (tmp_path / "tracks.json").write_text(json.dumps(track))
    assert [(r.k, r.robot) for r in documents.pair_poses(spark, [f"{tmp_path}/tracks.json"]).collect()] == [(0, "x"), (1, "y"), (2, None)]
    (tmp_path / "index.json").write_text(json.dumps([{"file": "s.png", "robot": "x"}, {"file": "t.png", "kind": "pair"}]))
    pool = documents.sprite_pool(spark, [f"{tmp_path}/index.json", f"{tmp_path}/no/index.json"]).orderBy("file").collect()
    assert [r.kind for r in pool] == ["cutout", "pair"] and pool[0].path.endswith("/s.png")


def test_labels_round_trip(spark, tmp_path):
    images = spark.createDataFrame([("00000.jpg",), ("00001.jpg",)], "image string")
    rows = spark.createDataFrame([("00000.jpg", 1, [0, 0, 9, 9]), ("00000.jpg", 0, [5, 5, 14, 14])], "image string, k int, box array<int>")
    sinks.label_files(images, rows.select("image", "k", g.label_row(F.col("box"), 20, 20).alias("line")), f"{tmp_path}/labels")
    assert (tmp_path / "labels/00001.txt").read_text() == ""
    got = documents.label_rows(spark, f"{tmp_path}/labels/*.txt").collect()
    assert [(r.image, r.cls, r.cx) for r in got] == [("00000", 0, 0.5), ("00000", 0, 0.25)]
    ok = spark.createDataFrame([(0.5, 0.5, 1.0, 1.0), (0.1, 0.5, 0.3, 0.2)], "cx double, cy double, w double, h double")
    assert [r[0] for r in ok.select(g.label_inside(*[F.col(c) for c in ("cx", "cy", "w", "h")])).collect()] == [True, False]
    assert "0: robot" in sinks.data_yaml(str(tmp_path), {0: "robot"})


def test_mesh(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 1\nv 1 0 2\nv 1 1 3\nv 0 1 6\nvt 0 0\nvn 0 0 1\nf 1/1/1 2/1/1 3/1/1 4/1/1\nf -1 -2 -3\n")
    v, f = documents.mesh(spark, f"{tmp_path}/m.obj")
    assert v.where("kind = 'v'").count() == 4
    rows = [(r.face, r.triangle, r.corner, r.v, r.vt) for r in f.orderBy("face", "triangle", "corner").collect()]
    assert rows == [(0, 0, 0, 0, 0), (0, 0, 1, 1, 0), (0, 0, 2, 2, 0), (0, 1, 0, 0, 0), (0, 1, 1, 2, 0), (0, 1, 2, 3, 0), (1, 0, 0, 3, None), (1, 0, 1, 2, None), (1, 0, 2, 1, None)]
    depth = {(r.face, r.triangle): r.depth for r in documents.face_depths(v, f).collect()}
    assert depth[0, 0] == 2.0 and depth[0, 1] == pytest.approx(10 / 3)


def test_ply_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, np.float32(rng.normal(size=3)))) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, z double")
    assert sinks.ply(df, ["x", "y", "z"], f"{tmp_path}/p.ply", "cleaned") == 500
    back = documents.ply_points(spark, f"{tmp_path}/p.ply", ["x", "y", "z"]).orderBy("row_id").collect()
    assert [(r.row_id, r.x, r.y, r.z) for r in back] == rows
    (tmp_path / "cut.ply").write_bytes((tmp_path / "p.ply").read_bytes()[:-1])
    with pytest.raises(Exception, match="bytes"):
        documents.ply_points(spark, f"{tmp_path}/cut.ply", ["x"]).count()


def test_reconstruction_files(spark, tmp_path):
    for name in ("0", "10", "2", "old"):
        (tmp_path / name).mkdir()
    image = struct.pack("<i7di", 1, 1, 0, 0, 0, 1, 2, 3, 1) + b"a.jpg\0" + struct.pack("<Q", 2) + struct.pack("<ddqddq", 0, 0, -1, 1, 1, 5)
    for name in ("0", "10", "old"):
        (tmp_path / name / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    (tmp_path / "0" / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 5, 1, 2, 3, 0, 0, 0, 0.5, 2) + struct.pack("<4i", 1, 0, 2, 0))
    assert [r.name for r in documents.submodels(spark, str(tmp_path)).collect()] == ["0", "10", "old"]
    assert documents.submodels(spark, f"{tmp_path}/none").count() == 0
    i = documents.registered_images(spark, f"{tmp_path}/0/images.bin").first()
    assert (i.name, i.tvec, i.point3d_ids) == ("a.jpg", [1.0, 2.0, 3.0], [-1, 5])
    p = documents.scene_points(spark, f"{tmp_path}/0/points3D.bin").first()
    assert (p.id, p.error, p.image_ids) == (5, 0.5, [1, 2])
    for name in ("b.JPG", "a.png", "x.txt"):
        (tmp_path / name).write_bytes(b"")
    assert [r.name for r in documents.listing(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]


def test_event_files(spark, tmp_path):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    value = field(1, b"psnr") + bytes([2 << 3 | 5]) + struct.pack("<f", 21.5)
    event = bytes([2 << 3, 100]) + field(5, field(1, value))
    (tmp_path / "events").write_bytes((struct.pack("<Q", len(event)) + b"0000" + event + b"0000") * 2)
    assert [tuple(r) for r in documents.training_metrics(spark, f"{tmp_path}/events").collect()] == [("psnr", 100, 21.5)] * 2


def test_raw_video(spark, tmp_path):
    frames = [np.full((6, 8), i, np.uint8) for i in range(50)]
    path = f"{tmp_path}/v.y4m"
    video.write_video(path, frames, (98, 1))
    spark.dataSource.register(video.RawVideo)
    df = spark.read.format("rawvideo").option("path", path).load()
    rows = df.orderBy("frame").collect()
    assert len(rows) == 50 and rows[49].ts == pytest.approx(0.5) and set(rows[7].gray) == {7}
    some = spark.read.format("rawvideo").option("path", path).option("start", 5).option("stop", 41).option("every", 10).load()
    assert sorted(r.frame for r in some.collect()) == [5, 15, 25, 35]
    assert video.frame_at(df, 20).first().frame == 20 and video.frame_at(df, 99).first().frame == 49
    assert tuple(video.throughput(df, 30).first()) == (30, pytest.approx(29 / 98))
    stream = spark.readStream.format("rawvideo").option("path", path).option("framesPerTask", 20).load()
    q = stream.select("frame").writeStream.format("memory").queryName("raw").start()
    try:
        q.processAllAvailable()
        assert spark.table("raw").count() == 50
    finally:
        q.stop()
    (tmp_path / "bad").write_bytes(b"no video")
    with pytest.raises(OSError):
        video.probe(f"{tmp_path}/bad")


def test_other_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, 0.01, "home", 1.234, 2.0, None, None, "blob"), (1, 0.01, "opponent", 5.0, 6.0, 1.23456, 2.0, "coast"), (2, 0.02, "home", 1.0, 2.0, None, None, "blob")], "frame long, time_s double, label string, px_x double, px_y double, x_m double, y_m double, source string")
    sinks.tracking_csv(t, ["home", "opponent"], f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True).orderBy("frame").collect()
    assert back[0].home_px_x == "1.23" and back[0].opponent_x_m == "1.2346" and back[0].home_x_m is None and back[1].opponent_source is None
    kept, aside = sinks.gate(spark.createDataFrame([("a", 0.05), ("b", 0.094), ("c", None)], "plate string, gap double"), F.col("gap") <= 0.09, f"{tmp_path}/gate")
    assert [r.plate for r in kept.collect()] == ["a"] and sorted(r.plate for r in aside.collect()) == ["b", "c"]
    assert sinks.report(spark.range(1).select(F.lit(0.5).alias("share"), F.struct(F.lit(1).alias("n")).alias("of")), f"{tmp_path}/r.json") == {"share": 0.5, "of": {"n": 1}}
    items = spark.createDataFrame([("a", 30, 1), ("a", 0, 2), ("b", 5, 3)], "clip string, frame long, n int")
    sinks.documents(items, ["clip"], ["frame"], f"{tmp_path}/docs")
    docs = {r.clip: [i["frame"] for i in r["items"]] for r in spark.read.json(f"{tmp_path}/docs").collect()}
    assert docs == {"a": [0, 30], "b": [5]}
    sinks.parts(items, "frame", 20, f"{tmp_path}/parts")
    assert {r.part for r in spark.read.json(f"{tmp_path}/parts").select("part").distinct().collect()} == {0, 20}
    assert [r.name for r in sinks.renumbered(items.where("clip = 'a'"), ["frame"]).orderBy("frame").collect()] == ["frame_00001.png", "frame_00002.png"]
    assert schemas.MATRIX and documents.frame_list_gaps(spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([("x",)], "name string")).first() == (2, 1)


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", None, 9), ("a", 1, 7), ("b", None, None)], "k string, t int, v int")
    assert sorted(map(tuple, latest(df, ["k"], "t", ["v"]).collect())) == [("a", 7), ("b", None)]
