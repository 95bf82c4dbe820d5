import random
from collections import defaultdict

from reelgrain.llm import graphs, splits

from .conftest import T0, robot


def closure(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_random_and_path(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(2000, 2000 + i) for i in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in closure(edges).items() if x != r}


def test_components_of_nothing(spark):
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graphs.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_source_forms(composed):
    rows = [
        (1, "r", ["cutout:x:rust:bout7:30", None]), (2, "r", ["pair:y::data/real/ Bout7 :00030.jpg"]), (3, "r", ["cutout:x:rust"]),
        (4, "r", ["mesh:x", "still:x:rust:bout7:60"]), (5, "r", None), (6, "r", ["lifted:z:a:BOUT7:0060"]), (6, "r", ["lifted:z:a:BOUT7:0060"]), (7, "r", ["a:b:c::9"]), (8, "r", ["a:b:c:x:none"]),
    ]
    got = splits.related_images(composed(rows)).collect()
    assert sorted((r.first_image_id, r.image_id) for r in got) == [(1, 2), (4, 6)]
    assert splits.related_images(composed([])).count() == 0


def test_splits_keep_components_and_shares(spark, composed, manifest):
    rng = random.Random(5)
    rows = [(i, "r", [f"cutout:x:p:bout{rng.randrange(40)}:{rng.randrange(30) * 30}" for _ in range(rng.choice([1, 1, 2]))]) for i in range(3000)]
    rows += [(10_000 + i, "r", ["cutout:x:p:hot:30"]) for i in range(800)]
    frames = manifest([(i, f"bout{i % 40} ", (i // 40) * 30, [robot(0)], T0, 0) for i in range(1200)])
    shares = spark.createDataFrame([("train", 80), ("validation", 10), ("test", 10)], "split_name string, share_pct int")
    got = splits.image_splits(composed(rows), shares).collect()
    assert len(got) == len(rows)
    of = defaultdict(set)
    for r in got:
        of[r.component].add(r.split_name)
    assert all(len(s) == 1 for s in of.values())
    size = defaultdict(int)
    for r in got:
        size[r.split_name] += 1
    assert sum(size.values()) == 3800 and size["train"] > size["test"]
    split = {r.image_id: r.split_name for r in got}
    placed = {(r.clip, r.frame): r.split_name for r in splits.frame_splits(composed(rows), frames, shares).collect()}
    assert len(placed) == 1200
    for i, _, sources in rows:
        for s in sources:
            clip, frame = s.split(":")[3:]
            if (clip, int(frame)) in placed:
                assert placed[(clip, int(frame))] == split[i]


def test_shares_are_near_without_heavy_components(spark, composed):
    rows = [(i, "r", [f"cutout:x:p:c:{i // 2}"]) for i in range(6000)]
    shares = spark.createDataFrame([("train", 80), ("validation", 10), ("test", 10)], "split_name string, share_pct int")
    got = {r.split_name: r["count"] for r in splits.image_splits(composed(rows), shares).groupBy("split_name").count().collect()}
    assert abs(got["train"] / 6000 - 0.8) < 0.03 and abs(got["test"] / 6000 - 0.1) < 0.03
