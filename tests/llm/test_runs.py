import random

import numpy as np

from reelgrain.llm import runs

from .conftest import T0, robot


def brute(rows):
    """rows: (clip, frame, boxes) in order, one per frame."""
    out, run = [], []
    for clip, frame, boxes in sorted(rows, key=lambda r: (r[0], r[1])):
        ok = False
        if run and run[-1][0] == clip and frame - run[-1][1] <= 60 and boxes and len(boxes) == len(run[-1][2]):
            close = np.array([[max(abs(a - b) for a, b in zip(x, y)) <= 4 for y in boxes] for x in run[-1][2]])
            ok = runs._matching(close)
        if ok:
            run.append((clip, frame, boxes))
        else:
            out.append(run)
            run = [(clip, frame, boxes)]
    out.append(run)
    return sorted((r[0][0], r[0][1], r[-1][1], len(r)) for r in out if len(r) >= 2)


def test_matching_needs_augmenting_paths():
    a = np.array([[1, 1, 0], [1, 0, 0], [0, 1, 1]], bool)
    assert runs._matching(a)
    assert not runs._matching(np.array([[1, 0], [1, 0]], bool))


def test_random_sequences_across_chunks(spark, manifest):
    rng = random.Random(1)
    rows, plain = [], []
    for clip in ("a", "b"):
        frame, boxes = 0, [(0, 0), (50, 5)]
        for _ in range(300):
            frame += rng.choice([30, 30, 60, 90])
            if rng.random() < 0.2:
                boxes = [(rng.randrange(0, 30), 0) for _ in range(rng.randrange(0, 6))]
            boxes = [(x + rng.randrange(-2, 3), y) for x, y in boxes]
            rng.shuffle(boxes)
            made = [robot(x, y) for x, y in boxes]
            rows.append((len(rows), rng.choice([clip, f" {clip.upper()} "]), frame, made, T0, 0))
            plain.append((clip, frame, [r[4] for r in made]))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = runs.repeated_runs(manifest(rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.clip, r.first_frame, r.last_frame, r.n_frames) for r in got) == brute(plain)
    assert all(r.duration == r.last_frame - r.first_frame for r in got)


def test_one_run_over_many_chunks_and_merge_levels(spark, manifest):
    rows = [(i, "hot", 30 * i, [robot(5)], T0, 0) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    got = runs.repeated_runs(manifest(rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.clip, r.first_frame, r.last_frame, r.n_frames) for r in got] == [("hot", 0, 14970, 500)]


def test_nulls_rewrites_and_empty(spark, manifest):
    import datetime as dt

    later = T0 + dt.timedelta(days=1)
    rows = [
        (1, "a", 0, [robot(0)], T0, 0),
        (2, "a", 30, [robot(100)], T0, 0), (2, "a", 30, [robot(1)], later, 0), (2, "a", 30, [robot(1)], later, 0),
        (3, "a", 60, None, T0, 0), (4, "a", 60 + 1, [robot(0)[:4] + (None, 1.0)], T0, 0),
        (5, "a", 90, [robot(2)], None, 0),
        (6, "b", 0, [], T0, 0), (7, "b", 30, [], T0, 0), (8, None, 0, [robot(0)], T0, 0), (9, "c", None, [robot(0)], T0, 0),
    ]
    got = runs.repeated_runs(manifest(rows)).collect()
    assert [(r.clip, r.first_frame, r.last_frame, r.n_frames) for r in got] == [("a", 0, 90, 3)]
    assert runs.repeated_runs(manifest([])).count() == 0


def test_tolerance_and_gap_borders(manifest):
    rows = [(1, "a", 0, [robot(0)], T0, 0), (2, "a", 60, [robot(4)], T0, 0), (3, "a", 121, [robot(4)], T0, 0), (4, "a", 150, [robot(9)], T0, 0)]
    got = runs.repeated_runs(manifest(rows)).collect()
    assert [(r.first_frame, r.last_frame) for r in got] == [(0, 60)]
