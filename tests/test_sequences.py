import math
import random

import pytest
from pyspark.sql import functions as F

from reelgrain.operators import folds, ranks, sequences

SCHEMA = "k string, t long, v double, f boolean"


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for k in ("a", "b", None):
        t = 0
        for _ in range(n if k == "a" else 30):
            t += rng.choice([1, 2, 5, 40])
            out.append((k, t, None if rng.random() < 0.1 else rng.randrange(100) / 4, rng.choice([True, True, False, None])))
    rng.shuffle(out)
    return out


@pytest.fixture
def df(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


def grouped(rows):
    keys = {r[0] for r in rows}
    return {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in keys}


def bucket():
    return F.floor(F.col("t") / 50)


def test_numbered_across_buckets(df):
    got = {(r.k, r.t): r.rn for r in ranks.numbered(df, ["k"], ["t"], bucket()).collect()}
    assert got == {(k, r[1]): i + 1 for k, own in grouped(rows_of()).items() for i, r in enumerate(own)}


def test_runs_and_longest(df):
    want = []
    for k, own in grouped(rows_of()).items():
        run = None
        for i, r in enumerate([*own, (k, 0, 0, False)], 1):
            if r[3]:
                run = run or i
            elif run:
                want.append((k, run, i - 1, i - run))
                run = None
    run = sequences.flagged_runs(df, ["k"], ["t"], bucket(), F.col("f"))
    assert sorted(map(tuple, run.collect()), key=str) == sorted(want, key=str)
    for later in (False, True):
        got = {r.k: (r.start, r.length) for r in sequences.longest(run, ["k"], later).collect()}
        for k in got:
            own = [w for w in want if w[0] == k]
            most = max(w[3] for w in own)
            starts = [w[1] for w in own if w[3] == most]
            assert got[k] == (max(starts) if later else min(starts), most)


def test_sessions_gap_is_inclusive(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 60), ("a", 121), ("a", 121), ("b", 5), ("a", 1000), ("a", 1060)], "k string, t long")
    got = sorted(tuple(r) for r in sequences.sessions(rows, ["k"], "t", 60, F.floor(F.col("t") / 100)).collect())
    assert got == [("a", 0, 60, 2), ("a", 121, 121, 2), ("a", 1000, 1060, 2), ("b", 5, 5, 1)]


def test_block_best_ties_and_last_block(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 3.0, 3.0, None, 2.0, 2.0, 9.0])], "k string, t long, v double")
    got = sorted((r.t, r.block) for r in sequences.block_best(rows, ["k"], ["t"], F.floor(F.col("t") / 2), "v", 3).collect())
    assert got == [(1, 0), (4, 1)]


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (5, 1), (5, 5), (5, 9), (97, 12), (100, 7)])
def test_even_sample(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "t")
    got = sorted(r.t for r in sequences.even_sample(df, ["t"], F.floor(F.col("t") / 10), k).collect())
    m = min(k, n)
    want = sorted({0 if m == 1 else int(i * (n - 1) / (m - 1)) for i in range(m)})
    assert got == want


def test_path_running_neighbours(df):
    clean = df.where("v is not null")
    rows = [r for r in rows_of() if r[2] is not None]
    got = {r.k: r.path for r in sequences.path_length(clean, ["k"], ["t"], ["v"], bucket()).collect()}
    for k, own in grouped(rows).items():
        if k is not None:
            assert math.isclose(got[k], sum(abs(b[2] - a[2]) for a, b in zip(own, own[1:])), abs_tol=1e-9)
    sums = {(r.k, r.t): r.s for r in sequences.running_sums(df, ["k"], ["t"], {"s": "v"}, bucket()).collect()}
    near = {(r.k, r.t): (r.p, r.q) for r in sequences.neighbours(df, ["k"], ["t"], bucket(), {"p": "t"}, {"q": "t"}).collect()}
    for k, own in grouped(rows_of()).items():
        total = 0.0
        for i, r in enumerate(own):
            total += r[2] or 0
            assert math.isclose(sums[k, r[1]], total, abs_tol=1e-9)
            assert near[k, r[1]] == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None)


def test_trail_stale_take_while(df):
    got = {(r.k, r.t): list(r.trail) for r in sequences.trail(df, ["k"], ["t"], "t", 7, bucket(), block=20).collect()}
    stale = {(r.k, r.t): r.stale for r in sequences.stale(df, ["k"], ["t"], bucket(), F.col("f")).collect()}
    kept = {(r.k, r.t) for r in folds.followed(df, ["k"], ["t"], F.col("v") > 24, bucket()).collect()}
    for k, own in grouped(rows_of()).items():
        since, gone = 0, False
        for i, r in enumerate(own):
            assert got[k, r[1]] == [x[1] for x in own[max(0, i - 6) : i + 1]]
            since = 0 if r[3] else since + 1
            assert stale[k, r[1]] == since
            gone = gone or (r[2] is not None and r[2] > 24)
            assert ((k, r[1]) in kept) == (not gone)


@pytest.mark.parametrize("keep", [0.9, 0.5, 0.999])
def test_ewma(df, keep):
    got = {(r.k, r.t): r.ewma for r in folds.ewma(df, ["k"], ["t"], "v", bucket(), keep).collect()}
    for k, own in grouped(rows_of()).items():
        s = None
        for r in own:
            if r[2] is not None:
                s = r[2] if s is None else keep * s + (1 - keep) * r[2]
            assert (got[k, r[1]] is None) == (s is None)
            assert s is None or math.isclose(got[k, r[1]], s, rel_tol=1e-9, abs_tol=1e-12)


def test_contact_fold_chain(spark):
    a, b, far = [0, 0, 10, 10], [80, 0, 90, 10], [500, 0, 510, 10]
    rows = [(0, [a, b]), (30, [[40, 0, 50, 10]]), (60, [[60, 0, 70, 10]]), (90, [far]), (120, [a]), (150, [a, b]), (180, None), (210, [a]), (240, [a, b, far]), (270, [[40, 0, 50, 10]])]
    df = spark.createDataFrame([("c", t, x) for t, x in rows], "clip string, frame long, boxes array<array<int>>")
    got = {r.frame for r in folds.contact_fold(df, ["clip"], "frame", "boxes", bucket=60).where("contact").collect()}
    assert got == {30, 60}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sequences.flagged_runs(none, ["k"], ["t"], bucket(), F.col("f")).count() == 0
    assert sequences.block_best(none, ["k"], ["t"], bucket(), "v", 3).count() == 0
    assert sequences.trail(none, ["k"], ["t"], "t", 3, bucket()).count() == 0
    assert folds.ewma(none, ["k"], ["t"], "v", bucket()).count() == 0


def test_small_ones(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 4.9), ("b", 1, None)], "k string, t long, v double")
    assert [tuple(r) for r in sequences.plateau(df, ["k"], "t", "v", 0.25).collect()] == [("a", 5.0, 2)]
    got = {r.k: (r.last, r.tail_mean) for r in sequences.last_and_tail(df, ["k"], ["t"], "v", 2).collect()}
    assert got["a"] == (4.9, pytest.approx(4.95)) and got["b"] == (None, None)
    assert [r.t for r in sequences.every_nth(df.where("k = 'a'"), 2, 1, "t").orderBy("t").collect()] == [1, 3]
    assert sorted(r.t for r in folds.one_in(df, ["k"], ["t"], F.lit(0), F.col("v") > 0, 2).collect()) == [1, 3]
