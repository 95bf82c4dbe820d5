import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reelgrain.llm import calibrate


def test_newton_meets_overlapping_moments():
    # two margins at once: rows are cells of a 2 x 3 table
    x = np.array([[a == 0, a == 1, b == 0, b == 1] for a in range(2) for b in range(3)], float)
    base = np.array([10.0, 20, 5, 8, 9, 30])
    size = calibrate.newton_dual(x, base, np.array([12.0, 18, 6, 9]))
    assert np.allclose(x.T @ size, [12, 18, 6, 9], atol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40), st.integers(0, 6)), min_size=1, max_size=8), st.integers(0, 200))
def test_expected_sizes_hold_bounds_and_total(cells, size):
    n, share, floor = (np.array(c) for c in zip(*cells))
    got = calibrate.expected_sizes(n, share, floor, size)
    low = np.minimum(n, floor)
    assert (got >= low - 1e-6).all() and (got <= n + 1e-6).all()
    assert abs(got.sum() - min(max(size, low.sum()), n.sum())) < 1e-3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=60), st.integers(0, 10**6))
def test_pivotal_keeps_the_sum(p, seed):
    p = np.array(p)
    out = calibrate.pivotal(p.copy(), np.random.default_rng(seed))
    assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 1
    assert abs(out.sum() - p.sum()) < 1e-4


def test_pivotal_keeps_probabilities():
    p = np.array([0.2, 0.5, 0.8, 0.3, 0.7, 0.5])
    hits = np.mean([calibrate.pivotal(p.copy(), np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(hits - p).max() < 0.04


def test_sample_and_report(spark, composed):
    rows = [(i, "a", [f"cutout:{'Iron-Moth' if i % 3 else 'rust jaw'}:p:c:{i}", None]) for i in range(300)] + [(0, "a", ["cutout:rust jaw:p:c:0", None])]
    rows += [(1000 + i, "b", ["mesh"]) for i in range(10)] + [(2000, "c", None), (None, "a", ["cutout:x:p:c:1"]), (3000, None, ["cutout:x:p:c:1"])]
    targets = spark.createDataFrame([("ironmoth", 60, 5), ("rustjaw", 35, 5), ("gullwhack", 5, 2)], "robot string, share_pct int, min_rows int")
    drawn, report, kinds = calibrate.sample(composed(rows), targets)
    got = {(r.run, r.robot): r for r in report.collect()}
    assert len(got) == 9
    assert got["a", "ironmoth"].entries == 200 and got["a", "ironmoth"].size == 60 and got["a", "ironmoth"].gap == 0
    assert got["a", "ironmoth"].drawn + got["a", "rustjaw"].drawn == 60
    assert abs(got["a", "ironmoth"].drawn - 60 * 60 / 95) <= 1
    assert {k for k, r in got.items() if r.gap > 0} == {("a", "gullwhack")} | {(x, t) for x in "bc" for t in ("ironmoth", "rustjaw", "gullwhack")}
    assert got["c", "gullwhack"].size == 0 and got["c", "gullwhack"].gap == 2
    assert {(r.run, r.kind): r.entries for r in kinds.collect()} == {("a", "cutout"): 300}
    d = drawn.collect()
    assert len({(r.image_id, r.k) for r in d}) == len(d) == 60
    again = calibrate.sample(composed(rows), targets)[0].collect()
    assert sorted(d) == sorted(again)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda r: st.lists(st.lists(st.integers(0, 60), min_size=4, max_size=4), min_size=r, max_size=r)), st.lists(st.floats(0, 1), min_size=5, max_size=5))
def test_tilted_holds_robots_and_bounds(counts, part):
    n = np.array(counts)
    robots = n.sum(axis=1) * np.array(part[: len(n)])
    got = calibrate.tilted(n, robots)
    assert (got >= 0).all() and (got <= n + 1e-6).all()
    assert np.allclose(got.sum(axis=1), robots, atol=1e-4)


def test_tilted_meets_both_margins_where_it_can():
    # robot 0 comes mostly from kind 0; giving it less would take kind 0 along
    n = np.array([[900, 300], [300, 400]])
    robots = np.array([100.0, 200.0])
    got = calibrate.tilted(n, robots)
    assert np.allclose(got.sum(axis=0), n.sum(axis=0) / n.sum() * 300, atol=1)
    plain = n * (robots / n.sum(axis=1))[:, None]
    assert abs(plain.sum(axis=0)[0] - 189.5) > 25
    # odds ratios are those of the entries: only margins are tilted
    assert np.isclose(got[0, 0] * got[1, 1] / (got[0, 1] * got[1, 0]), 4, rtol=0.01)


def test_kinds_keep_their_shares_in_the_sample(spark, composed):
    rows = [(i, "a", [f"{'pair' if i % 4 else 'cutout'}:ironmoth:p:c:{i}"]) for i in range(400)] + [(1000 + i, "a", [f"{'cutout' if i % 4 else 'pair'}:rustjaw:p:c:{i}"]) for i in range(1200)]
    targets = spark.createDataFrame([("ironmoth", 70, 5), ("iron moth", 10, 5), ("rustjaw", 30, 5)], "robot string, share_pct int, min_rows int")
    drawn, report, kinds = calibrate.sample(composed(rows), targets)
    assert {(r.robot, r.drawn) for r in report.collect()} == {("iron moth", 224), ("rustjaw", 96)}
    got = {r.kind: r for r in kinds.collect()}
    # 120 pairs would be their share; ironmoth's 224 need 124, as it has 100 others. Untilted there would be 192.
    assert abs(got["pair"].expected - 124) < 0.5 and abs(got["cutout"].expected - 196) < 0.5
    assert all(abs(r.drawn - r.expected) < 12 for r in got.values())
    assert drawn.count() == 320


def test_chunks_of_a_hot_category(spark, composed, monkeypatch):
    monkeypatch.setattr(calibrate, "CHUNK", 40)
    rows = [(i, "a", [f"cutout:{'ironmoth' if i % 10 else 'rustjaw'}:p:c:{i}"]) for i in range(1000)]
    targets = spark.createDataFrame([("ironmoth", 50, 5), ("rustjaw", 50, 5)], "robot string, share_pct int, min_rows int")
    report = {r.robot: r for r in calibrate.sample(composed(rows), targets)[1].collect()}
    assert report["ironmoth"].drawn == 100 and report["rustjaw"].drawn == 100


def test_empty(spark, composed):
    targets = spark.createDataFrame([("ironmoth", 100, 5)], "robot string, share_pct int, min_rows int")
    drawn, report, kinds = calibrate.sample(composed([]), targets)
    assert drawn.count() == 0 and report.count() == 0 and kinds.count() == 0
