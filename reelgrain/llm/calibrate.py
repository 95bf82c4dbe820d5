"""Problem 2: a sample whose category shares match given targets, with floors and a report of gaps.

Method: calibration by Newton iterations on the exponential-tilting dual. Category moments (entries per run, robot and
kind of source) are aggregated over all rows; per run the dual is solved on those moments for two margins at once: the
robots' shares are the targets, the kinds' shares those of the run's own entries, so that tilting to the targets does not
turn a run of mixed sources into one of a single kind. Robots' sizes are met exactly; where the kinds can't be, a small
ridge on their multipliers leaves them as near as the entries allow. The resulting probabilities are sampled by the
pivotal method: units duel within chunks of a robot, the one undecided unit of each chunk duels on within its robot, that
of each robot within the run. So a robot gets the whole number below or above its expected size and a run exactly its
total, and no task holds more than ``CHUNK`` units of a hot robot.

Defined results: an image counts once (the latest of repeated rows); entries with null ``source`` and rows with null
``run`` or ``image_id`` are left out; entries whose robot is no target count for the sample size but are never
drawn; targets whose names normalise alike are one; more than ``MOST_TARGETS`` targets are refused; a category with no more entries than its floor is taken whole; a run without entries has sample size 0 and
lacks every floor; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.llm.graphs import join_unique
from reelgrain.sources.scratch import Scratch
from reelgrain.sources.tables import latest

CHUNK = 32_768
FRACTION = 5
SEED = 7
EPS = 1e-7
RIDGE = 1e-4
MOST_TARGETS = 10_000


def entries_of(composed: DataFrame) -> DataFrame:
    """``run, image_id, k, robot, kind``: one row per entry; ``robot`` is null where ``source`` names none."""
    raw = composed.where("run is not null and image_id is not null").select("image_id", "written_at", "run", F.transform("robots", lambda r: r["source"]).alias("sources"))
    each = latest(raw, ["image_id"], "written_at", ["run", "sources"]).select("run", "image_id", F.posexplode("sources").alias("k", "source"))
    robot = F.lower(F.regexp_replace(F.get(F.split("source", ":"), F.lit(1)), r"[\s_-]+", ""))
    kind = F.lower(F.regexp_replace(F.get(F.split("source", ":"), F.lit(0)), r"\s+", ""))
    return each.where("source is not null").select("run", "image_id", "k", robot.alias("robot"), kind.alias("kind"))


def newton_dual(x: np.ndarray, base: np.ndarray, target: np.ndarray, rounds: int = 100, ridge: np.ndarray | float = 0.0) -> np.ndarray:
    """Expected sizes ``base * exp(x @ lam)`` whose moments ``x.T @ size`` equal ``target``.

    Minimises the convex dual sum(base * exp(x lam)) - lam target + ridge lam² / 2 by Newton steps with halving. A moment with
    a ``ridge`` gives way where it can't be met.
    """
    lam = np.zeros(x.shape[1])
    value = lambda v: float(np.sum(base * np.exp(np.clip(x @ v, -50, 50))) - v @ target + np.sum(ridge * v * v) / 2)
    for _ in range(rounds):
        size = base * np.exp(np.clip(x @ lam, -50, 50))
        gradient = x.T @ size - target + ridge * lam
        if np.abs(gradient).max(initial=0) < 1e-9 * max(1.0, target.max(initial=0)):
            break
        hessian = (x * size[:, None]).T @ x + np.diag(np.zeros(len(lam)) + ridge)
        step = np.linalg.solve(hessian + np.eye(len(lam)) * 1e-12 * max(1.0, np.trace(hessian)), gradient)
        scale, now = 1.0, value(lam)
        while scale > 1e-6 and value(lam - scale * step) > now + 1e-12 * abs(now):
            scale /= 2
        lam = lam - scale * step
    return base * np.exp(np.clip(x @ lam, -50, 50))


def expected_sizes(entries: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int) -> np.ndarray:
    """Expected sample size per category: as near to the shares as the floors and the entries at hand allow.

    Categories at a bound (floor below, all entries above) are fixed there; the rest is tilted to the total, until
    none leaves its bounds.
    """
    low, high = np.minimum(entries, floor).astype(float), entries.astype(float)
    total = float(min(max(size, low.sum()), high.sum()))
    fixed, out = high <= low, low.copy()
    while not fixed.all():
        free = ~fixed
        left = total - out[fixed].sum()
        weight = np.maximum(share[free].astype(float), 1e-9)
        # one moment a category: its share of what is left
        got = newton_dual(np.eye(free.sum()), high[free] * max(left, 1e-12) / max(high[free].sum(), 1.0), weight / weight.sum() * max(left, 0.0))
        below, above = got < low[free] - EPS, got > high[free] + EPS
        short, over = (low[free] - got)[below].sum(), (got - high[free])[above].sum()
        out[free] = got
        at = np.flatnonzero(free)
        if not below.any() and not above.any():
            break
        if short >= over:  # the side that moves the total more is fixed first
            out[at[below]] = low[at[below]]
            fixed[at[below]] = True
        if over >= short:
            out[at[above]] = high[at[above]]
            fixed[at[above]] = True
    return np.clip(out, low, high)


def tilted(counts: np.ndarray, robots: np.ndarray) -> np.ndarray:
    """Expected sizes per (robot, kind) within ``counts``, with row sums ``robots`` and column shares as in ``counts``.

    Both margins go into one dual. A cell tilted beyond its entries is taken whole and the rest is solved again.
    """
    n = counts.astype(float)
    out, whole = np.zeros_like(n), np.zeros(n.shape, bool)
    kinds = n.sum(axis=0) / max(n.sum(), 1.0) * robots.sum()
    while True:
        left = robots - (out * whole).sum(axis=1)
        r, k = np.nonzero((n > 0) & ~whole & (left > EPS)[:, None])
        if not len(r):
            break
        rows, columns = np.unique(r), np.unique(k)
        x = np.hstack([r[:, None] == rows, k[:, None] == columns[:-1]]).astype(float)  # the last kind follows from the others
        room = (n * ~whole).sum(axis=1)
        base = n[r, k] * left[r] / room[r]
        target = np.append(left[rows], np.maximum(kinds - (out * whole).sum(axis=0), 0)[columns[:-1]])
        ridge = np.append(np.zeros(len(rows)), np.full(len(columns) - 1, RIDGE * robots.sum()))
        out[~whole] = 0
        out[r, k] = newton_dual(x, base, target, ridge=ridge)
        over = ~whole & (out > n + EPS)
        if not over.any():
            break
        out[over], whole = n[over], whole | over
    out = np.minimum(out, n)
    # rounding of the solver must not move a robot's size
    missing = robots - out.sum(axis=1)
    room = np.where(missing[:, None] > 0, n - out, out)
    return np.clip(out + room * (missing / np.maximum(room.sum(axis=1), 1e-12))[:, None], 0, n)


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Duels of units in order; returns probabilities 0 or 1 but for at most one, with the same sum."""
    p = np.where(p > 1 - EPS, 1.0, np.where(p < EPS, 0.0, p))
    open_units = np.flatnonzero((p > 0) & (p < 1))
    if len(open_units) < 2:
        return p
    draws = rng.random(len(open_units)).tolist()
    values = p[open_units].tolist()
    won = [0.0] * len(values)
    i, a = 0, values[0]
    for j in range(1, len(values)):
        b, s = values[j], a + values[j]
        if s < 1 - EPS:
            if draws[j] * s >= a:
                i = j
            a = s
        else:
            first = draws[j] * (2 - s) < 1 - b
            won[i if first else j] = 1.0
            i, a = (j if first else i), max(0.0, s - 1)
        if a < EPS:  # nobody is left undecided: the next unit starts anew
            a = 0.0
    won[i] = max(won[i], 0.0 if a < EPS else 1.0 if a > 1 - EPS else a)
    p[open_units] = won
    return p


def _duels(keys: list[str], seed: int, shuffled: bool = False):
    """Duels within each ``keys`` of the rows given, in order or, ``shuffled``, in random order; losers are dropped."""

    def duel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["robot", "image_id", "k"], ignore_index=True)
        p = pdf["p"].to_numpy(float).copy()
        for name, rows in pdf.groupby(keys, sort=True).indices.items():
            name = name if isinstance(name, tuple) else (name,)
            at = pd.util.hash_array(np.array(["\x1f".join(map(str, name))], object))[0]
            rng = np.random.default_rng([seed, int(at)])
            order = rows[rng.permutation(len(rows))] if shuffled else rows
            p[order] = pivotal(p[order], rng)
        pdf["p"] = p
        return pdf[pdf["p"] > 0]

    return duel


def calibrated(composed: DataFrame, targets: DataFrame, fraction: int = FRACTION) -> tuple[DataFrame, DataFrame]:
    """``(entries, cells)``: the entries, and per run, target robot and kind its moments and expected sizes.

    A robot without entries has one cell of null kind. ``robot_expected`` is the robot's, ``expected`` the cell's.
    """
    entries = entries_of(composed)
    want = targets.where("robot is not null").select(F.lower(F.regexp_replace("robot", r"[\s_-]+", "")).alias("robot"), F.col("robot").alias("named"), "share_pct", "min_rows")
    # names that normalise alike are one target
    want = want.groupBy("robot").agg(F.min("named").alias("named"), F.coalesce(F.max("share_pct"), F.lit(0)).alias("share_pct"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
    listed = want.limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    want = composed.sparkSession.createDataFrame(listed, want.schema)
    moments = entries.groupBy("run", "robot", "kind").agg(F.count(F.lit(1)).alias("n"))
    sizes = moments.groupBy("run").agg(F.floor(F.sum("n") / fraction).cast("long").alias("size"))
    runs = composed.where("run is not null").select("run").distinct().join(sizes, "run", "left").select("run", F.coalesce("size", F.lit(0)).alias("size"))
    # runs x targets: targets is a counted list of categories, every pair is a row of the report
    cells = runs.join(F.broadcast(want)).join(moments, ["run", "robot"], "left")
    needed = F.greatest(F.col("min_rows").cast("long"), F.floor(F.col("share_pct") * F.col("size") / 100).cast("long"))
    cells = cells.select("run", "robot", "named", F.col("share_pct").cast("int").alias("share_pct"), "kind", F.coalesce("n", F.lit(0)).alias("n"), "size", needed.alias("needed"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["robot", "kind"], ignore_index=True)
        robot, at = np.unique(pdf["robot"], return_index=True)
        row = np.searchsorted(robot, pdf["robot"])
        kind, column = np.unique(pdf["kind"].fillna(""), return_inverse=True)
        counts = np.zeros((len(robot), len(kind)), np.int64)
        np.add.at(counts, (row, column), pdf["n"].to_numpy())
        own = counts.sum(axis=1)
        robots = expected_sizes(own, pdf["share_pct"].to_numpy()[at], pdf["needed"].to_numpy()[at], int(pdf["size"].iloc[0]))
        pdf["entries"], pdf["robot_expected"] = own[row], robots[row]
        pdf["expected"] = tilted(counts, robots)[row, column]
        return pdf

    shape = "run string, robot string, named string, share_pct int, kind string, n long, size long, needed long, entries long, robot_expected double, expected double"
    return entries, cells.groupBy("run").applyInPandas(solve, shape)


def sample(composed: DataFrame, targets: DataFrame, fraction: int = FRACTION, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(drawn, report, kinds)``.

    ``drawn``: ``run, robot, image_id, k, kind, probability`` of the drawn entries. ``report``: per run and target robot
    ``entries, size, needed, expected, drawn, gap``; ``gap`` is how many entries the floor lacks, 0 where it is met.
    ``kinds``: per run and kind of source ``entries, expected, drawn`` over the target robots.
    """
    scratch = Scratch(composed.sparkSession, "sample")
    entries, cells = calibrated(composed, targets, fraction)
    cells = scratch.write(cells)
    p = cells.where("n > 0 and expected > 0").select("run", "robot", "kind", (F.col("expected") / F.col("n")).alias("probability"), F.ceil(F.col("entries") / CHUNK).cast("int").alias("chunks"), "n")
    total = cells.agg(F.sum("n")).first()[0] or 0
    keyed = p.select(F.struct("run", "robot", "kind").alias("cell"), "probability", "chunks", "n")
    units = join_unique(entries.where("robot is not null").select(F.struct("run", "robot", "kind").alias("cell"), "image_id", "k"), keyed, "cell", "n", total)
    units = units.select("cell.*", "image_id", "k", "probability", F.col("probability").alias("p"), F.pmod(F.xxhash64("image_id", "k"), F.col("chunks")).cast("int").alias("chunk"), (F.col("chunks") > 1).alias("parted"))
    shape = "run string, robot string, kind string, image_id long, k int, probability double, p double, chunk int, parted boolean"
    # the categories of a run duel in one call per chunk: at most CHUNK units of each category
    first = scratch.write(units.groupBy("run", "chunk").applyInPandas(_duels(["run", "robot", "chunk"], seed, True), shape))
    second = first.where("p < 1 and parted").groupBy("run", "robot").applyInPandas(_duels(["run", "robot"], seed + 1), shape)
    second = scratch.write(second)
    open_ = first.where("p < 1 and not parted").unionByName(second.where("p < 1"))
    third = open_.groupBy("run").applyInPandas(_duels(["run"], seed + 2), shape)
    drawn = scratch.write(first.where("p = 1").unionByName(second.where("p = 1")).unionByName(third.where("p > 0.5")).select("run", "robot", "image_id", "k", "kind", "probability"))
    got = drawn.groupBy("run", "robot").agg(F.count(F.lit(1)).alias("drawn"))
    robots = cells.groupBy("run", "robot", "named", "share_pct", "entries", "size", "needed").agg(F.max("robot_expected").alias("expected"))
    report = robots.join(got, ["run", "robot"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    gap = F.greatest(F.col("needed") - F.col("drawn"), F.lit(0))
    report = report.select("run", F.col("named").alias("robot"), "share_pct", "entries", "size", "needed", "expected", "drawn", gap.alias("gap"))
    kinds = cells.where("n > 0").groupBy("run", "kind").agg(F.sum("n").alias("entries"), F.sum("expected").alias("expected"))
    kinds = kinds.join(drawn.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("drawn")), ["run", "kind"], "left")
    return drawn, report, kinds.select("run", "kind", "entries", "expected", F.coalesce("drawn", F.lit(0)).alias("drawn"))
