"""Two groups of outlines per clip, where the two outlines of one frame never share a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.sources.scratch import Scratch


def _gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def named(frames: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """``frames`` (``f0`` and, where a second outline is there, ``f1``) with ``first, second``: the group 0 or 1 of each, by
    the ``centres`` (``c0, c1``) of their key.

    One outline goes to the nearer centre, two the cheaper way round, so that they come out different (ties: as they stand).
    Null features or a key without centres give null names.
    """
    both = frames.join(centres.select(*keys, "c0", "c1"), keys, "left")
    gap = lambda f, c: _gap(F.col(f).cast("array<double>"), F.col(c).cast("array<double>"))
    alone, swapped = gap("f0", "c1") < gap("f0", "c0"), gap("f0", "c1") + gap("f1", "c0") < gap("f0", "c0") + gap("f1", "c1")
    first = F.when(F.col("f1").isNull(), alone).otherwise(swapped).cast("int")
    return both.withColumn("first", first).withColumn("second", F.when(F.col("f1").isNotNull(), 1 - F.col("first"))).drop("c0", "c1")


def two_groups(pairs: DataFrame, keys: list[str], id_: list[str], features: int, decides: int, full_weight: float = 4000.0, rounds: int = 20) -> DataFrame:
    """``keys, id_, swapped, sound``: which way round the two outlines of each frame belong.

    ``pairs`` has per frame ``f0, f1`` (arrays of features) and ``a0, a1`` (areas). Features are standardised per key over
    both outlines (population deviation); an outline weighs ``min(1, area / full_weight)``. The outline with more of feature
    ``decides`` starts in the first group; then centres and the cheaper of both ways alternate until nothing changes, at most
    ``rounds`` times. ``swapped``: the second outline is in the first group (ties: not). ``sound``: the first group's centre
    still has more of the deciding feature. Frames with null features take no part.

    Each round is one grouped sum per key and a join of the few centres; the driver sees one count.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    rows = pairs.where("f0 is not null and f1 is not null and a0 is not null and a1 is not null").select(*keys, *id_, *[F.col(c).cast("array<double>").alias(c) for c in ("f0", "f1")], "a0", "a1")
    both = rows.select(*keys, F.explode(F.array("f0", "f1")).alias("f"))
    part = lambda c, i: F.get(F.col(c), F.lit(i))
    stats = both.groupBy(*keys).agg(F.array(*[F.avg(part("f", i)) for i in range(features)]).alias("_m"), F.array(*[F.stddev_pop(part("f", i)) for i in range(features)]).alias("_s"))
    z = lambda c: F.zip_with(F.zip_with(F.col(c), F.col("_m"), lambda x, m: x - m), F.col("_s"), lambda x, s: x / (s + 1e-9))
    w = lambda c: F.least(F.lit(1.0), F.col(c) / full_weight)
    now = rows.join(stats, keys).select(*keys, *id_, z("f0").alias("f0"), z("f1").alias("f1"), w("a0").alias("w0"), w("a1").alias("w1"))
    now = scratch.write(now.withColumn("swapped", part("f1", decides) > part("f0", decides)).withColumn("changed", F.lit(True)))
    for at in range(rounds + 1):
        first = [F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a)) for a, b in (("f0", "f1"), ("w0", "w1"))]
        second = [F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b)) for a, b in (("f0", "f1"), ("w0", "w1"))]
        sides = now.select(*keys, *[c.alias(n) for c, n in zip(first + second, ("_f1", "_w1", "_f2", "_w2"))])
        mean = lambda f, v: F.array(*[F.try_divide(F.sum(part(f, i) * F.col(v)), F.sum(v)) for i in range(features)])
        centres = sides.groupBy(*keys).agg(mean("_f1", "_w1").alias("_c1"), mean("_f2", "_w2").alias("_c2"))
        if at == rounds or not now.where("changed").limit(1).count():
            sound = part("_c1", decides) > part("_c2", decides)
            return now.join(centres, keys).select(*keys, *id_, "swapped", sound.alias("sound"))
        cost = lambda a, b: F.col("w0") * _gap(F.col("f0"), F.col(a)) + F.col("w1") * _gap(F.col("f1"), F.col(b))
        other = F.coalesce(cost("_c2", "_c1") < cost("_c1", "_c2"), F.lit(False))
        new = now.join(centres, keys).select(*keys, *id_, "f0", "f1", "w0", "w1", other.alias("_new"), "swapped")
        last = now
        now = scratch.write(new.select(*keys, *id_, "f0", "f1", "w0", "w1", F.col("_new").alias("swapped"), (F.col("_new") != F.col("swapped")).alias("changed")))
        scratch.drop(last)
    raise AssertionError
