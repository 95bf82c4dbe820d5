"""Seeded draws that don't depend on how rows are laid out: every number is a hash of the seed and the row's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrain.functions.numeric import unit
from reelgrain.operators.ranks import numbered
from reelgrain.sources.scratch import Scratch


def _counted(df: DataFrame, keys: list[str], id_: str, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... per key in the order of a digest of ``id_``, which is as good as any for a uniform
    draw and spreads a hot key over buckets of the digest."""
    rows = df.withColumn("_h", F.md5(F.col(id_).cast("string").cast("binary")))
    return numbered(rows, keys, ["_h", id_], F.substring("_h", 1, 2), "_n1").withColumn(name, F.col("_n1") - 1).drop("_h", "_n1")


def two_level(images: DataFrame, pool: DataFrame, image: str, group: str, member: str, seed: int) -> DataFrame:
    """Per image a uniform group, then a uniform member of it: ``image, group, member``.

    Groups and members are numbered; the image's hash points at one of them, so the pool isn't crossed with the images.
    Null groups and members aren't drawn; an empty pool draws nothing.
    """
    members = _counted(pool.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct(), [group], member, "_m")
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_one", F.lit(1))
    ranked = _counted(sizes, ["_one"], group, "_g").drop("_one")
    whole = ranked.agg(F.count(F.lit(1)).alias("_groups"))
    picks = images.select(image).distinct().crossJoin(F.broadcast(whole)).where("_groups > 0")
    picks = picks.withColumn("_g", F.floor(unit(image, seed=seed) * F.col("_groups")))
    picks = picks.join(ranked, "_g").withColumn("_m", F.floor(unit(image, seed=seed + 1) * F.col("_size")))
    return picks.join(members, [group, "_m"]).select(image, group, member)


def other_group(images: DataFrame, pool: DataFrame, image: str, group: str, member: str, clip: str, seed: int) -> DataFrame:
    """Per image a uniform group whose first member (by name) is not from the image's own clip: ``image, group``.

    Groups are numbered with those of a clip side by side, so leaving out a clip is a gap in the numbers, and a draw is one
    look-up. Images without clip may draw any group; groups without clip belong to none; no group left draws nothing.
    """
    first = pool.where(F.col(group).isNotNull() & F.col(member).isNotNull()).groupBy(group).agg(F.min_by(F.coalesce(F.col(clip), F.lit("")), member).alias("_c"))
    rows = first.withColumn("_one", F.lit(1)).withColumn("_h", F.md5(F.col(group).cast("string").cast("binary")))
    ranked = numbered(rows, ["_one"], ["_c", "_h", group], F.col("_c"), "_n").select(group, "_c", (F.col("_n") - 1).alias("_g"))
    gaps = ranked.where("_c <> ''").groupBy(F.col("_c").alias(clip)).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_gap"))
    whole = ranked.agg(F.count(F.lit(1)).alias("_groups"))
    picks = images.select(image, clip).join(gaps, clip, "left").crossJoin(F.broadcast(whole))
    left = F.col("_groups") - F.coalesce("_gap", F.lit(0))
    at = F.floor(unit(image, seed=seed) * left)
    picks = picks.where(left > 0).withColumn("_g", F.when(at >= F.col("_start"), at + F.col("_gap")).otherwise(at))
    return picks.join(ranked, "_g").select(image, group)


def draw_kind(image: Column | str, shares: list[tuple[str, float]], seed: int) -> Column:
    """A kind by its share, the same through all attempts of an image."""
    u, at, out = unit(image, seed=seed), 0.0, None
    for kind, share in shares[:-1]:
        at += share
        out = F.when(u < at, kind) if out is None else out.when(u < at, kind)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])


def first_accepted(images: DataFrame, image: str, attempts: int, columns: dict[str, Column], accept: Column, most: int = 10_000) -> DataFrame:
    """Rejection sampling: per image (one row each) the first attempt that is accepted.

    ``columns`` may use ``attempt``. ``attempts`` are made at once; images none of which was accepted make the next ones,
    until none is left. An image that has none accepted in ``most`` attempts comes back with null columns.
    """
    scratch = Scratch(images.sparkSession, "draws")
    todo, done, at = images, None, 0
    while True:
        tried = todo.withColumn("attempt", F.explode(F.sequence(F.lit(at), F.lit(at + attempts - 1)))).withColumns(columns).where(accept)
        best = scratch.write(tried.groupBy(image).agg(F.min_by(F.struct("attempt", *columns), "attempt").alias("_b")))
        done = best if done is None else done.unionByName(best)
        at += attempts
        todo = scratch.write(todo.join(best.select(image), image, "left_anti"))
        if at >= most or todo.isEmpty():
            return images.join(done, image, "left").select(*images.columns, "_b.*")


def accepted_until(spark: SparkSession, n: int, columns: dict[str, Column], accept: Column, start: int = 0, most: int = 1 << 40) -> DataFrame:
    """Rejection sampling until ``n`` attempts are accepted: ``number`` from ``start``, ``attempt`` and ``columns``.

    Attempts are numbered from 0 and judged in parallel; twice as many are judged until enough are accepted, and of those
    the first ``n`` count. Fewer than ``n`` accepted in ``most`` attempts is an error, not a shorter sample.
    """
    tries = max(2 * n, 1000)
    while True:
        made = spark.range(tries).withColumnRenamed("id", "attempt").withColumns(columns).where(accept)
        if made.count() >= n:
            break
        if tries >= most:
            raise ValueError(f"fewer than {n} of {tries} attempts were accepted")
        tries *= 2
    rows = numbered(made.withColumn("_one", F.lit(1)), ["_one"], ["attempt"], F.floor(F.col("attempt") / 10_000), "_n").where(F.col("_n") <= n)
    return rows.select((F.col("_n") - 1 + start).alias("number"), "attempt", *columns)


def second_place(image: Column | str, x: Column, y: Column, width: Column, seed: int) -> list[Column]:
    """Where the second robot stands: in half of the layouts in contact, at any angle, flattened by perspective."""
    near = unit(image, "attempt", seed=seed) < 0.5
    u = unit(image, "attempt", seed=seed + 1)
    distance = width * F.when(near, 0.7 + 0.6 * u).otherwise(1.5 + 3.5 * u)
    angle = unit(image, "attempt", seed=seed + 2) * 6.283185307179586
    return [x + distance * F.cos(angle), y + 0.6 * distance * F.sin(angle)]


def stratified(df: DataFrame, keys: list[str], id_: str, k: int, seed: int) -> DataFrame:
    """``k`` rows per key by hash order; a group limit keeps k rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")).cast("binary")), id_)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def pool_avoiding(pool: DataFrame, group: str, clip: str, avoid: str) -> DataFrame:
    """The pool without groups whose first member (by name) is from the clip to avoid."""
    first = pool.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(clip, "file").alias("_c"))
    return pool.join(first.where(F.coalesce(F.col("_c") != avoid, F.lit(True))).select(group), group, "left_semi")


def meeting(rows: DataFrame, id_: str, covered: Column, dx: Column, dy: Column, reach: tuple[float, float] = (220.0, 90.0), least: float = 0.6, steps: int = 5) -> DataFrame:
    """``id_, step``: of ``steps`` places along a line (``step`` 0 ...) the first that covers enough and stays in reach.

    The column expressions may use ``step``. Rows without such a place give none.
    """
    tried = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    ok = (covered >= least) & (F.abs(dx) <= reach[0]) & (F.abs(dy) <= reach[1])
    return tried.where(ok).groupBy(id_).agg(F.min("step").alias("step"))
