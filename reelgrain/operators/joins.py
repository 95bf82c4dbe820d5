"""Look-ups and matching joins.

Range and nearest joins are made equi-joins by buckets, so that none needs a nested loop over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.sources.scratch import Scratch


def bounded_asof(spans: DataFrame, points: DataFrame, keys: list[str], first: str, last: str, at: str, within: int) -> DataFrame:
    """``spans`` with ``before`` (latest point in [first - within, first]) and ``after`` (earliest in [last, last + within]).

    Either may be null. Points are bucketed by ``within``: a window of that length meets two buckets, so both sides are
    hash-joined on (key, bucket).
    """
    p = points.select(*keys, F.col(at).alias("_at"), F.floor(F.col(at) / within).alias("_bk")).distinct()
    sid = spans.withColumn("_id", F.struct(*keys, first, last))
    out = spans.select(*keys, first, last).distinct()
    for name, edge, sign, pick in (("before", first, -1, F.max), ("after", last, 1, F.min)):
        lo = F.col(edge) - within if sign < 0 else F.col(edge)
        windows = sid.select(*keys, first, last, lo.alias("_lo"), (lo + within).alias("_hi"))
        windows = windows.distinct().withColumn("_bk", F.explode(F.sequence(F.floor(F.col("_lo") / within), F.floor(F.col("_hi") / within))))
        hit = windows.join(p, [*keys, "_bk"]).where(F.col("_at").between(F.col("_lo"), F.col("_hi")))
        out = out.join(hit.groupBy(*keys, first, last).agg(pick("_at").alias(name)), [*keys, first, last], "left")
    return spans.join(out, [*keys, first, last], "left")


def outside_spans(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Rows whose ``at`` lies in no span [low, high] of their key (a range anti join).

    Spans are merged where they overlap before they are cut into buckets of ``width``, so a bucket holds few pieces. Rows
    with null key or position lie in no span.
    """
    w = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    s = spans.where(F.col(low) <= F.col(high)).select(*keys, low, high)
    s = s.withColumn("_new", (F.col(low) > F.coalesce(F.max(high).over(w), F.col(low) - 1)).cast("int"))
    s = s.withColumn("_g", F.sum("_new").over(Window.partitionBy(*keys).orderBy(low, high)))
    s = s.groupBy(*keys, "_g").agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    s = s.withColumn("_bk", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))).drop("_g")
    s = s.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bk").alias("_sb"), "_lo", "_hi")
    cond = (F.floor(F.col(at) / width) == F.col("_sb")) & F.col(at).between(F.col("_lo"), F.col("_hi"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return rows.join(s, cond, "left_anti")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order; a group limit prunes every task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key, with ``rank`` from 1 and ``extra``: whether the key had more."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k + 1)
    more = ranked.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg((F.max("rank") > k).alias("extra"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.where(F.col("rank") <= k).join(more, same).drop(*[f"_{c}" for c in keys])


def overridden(df: DataFrame, overrides: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the override of the same name where one is given (not null)."""
    o = overrides.select(*keys, F.col(column).alias("_o"))
    return df.join(o, keys, "left").withColumn(column, F.coalesce("_o", column)).drop("_o").select(*df.columns)


def unordered(a: Column, b: Column) -> Column:
    """The pair of two names regardless of order; one name if they are the same."""
    return F.array_join(F.array_sort(F.array_distinct(F.array(a, b))), "+")


def within_radius(rows: DataFrame, centres: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """Rows within ``radius`` (inclusive) of any centre ``cx, cy``: a semi join on grid cells of that size."""
    c = centres.select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).distinct()
    step = F.sequence(F.lit(-1), F.lit(1))
    c = c.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    c = c.select("_cx", "_cy", (F.floor(F.col("_cx") / radius) + F.col("_dx")).alias("_gx"), (F.floor(F.col("_cy") / radius) + F.col("_dy")).alias("_gy"))
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    near = (F.floor(F.col(x) / radius) == F.col("_gx")) & (F.floor(F.col(y) / radius) == F.col("_gy")) & (dx * dx + dy * dy <= radius * radius)
    return rows.join(c, near, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, key: str, checks: list[tuple[str, Column]], show: list[str] | None = None) -> DataFrame:
    """``show, problem``: rows of ``left`` without partner in ``right`` (one row per key) and those failing a check, one
    row a problem. Checks are written over the joined columns; a null check is passed."""
    joined = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    missing = F.when(F.col("_there").isNull(), F.lit("missing"))
    failed = [F.when(F.col("_there") & F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks]
    return joined.select(*(show or [key]), F.explode(F.array_compact(F.array(missing, *failed))).alias("problem"))


def nearest_centre(rows: DataFrame, centres: DataFrame, vector: str, id_: str, label: str, limit: int = 10_000) -> DataFrame:
    """``id_, label, distance``: the nearest centre of each row, ties to the smaller label.

    ``centres`` (``label, centre``), the stated set, is counted first and goes to every row as one array, so no pair is
    shuffled; beyond ``limit`` it does so in blocks of about that many, each a pass that keeps the nearer centre.
    """
    blocks = max(1, -(-centres.count() // limit))
    shown = centres.withColumn("_k", F.pmod(F.xxhash64(label), F.lit(blocks)))
    best = F.struct(F.lit(None).cast("double").alias("distance"), F.lit(None).cast(centres.schema[label].dataType).alias(label))
    out = rows.select(id_, vector, best.alias("_best"))
    for i in range(blocks):
        every = shown.where(F.col("_k") == i).agg(F.array_sort(F.collect_list(F.struct(label, "centre"))).alias("_c"))
        near = F.array_min(F.transform("_c", lambda c: F.struct(_distance(F.col(vector), c["centre"]).alias("distance"), c[label].alias(label))))
        nearer = F.when(F.col("_best.distance").isNull() | (near < F.col("_best")), F.coalesce(near, F.col("_best"))).otherwise(F.col("_best"))
        out = out.crossJoin(F.broadcast(every)).select(id_, vector, nearer.alias("_best"))
    return out.where(F.col("_best.distance").isNotNull()).select(id_, f"_best.{label}", "_best.distance")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v.cast("double")))


def grid_knn(points: DataFrame, keys: list[str], id_: str, k: int, cell: float, max_rounds: int = 40) -> DataFrame:
    """``keys, id_, near`` (array of ``distance, other``): the k nearest others of the same key in x, y, z, exactly.

    Works on places: points at one place are one query, and only the k + 1 smallest ids of a place can be anybody's
    neighbour, so a hot place makes no pairs. Each round looks into the 27 cells around a place; it is settled when its
    k-th distance is within the cell size, which those cells cover, else it goes on with cells of three times the size.
    Ties go to the smaller id; null, NaN and infinite coordinates take no part; repeated rows count once.
    """
    scratch = Scratch(points.sparkSession, "knn")
    xyz = ["x", "y", "z"]
    fine = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in xyz)
    pts = scratch.write(points.where(fine).select(*keys, id_, *[F.col(c).cast("double").alias(c) for c in xyz]).distinct())
    place = [*keys, *xyz]
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(id_))
    places = scratch.write(pts.withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy(*place).agg(F.array_sort(F.collect_list(id_)).alias("_ids")))
    sizes = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    todo, done = places.join(F.broadcast(sizes) if not keys else sizes, keys).select(*place, "_all"), None
    step = F.sequence(F.lit(-1), F.lit(1))
    for _ in range(max_rounds):
        cells = [F.floor(F.col(c) / cell).alias(f"_{c}") for c in xyz]
        around = todo.select(*place, "_all", *cells)
        for c in xyz:
            around = around.withColumn("_d", F.explode(step)).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_d")).drop("_d")
        other = places.select(*keys, "_ids", *[F.col(c).alias(f"_o{c}") for c in xyz], *cells)
        gap = [F.col(c) - F.col(f"_o{c}") for c in xyz]
        d = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
        pairs = around.join(other, [*keys, "_x", "_y", "_z"]).select(*place, "_all", d.alias("_d"), F.explode("_ids").alias("_o"))
        best = F.row_number().over(Window.partitionBy(*place).orderBy("_d", "_o"))
        top = pairs.withColumn("_r", best).where(F.col("_r") <= k + 1)
        near = top.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(F.col("_d").alias("distance"), F.col("_o").alias("other")))).alias("near"), F.max("_all").alias("_all"))
        want = F.least(F.lit(k + 1), F.col("_all"))
        near = scratch.write(near.withColumn("_sure", (F.size("near") == want) & ((want == F.col("_all")) | (F.element_at("near", -1)["distance"] <= cell))))
        settled = near.where("_sure").select(*place, "near")
        done = settled if done is None else done.unionByName(settled)
        todo = scratch.write(near.where("not _sure").select(*place, "_all"))
        if todo.isEmpty():
            break
        cell *= 3
    else:
        raise RuntimeError(f"places left after {max_rounds} rounds")
    own = pts.join(done, place)
    return own.select(*keys, id_, F.slice(F.filter("near", lambda n: n["other"] != F.col(id_)), 1, k).alias("near"))
