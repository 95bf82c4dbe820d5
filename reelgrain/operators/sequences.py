"""Operators over ordered rows: frames of a clip, events of a user, steps of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.operators.ranks import numbered, runs


def flagged_runs(df: DataFrame, keys: list[str], order: list[str], bucket: Column, flag: Column) -> DataFrame:
    """Runs of consecutive rows for which ``flag`` holds: ``keys, start, end, length`` (positions from 1).

    A row whose flag is null doesn't belong to a run. The last run of a key may be open at the end.
    """
    rows = numbered(df.withColumn("_f", F.coalesce(flag, F.lit(False))), keys, order, bucket, "_rn")
    found = runs(rows.where("_f").select(*keys, "_rn"), keys, ["_rn"], F.floor(F.col("_rn") / 1000), [], lambda a, b: b["_rn"] == a["_rn"] + 1, {})
    return found.select(*keys, F.col("first._rn").alias("start"), F.col("last._rn").alias("end"), F.col("n").alias("length"))


def longest(run: DataFrame, keys: list[str], later: bool = False) -> DataFrame:
    """The longest run per key; of equally long ones the earlier, or with ``later`` the later."""
    rank = F.struct("length", F.col("start") if later else -F.col("start"))
    return run.groupBy(*keys).agg(F.max_by(F.struct("start", "end", "length"), rank).alias("r")).select(*keys, "r.*")


def sessions(df: DataFrame, keys: list[str], at: str, gap: int | float, bucket: Column) -> DataFrame:
    """Rows not more than ``gap`` apart, per key: ``keys, first, last, n``."""
    found = runs(df.select(*keys, at), keys, [at], bucket, [], lambda a, b: b[at] - a[at] <= gap, {})
    return found.select(*keys, F.col(f"first.{at}").alias("first"), F.col(f"last.{at}").alias("last"), "n")


def block_best(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, size: int) -> DataFrame:
    """Of each block of ``size`` consecutive rows the one of greatest ``value`` (ties: the first; null is least).

    An incomplete last block gives nothing. Adds ``block`` from 0.
    """
    rows = numbered(df, keys, order, bucket, "_rn").withColumn("block", F.floor((F.col("_rn") - 1) / size).cast("bigint"))
    best = F.max_by(F.struct(*df.columns), F.struct(value, -F.col("_rn"))).alias("_best")
    groups = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], "block").agg(best, F.count(F.lit(1)).alias("_n"))
    return groups.where(F.col("_n") == size).select("_best.*", "block")


def every_nth(df: DataFrame, n: int, start: Column | int = 0, at: str = "frame") -> DataFrame:
    """Rows whose position lies a multiple of ``n`` after ``start``; a plain predicate, so the scan can prune."""
    start = F.lit(start) if isinstance(start, int) else start
    return df.where((F.col(at) >= start) & (F.pmod(F.col(at) - start, F.lit(n)) == 0))


def even_sample(df: DataFrame, order: list[str], bucket: Column, k: int) -> DataFrame:
    """``k`` rows spread evenly over the order, both ends included (k = 1: the first); all rows if there are fewer."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = numbered(df.withColumn("_one", F.lit(1)), ["_one"], order, bucket, "_rn").crossJoin(F.broadcast(total))
    m = F.least(F.lit(k), F.col("_total"))
    # row i is floor(j (n - 1) / (m - 1)) for some j exactly if the nearest j gives it back
    j = F.when(m > 1, F.ceil((F.col("_rn") - 1) * (m - 1) / (F.col("_total") - 1))).otherwise(F.lit(0))
    back = F.when(m > 1, F.floor(j * (F.col("_total") - 1) / (m - 1))).otherwise(F.lit(0))
    return rows.where((back == F.col("_rn") - 1) & (j < m)).select(*df.columns)


def pages(df: DataFrame, keys: list[str], order: list[str], bucket: Column, per: int) -> DataFrame:
    """``df`` with ``page`` and ``slot``, both from 0."""
    rows = numbered(df, keys, order, bucket, "_rn")
    at = F.col("_rn") - 1
    return rows.withColumn("page", F.floor(at / per).cast("bigint")).withColumn("slot", (at % per).cast("bigint")).drop("_rn")


def path_length(df: DataFrame, keys: list[str], order: list[str], of: list[str], bucket: Column) -> DataFrame:
    """Sum of distances between successive rows, in the space of the columns ``of``: ``keys, n, path``.

    Within buckets by a window, between them by the buckets' first and last rows.
    """
    rows = df.withColumn("_b", bucket).withColumn("_s", F.struct(*order, *of))
    step = lambda a, b: F.sqrt(sum(((b[c] - a[c]) * (b[c] - a[c]) for c in of[1:]), (b[of[0]] - a[of[0]]) * (b[of[0]] - a[of[0]])))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    part = rows.withColumn("_d", F.coalesce(step(F.lag("_s").over(w), F.col("_s")), F.lit(0.0))).groupBy(*keys, "_b").agg(
        F.sum("_d").alias("_d"), F.min("_s").alias("_first"), F.max("_s").alias("_last"), F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    part = part.withColumn("_j", F.coalesce(step(F.lag("_last").over(wk), F.col("_first")), F.lit(0.0)))
    return part.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_d") + F.col("_j")).alias("path"))


def running_sums(df: DataFrame, keys: list[str], order: list[str], of: dict[str, str], bucket: Column) -> DataFrame:
    """``df`` with running sums: result name -> column. Two-phase like ``numbered``; nulls add nothing."""
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_t_{a}") for a, c in of.items()])
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_ob"), *[F.coalesce(F.sum(f"_t_{a}").over(wk), F.lit(0)).alias(f"_o_{a}") for a in of])
    same = F.col("_b").eqNullSafe(F.col("_ob"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(f"_l_{a}") for a, c in of.items()]).join(offsets, same)
    return local.select(*df.columns, *[(F.col(f"_o_{a}") + F.col(f"_l_{a}")).alias(a) for a in of])


def neighbours(df: DataFrame, keys: list[str], order: list[str], bucket: Column, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """``df`` with values of the row before and after: result name -> column. The rows at bucket borders are looked up
    among the buckets' first and last rows."""
    rows = df.withColumn("_b", bucket)
    values = F.struct(*order, *[c for c in dict.fromkeys([*before.values(), *after.values()]) if c not in order])
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = rows.withColumn("_s", values)
    rows = rows.withColumn("_p", F.lag("_s").over(w)).withColumn("_q", F.lead("_s").over(w))
    ends = rows.groupBy(*keys, "_b").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_ob"), F.lag("_last").over(wk).alias("_prev"), F.lead("_first").over(wk).alias("_next"))
    same = F.col("_b").eqNullSafe(F.col("_ob"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(ends, same)
    p, q = F.coalesce("_p", "_prev"), F.coalesce("_q", "_next")
    return joined.select(*df.columns, *[p[c].alias(a) for a, c in before.items()], *[q[c].alias(a) for a, c in after.items()])


def step_time(df: DataFrame, keys: list[str], order: list[str], ts: str, bucket: Column, first: float = 1 / 98, least: float = 1e-3) -> DataFrame:
    """``df`` with ``dt``: seconds since the row before, at least ``least``; ``first`` for a key's first row."""
    rows = neighbours(df, keys, order, bucket, {"_before": ts}, {})
    return rows.withColumn("dt", F.coalesce(F.greatest(F.col(ts) - F.col("_before"), F.lit(least)), F.lit(first))).drop("_before")


def plateau(df: DataFrame, keys: list[str], step: str, value: str, within: float) -> DataFrame:
    """First step at which the value is within ``within`` of its maximum: two aggregations, no window."""
    best = df.groupBy(*keys).agg(F.max(value).alias("best"))
    return df.join(best, keys).where(F.col(value) >= F.col("best") - within).groupBy(*keys).agg(F.max("best").alias("best"), F.min(step).alias("step"))


def last_and_tail(df: DataFrame, keys: list[str], order: list[str], value: str, tail: int) -> DataFrame:
    """Last value and mean of the last ``tail`` values; a group limit keeps ``tail`` rows per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    kept = df.withColumn("_r", rank).where(F.col("_r") <= tail)
    return kept.groupBy(*keys).agg(F.max_by(value, -F.col("_r")).alias("last"), F.avg(value).alias("tail_mean"))


def trail(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, bucket: Column, block: int = 1000) -> DataFrame:
    """``df`` with ``trail``: the last ``length`` values including its own (``length`` at most ``block``).

    Rows are numbered in two phases and windowed per block; the last rows of a block are copied to the next as context.
    """
    rows = numbered(df, keys, order, bucket, "_rn").withColumn("_own", F.floor((F.col("_rn") - 1) / block))
    late = (F.col("_rn") - 1) % block >= block - (length - 1)
    rows = rows.withColumn("_block", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(1 - length, 0)
    return rows.withColumn("trail", F.collect_list(value).over(w)).where(F.col("_block") == F.col("_own")).select(*df.columns, "trail")


def frame_rate(df: DataFrame, keys: list[str], order: list[str], ts: str, bucket: Column, every: int = 10) -> DataFrame:
    """Every ``every`` rows the rate over them: ``keys, rn, fps``."""
    rows = numbered(df, keys, order, bucket, "rn").where(F.col("rn") % every == 0)
    paced = neighbours(rows, keys, ["rn"], F.floor(F.col("rn") / 1000), {"_before": ts}, {})
    return paced.select(*keys, "rn", F.try_divide(F.lit(float(every)), F.col(ts) - F.col("_before")).alias("fps"))


def stale(df: DataFrame, keys: list[str], order: list[str], bucket: Column, seen: Column) -> DataFrame:
    """``df`` with ``stale``: rows since ``seen`` last held (0 where it holds; before it ever held, rows so far)."""
    rows = numbered(df.withColumn("_seen", F.coalesce(seen, F.lit(False))), keys, order, bucket, "_rn")
    rows = running_max(rows.withColumn("_at", F.when(F.col("_seen"), F.col("_rn"))), keys, ["_rn"], F.floor(F.col("_rn") / 1000), "_at", "_held")
    return rows.select(*df.columns, (F.col("_rn") - F.coalesce("_held", F.lit(0))).cast("bigint").alias("stale"))


def running_max(df: DataFrame, keys: list[str], order: list[str], bucket: Column, of: str, name: str) -> DataFrame:
    """``df`` with the greatest ``of`` so far, in two phases."""
    rows = df.withColumn("_b2", bucket)
    tops = rows.groupBy(*keys, "_b2").agg(F.max(of).alias("_t"))
    wk = Window.partitionBy(*keys).orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b2").alias("_ob2"), F.max("_t").over(wk).alias("_o"))
    same = F.col("_b2").eqNullSafe(F.col("_ob2"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    w = Window.partitionBy(*keys, "_b2").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_l", F.max(of).over(w)).join(tops, same)
    return local.select(*df.columns, F.greatest("_l", "_o").alias(name))


def ends(df: DataFrame, order: list[tuple[str, bool]], k: int) -> DataFrame:
    """The first and last ``k`` rows in an order (all of at most ``2 k``), with ``end`` first or last.

    ``order`` lists columns and whether they ascend; nulls come last either way. Two top-k reports: each task keeps k rows,
    nothing is sorted whole.
    """
    way = lambda c, up: F.asc_nulls_last(c) if up else F.desc_nulls_last(c)
    head = df.orderBy(*[way(c, up) for c, up in order]).limit(k).withColumn("end", F.lit("first"))
    tail = df.orderBy(*[way(c, not up) for c, up in order]).limit(k).withColumn("end", F.lit("last"))
    return head.unionByName(tail).dropDuplicates(df.columns)


def held_out(df: DataFrame, keys: list[str], order: list[str], bucket: Column, train: float) -> DataFrame:
    """Rows not among the ``ceil(n * train)`` spread evenly over a key's order, both ends included."""
    rows = numbered(df, keys, order, bucket, "_rn")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(sizes, keys).withColumn("_m", F.ceil(F.round(F.col("_n") * train, 9))).withColumn("_i", F.col("_rn") - 1)
    # position i is one of floor(j (n - 1) / (m - 1)) exactly if the first j that reaches it gives it back
    j = F.when(F.col("_m") > 1, F.floor((F.col("_i") * (F.col("_m") - 1) + F.col("_n") - 2) / (F.col("_n") - 1))).otherwise(F.lit(0))
    back = F.when(F.col("_m") > 1, F.floor(j * (F.col("_n") - 1) / (F.col("_m") - 1))).otherwise(F.lit(0))
    kept = (F.col("_m") > 0) & ((F.col("_n") == 1) | ((back == F.col("_i")) & (j < F.col("_m"))))
    return rows.where(~kept).select(*df.columns)
