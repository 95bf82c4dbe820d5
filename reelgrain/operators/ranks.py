"""Row numbers and runs of ordered rows that stay parallel when one key holds most of the rows.

A window over a key puts all of its rows into one task. Here the order column is cut into buckets: the window runs per
(key, bucket), and only one or two rows per bucket meet in a window over the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rn") -> DataFrame:
    """``df`` with the 1-based row number per ``keys`` in ``order``.

    ``bucket`` must not decrease along the order (null order values: give them a bucket too). ``order`` should be unique
    per key; ties are numbered arbitrarily. Null keys form a key of their own.
    """
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_ob"), "_before")
    local = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    same = F.col("_b").eqNullSafe(F.col("_ob"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return local.join(offsets, same).withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint")).select(*df.columns, name)


def runs(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, carry: list[str], joins: Callable[[Column, Column], Column], aggs: dict[str, tuple[str, str]],
) -> DataFrame:
    """Maximal runs of rows of which each joins the row before it.

    ``joins(before, now)`` gets structs of ``order + carry`` and says whether the run goes on. ``aggs`` maps result names
    to (function, column), function being one of sum, min, max; ``first`` and ``last`` structs and the count ``n`` come
    with every run. Summaries combine: a run that is open at a bucket's border is merged in a second step, which sees
    the first and last run of each bucket only.
    """
    held = F.struct(*order, *[c for c in carry if c not in order])
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    again = {"sum": F.sum, "min": F.min, "max": F.max}
    rows = df.withColumn("_b", bucket).withColumn("_s", held)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    starts = ~F.coalesce(joins(F.lag("_s").over(w), F.col("_s")), F.lit(False))
    rows = rows.withColumn("_new", starts.cast("int")).withColumn("_run", F.sum("_new").over(w))
    part = rows.groupBy(*keys, "_b", "_run").agg(
        F.count(F.lit(1)).alias("n"), F.min("_s").alias("first"), F.max("_s").alias("last"), *[combine[f](c).alias(a) for a, (f, c) in aggs.items()]
    )
    # the first run of a bucket has number 1; the last is the one no later run of the bucket follows
    part = part.withColumn("_last", F.lead("_run").over(Window.partitionBy(*keys, "_b").orderBy("_run")).isNull())
    out = ["n", "first", "last", *aggs]
    inner = part.where("_run > 1 and not _last").select(*keys, *out)
    edge = part.where("_run = 1 or _last")
    wk = Window.partitionBy(*keys).orderBy("_b", "_run")
    meets = (F.col("_b") != F.lag("_b").over(wk)) & F.coalesce(joins(F.lag("last").over(wk), F.col("first")), F.lit(False))
    edge = edge.withColumn("_new", (~F.coalesce(meets, F.lit(False))).cast("int"))
    edge = edge.withColumn("_id", F.sum("_new").over(wk))
    merged = edge.groupBy(*keys, "_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), *[again[f](a).alias(a) for a, (f, _) in aggs.items()])
    return inner.unionByName(merged.select(*keys, *out))
