"""Order-dependent operators. Where the state is reset by the rows themselves, the rows are cut there and the pieces run
in parallel; where it composes, chunks are combined; a truly sequential fold streams sorted rows with constant memory."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.functions.geometry import touches
from reelgrain.operators.ranks import numbered
from reelgrain.operators.sequences import running_max, running_sums


def contact_fold(frames: DataFrame, keys: list[str], at: str, boxes: str, reach: int = 60, bucket: int = 30_000) -> DataFrame:
    """``keys, at, contact``: whether one box stands for two in contact.

    A frame of two boxes remembers them. A frame of one box that comes within ``reach`` of both remembered boxes is in
    contact, and is remembered twice; any other frame forgets. Only frames of one box depend on the past, so the rows are
    cut at all others (a two-phase running count) and each piece is folded by ``aggregate`` on its own. Null boxes count
    as none.
    """
    rows = frames.select(*keys, at, F.filter(F.coalesce(boxes, F.array().cast("array<array<int>>")), lambda b: b.isNotNull()).alias("_boxes"))
    rows = rows.withColumn("_cut", (F.size("_boxes") != 1).cast("int"))
    rows = running_sums(rows, keys, [at], {"_piece": "_cut"}, F.floor(F.col(at) / bucket))
    item = F.struct(F.col(at).alias("at"), F.col("_boxes").alias("boxes"))
    pieces = rows.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    none = F.lit(None).cast("array<array<int>>")
    start = F.struct(none.alias("pair"), F.array().cast("array<struct<at:bigint,contact:boolean>>").alias("out"))

    def merge(state: Column, row: Column) -> Column:
        one = F.get(row["boxes"], F.lit(0))
        hit = (F.size(row["boxes"]) == 1) & state["pair"].isNotNull() & F.coalesce(F.forall(state["pair"], lambda b: touches(one, b, reach)), F.lit(False))
        pair = F.when(F.size(row["boxes"]) == 2, row["boxes"]).when(hit, F.array(one, one))
        said = F.struct(row["at"].cast("bigint").alias("at"), hit.alias("contact"))
        return F.struct(pair.alias("pair"), F.concat(state["out"], F.array(said)).alias("out"))

    folded = pieces.withColumn("_out", F.aggregate("_rows", start, merge)["out"])
    return folded.select(*keys, F.explode("_out").alias("o")).select(*keys, F.col("o.at").alias(at), F.col("o.contact").alias("contact"))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, keep: float = 0.9) -> DataFrame:
    """``df`` with ``ewma``: ``keep * before + (1 - keep) * value``, seeded by the first value; null values leave it as it is
    (null before the first value).

    The recurrence is a decaying sum: within a block of values it is ``keep^i * sum(x * keep^-i)``, a plain window sum; what
    comes before a block enters through the sums of the last blocks, as many as double precision can tell from zero.
    """
    block = max(1, min(1000, int(600 / -math.log(keep))))
    back = math.ceil(40 / (-math.log(keep) * block))
    rows = running_sums(df.withColumn("_one", F.col(value).isNotNull().cast("int")), keys, order, {"_c": "_one"}, bucket)
    vals = rows.where(F.col(value).isNotNull()).select(*keys, "_c", F.col(value).cast("double").alias("_v"), F.floor((F.col("_c") - 1) / block).alias("_block"))
    i = (F.col("_c") - 1) % block + 1
    x = F.when(F.col("_c") == 1, F.col("_v")).otherwise((1 - keep) * F.col("_v"))
    w = Window.partitionBy(*keys, "_block").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_i", i).withColumn("_local", F.pow(F.lit(keep), F.col("_i")) * F.sum(x * F.pow(F.lit(keep), -i)).over(w))
    wk = Window.partitionBy(*keys).orderBy("_block")
    before = F.lit(0.0)
    for m in range(1, back + 1):
        before = before + F.coalesce(F.lag("_end", m).over(wk), F.lit(0.0)) * keep ** (block * (m - 1))
    ends = vals.groupBy(*keys, "_block").agg(F.max_by("_local", "_i").alias("_end")).withColumn("_before", before)
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_ob"), "_before")
    same = F.col("_block") == F.col("_ob")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    done = vals.join(ends, same).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_c").alias("_oc"), (F.col("_local") + F.pow(F.lit(keep), F.col("_i")) * F.col("_before")).alias("ewma"))
    same = F.col("_c") == F.col("_oc")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(done, same, "left").select(*df.columns, "ewma")


def streamed(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Callable[[tuple, dict], dict | None]], schema: str) -> DataFrame:
    """A sequential fold per key: rows come sorted, one at a time; memory holds one state.

    ``fold()`` makes a function for a new key; called with (key, row) it returns the output row or None.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = tuple(row[k] for k in keys)
                if step is None or own != key:
                    key, step = own, fold()
                made = step(own, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out)

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def followed(df: DataFrame, keys: list[str], order: list[str], lost: Column, bucket: Column) -> DataFrame:
    """Rows before the first one that is ``lost`` (a take-while): a running maximum in two phases."""
    rows = df.withColumn("_lost", F.coalesce(lost, F.lit(False)).cast("int"))
    return running_max(rows, keys, order, bucket, "_lost", "_gone").where("_gone = 0").select(*df.columns)


def lost_track(area: Column, area_before: Column, jump: Column, on_change: Column) -> Column:
    """Whether an outline can't be the one before it any more."""
    ratio = F.try_divide(area, area_before)
    return ~ratio.between(0.6, 1.6) | (jump > 90) | (on_change < 0.55)


def one_in(df: DataFrame, keys: list[str], order: list[str], bucket: Column, counts: Column, n: int) -> DataFrame:
    """Of the rows for which ``counts`` holds, every n-th from the first, per key."""
    return numbered(df.where(F.coalesce(counts, F.lit(False))), keys, order, bucket, "_rn").where((F.col("_rn") - 1) % n == 0).drop("_rn")
