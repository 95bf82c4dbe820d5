"""Measurements of frames and outlines from pixel rows: plain grouped aggregates, so a frame's pixels may lie in any tasks.

Pixel rows hold ``x, y`` and values; outline rows hold ``k, x, y``, a pixel an outline covers. Nulls count as values
that were not measured: an aggregate skips them, a null flag is false.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.numeric import even_round, trunc
from reelgrain.operators.ranks import numbered

FRAME_BAND = (0.7, 1.4)


def floor_gain(pixels: DataFrame, keys: list[str], gray: str = "v", plate: str = "plate", mask: str = "arena") -> DataFrame:
    """``keys, gain``: median plate level of the floor over the frame's own, the latter at least 1."""
    on = pixels.where(F.coalesce(F.col(mask), F.lit(False)))
    return on.groupBy(*keys).agg((F.median(plate) / F.greatest(F.median(gray), F.lit(1.0))).alias("gain"))


def in_band(gain: Column, band: tuple[float, float] = FRAME_BAND) -> Column:
    """Whether a frame is as bright as its plate, within a band that includes its ends."""
    return (1 / gain).between(*band)


def kept_frames(frames: DataFrame, keys: list[str], frame: str, start: Column, every: int, ok: Column, bucket: Column, limit: int | None = None) -> DataFrame:
    """Every ``every``-th frame from ``start`` that is ``ok``; of those the first ``limit`` per key."""
    rows = frames.where((F.col(frame) >= start) & (F.pmod(F.col(frame) - start, F.lit(every)) == 0) & F.coalesce(ok, F.lit(False)))
    return rows if limit is None else numbered(rows, keys, [frame], bucket, "_rn").where(F.col("_rn") <= limit).drop("_rn")


def described(pixels: DataFrame, keys: list[str], gray: str = "v") -> DataFrame:
    """Per outline: ``area, on_change, moving, at_edge, bbox, mean, centre`` from its pixels (``x, y, fg, moved, outside``).

    Shares have two decimals and the mean one, rounded half to even; the box has inclusive maxima, the centre is truncated.
    """
    n = F.count(F.lit(1))
    out = pixels.groupBy(*keys).agg(
        n.alias("area"), even_round(F.count_if("fg") / n, 2).alias("on_change"), even_round(F.count_if("moved") / n, 2).alias("moving"), F.bool_or(F.coalesce("outside", F.lit(False))).alias("at_edge"),
        F.array(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("bbox"), even_round(F.avg(gray), 1).alias("mean"), F.avg("x").alias("_cx"), F.avg("y").alias("_cy"),
    )
    return out.withColumn("centre", F.array(trunc(F.col("_cx")).cast("int"), trunc(F.col("_cy")).cast("int"))).drop("_cx", "_cy")


def features(pixels: DataFrame, keys: list[str], gray: str = "v", bright: float = 180, dark: float = 60) -> DataFrame:
    """What tells outlines of one robot from another's: ``mean, spread, bright, dark, tall, size``.

    ``size`` is the logarithm of the area less that of the squared row it stands on (60 at least), as outlines shrink with
    distance.
    """
    g, n = F.col(gray), F.count(F.lit(1))
    wide, low = F.max("x") - F.min("x"), F.max("y")
    return pixels.groupBy(*keys).agg(
        F.avg(g).alias("mean"), F.stddev_pop(g).alias("spread"), F.avg((g > bright).cast("double")).alias("bright"), F.avg((g < dark).cast("double")).alias("dark"),
        ((low - F.min("y")) / F.greatest(wide, F.lit(1))).alias("tall"), (F.ln(n) - 2 * F.ln(F.greatest(low, F.lit(60)))).alias("size"),
    )


def unlabelled(pixels: DataFrame, keys: list[str], region: str = "region", covered: str = "covered") -> DataFrame:
    """``keys, unlabelled``: share of the changed regions' pixels no outline covers, two decimals; 0 without regions."""
    open_ = F.count_if(F.col(region) & ~F.coalesce(F.col(covered), F.lit(False)))
    return pixels.groupBy(*keys).agg(F.coalesce(even_round(F.try_divide(open_.cast("double"), F.count_if(region).cast("double")), 2), F.lit(0.0)).alias("unlabelled"))


def uncovered(pixels: DataFrame, keys: list[str], order: str, most: float = 0.5) -> DataFrame:
    """``keys, order`` of the outlines kept when, in order, one mostly covered by those kept before it is dropped.

    A frame's outlines are taken in one call; their pixels are at most a picture's, a few times over.
    """
    shape = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in [*keys, order])

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf["y"].to_numpy(np.int64) << 32 | pdf["x"].to_numpy(np.int64)
        taken, out = np.zeros(0, np.int64), []
        for k, rows in sorted(pdf.groupby(order).indices.items()):
            own = np.unique(place[rows])
            if np.isin(own, taken).sum() <= most * len(own):
                taken = np.union1d(taken, own)
                out.append(rows[0])
        return pdf.iloc[out][[*keys, order]]

    return pixels.where(f"x is not null and y is not null and `{order}` is not null").groupBy(*keys).applyInPandas(keep, shape)


def shared_pixels(pixels: DataFrame, keys: list[str], k: str) -> DataFrame:
    """``keys, k, other, shared, share, cx, cy`` of overlapping footprints: pixels both cover, their share of the smaller
    footprint, and their mean place. Joined on the pixel, so only footprints that meet make rows."""
    rows = pixels.select(*keys, k, "x", "y").distinct()
    size = rows.groupBy(*keys, k).agg(F.count(F.lit(1)).alias("_n"))
    other = rows.withColumnRenamed(k, "other")
    both = rows.join(other, [*keys, "x", "y"]).where(F.col(k) < F.col("other"))
    met = both.groupBy(*keys, k, "other").agg(F.count(F.lit(1)).alias("shared"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    out = met.join(size, [*keys, k]).join(size.select(*keys, F.col(k).alias("other"), F.col("_n").alias("_m")), [*keys, "other"])
    return out.select(*keys, k, "other", "shared", (F.col("shared") / F.least("_n", "_m")).alias("share"), "cx", "cy")


def split_overlap(pixels: DataFrame, keys: list[str], k: str) -> DataFrame:
    """Each pixel several outlines cover goes to the one whose centre is nearest (ties: the smaller ``k``)."""
    rows = pixels.select(*keys, k, "x", "y").distinct()
    centre = rows.groupBy(*keys, k).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    far = F.pow(F.col("x") - F.col("_cx"), F.lit(2)) + F.pow(F.col("y") - F.col("_cy"), F.lit(2))
    own = rows.join(centre, [*keys, k]).groupBy(*keys, "x", "y").agg(F.min(F.struct(far.alias("d"), k)).alias("_m"))
    return own.select(*keys, F.col(f"_m.{k}").alias(k), "x", "y")


def on_mask(points: DataFrame, x: str, y: str, mask: DataFrame) -> DataFrame:
    """Points whose truncated place is a mask pixel (``x, y``); beyond the picture there is none."""
    cells = mask.select(F.col("x").cast("long").alias("_mx"), F.col("y").cast("long").alias("_my")).distinct()
    return points.join(cells, (trunc(F.col(x)).cast("long") == F.col("_mx")) & (trunc(F.col(y)).cast("long") == F.col("_my")), "left_semi")


def placement_floor(places: DataFrame, stood: DataFrame, keys: list[str], reach: float = 90) -> DataFrame:
    """Places (``x, y``) within ``reach`` of where a robot stood (``sx, sy``) under the same keys.

    Stood points go into the cells of a grid of that size and its neighbours, distinct places first: an equi-join.
    """
    step = F.sequence(F.lit(-1), F.lit(1))
    s = stood.select(*keys, "sx", "sy").distinct()
    for a, b in (("sx", "_gx"), ("sy", "_gy")):
        s = s.withColumn("_d", F.explode(step)).withColumn(b, F.floor(F.col(a) / reach) + F.col("_d")).drop("_d")
    p = places.withColumn("_gx", F.floor(F.col("x") / reach)).withColumn("_gy", F.floor(F.col("y") / reach))
    near = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")) <= reach * reach
    cond = near & (p["_gx"] == s["_gx"]) & (p["_gy"] == s["_gy"])
    for c in keys:
        cond = cond & (p[c] == s[c])
    return p.join(s, cond, "left_semi").drop("_gx", "_gy")


def draw_order(robots: DataFrame, keys: list[str], k: str, row: Column) -> DataFrame:
    """``keys, order``: the robots of a picture from far to near by the row they stand on, so that the near hide the far."""
    item = F.struct(row.alias("row"), F.col(k).alias("k"))
    return robots.where(row.isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["k"]).alias("order"))
