"""Reports over groups: shares, ratios, robust fits and boxes, coverage, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.numeric import share_off


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """Rows per reason, counted under the text before the first colon. Null arrays and null reasons count nowhere."""
    each = df.select(F.explode(reasons).alias("r")).where("r is not null")
    return each.groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kind_shares(df: DataFrame, kind: str, targets: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """``kind, target, n, share, off``: shares against targets, kinds without rows included; null share of nothing."""
    n = df.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("total"))
    out = targets.select("kind", "target").join(n, "kind", "left").crossJoin(F.broadcast(whole))
    share = F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total").cast("double"))
    return out.select("kind", "target", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), share_off(share, F.col("target"), F.col("total")).alias("off"))


def recall(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """``keys, hits, total, recall`` with the denominator at least 1."""
    got = df.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("recall", F.col("hits") / F.greatest(F.col("total"), F.lit(1)))


def guarded_share(cond: Column) -> Column:
    """Mean of a condition; 0 of nothing."""
    return F.count_if(cond) / F.greatest(F.count(F.lit(1)), F.lit(1))


def grid_coverage(df: DataFrame, keys: list[str], x: Column, y: Column, box: tuple[float, float, float, float], grid: tuple[int, int]) -> DataFrame:
    """``keys, cells, coverage``: share of the grid's cells over ``box`` (x0, y0, x1, y1) that hold a row.

    Cell numbers are truncated towards zero before the range check, so what lies less than a cell outside the low border
    counts in the first cell. Distinct cells are few, whatever the rows.
    """
    x0, y0, x1, y1 = box
    gx = ((x - x0) / (x1 - x0 + 1) * grid[0]).cast("int")
    gy = ((y - y0) / (y1 - y0 + 1) * grid[1]).cast("int")
    cells = df.select(*keys, gx.alias("gx"), gy.alias("gy")).where(F.col("gx").between(0, grid[0] - 1) & F.col("gy").between(0, grid[1] - 1)).distinct()
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells")).withColumn("coverage", F.col("cells") / float(grid[0] * grid[1]))


def repeats(df: DataFrame, keys: list[str], signature: list[Column], counts: Column) -> DataFrame:
    """``keys, repeats``: rows beyond the first of each signature, where ``counts`` holds (the same for equal signatures).

    The signature's hash is what is shuffled; equal hashes are checked by the values themselves.
    """
    named = [s.alias(f"_s{i}") for i, s in enumerate(signature)]
    g = df.select(*keys, counts.alias("_c"), *named).groupBy(*keys, *[f"_s{i}" for i in range(len(named))])
    return g.agg(F.count(F.lit(1)).alias("_n"), F.max("_c").alias("_c")).groupBy(*keys).agg(F.sum(F.when(F.col("_c"), F.col("_n") - 1).otherwise(0)).alias("repeats"))


def robust_fit(df: DataFrame, keys: list[str], x: str, y: str, sigmas: float = 2.0) -> DataFrame:
    """``keys, slope, intercept, kept``: line fit, rows beyond ``sigmas`` population deviations left out, fit again.

    Two aggregations; the first fit goes back to the rows by a join on the keys (small side). Nulls take no part.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    line = [F.regr_slope("_y", "_x").alias("_a"), F.regr_intercept("_y", "_x").alias("_b")]
    first = rows.groupBy(*keys).agg(*line, F.var_pop("_y").alias("_vy"), F.var_pop("_x").alias("_vx"))
    # the residuals' deviation follows from the fit: their mean is 0, var = var(y) - a^2 var(x)
    first = first.withColumn("_s", F.sqrt(F.greatest(F.col("_vy") - F.col("_a") * F.col("_a") * F.col("_vx"), F.lit(0.0))))
    joined = rows.join(first, keys) if keys else rows.crossJoin(F.broadcast(first))
    kept = joined.where(F.abs(F.col("_y") - (F.col("_a") * F.col("_x") + F.col("_b"))) <= sigmas * F.col("_s"))
    return kept.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count(F.lit(1)).alias("kept"))


def quantile_box(df: DataFrame, keys: list[str], of: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per column ``_lo, _hi`` (exact interpolated quantiles) and ``_min, _max``.

    Exact quantiles are found by counting values: the aggregate keeps distinct values with counts, not rows.
    """
    aggs = []
    for c in of:
        q = F.percentile(c, F.array(F.lit(low), F.lit(high)))
        aggs += [F.get(q, F.lit(0)).alias(f"{c}_lo"), F.get(q, F.lit(1)).alias(f"{c}_hi"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggs)


def weighted_share(df: DataFrame, keys: list[str], cond: Column, weight: Column) -> DataFrame:
    """``keys, share, weight_share``: by count and by weight; null of nothing."""
    c = F.coalesce(cond, F.lit(False))
    part = F.sum(F.when(c, weight).otherwise(0.0))
    return df.groupBy(*keys).agg(F.avg(c.cast("double")).alias("share"), F.try_divide(part, F.sum(weight)).alias("weight_share"))


def histogram(df: DataFrame, keys: list[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """``keys, bin, n`` of ``bins`` equal bins from 0; the high border belongs to the last, what lies outside is left out."""
    at = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("bigint")
    return df.where((value >= low) & (value <= high)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overwrite(df: DataFrame, cells: list[Column], depth: list[Column], value: Column, name: str) -> DataFrame:
    """Per cell the value of greatest depth: painting far to near without sorting."""
    return df.groupBy(*cells).agg(F.max_by(value, F.struct(*depth)).alias(name))


def dominance(models: DataFrame) -> DataFrame:
    """Share of sub-model 0 (``index, images``) among all images, the largest one's beside it."""
    whole = F.sum("images")
    return models.agg(F.try_divide(F.sum(F.when(F.col("index") == 0, F.col("images")).otherwise(0)), whole).alias("dominance"), F.try_divide(F.max("images"), whole).alias("largest"))


def wide(df: DataFrame, keys: list[str], label: str, labels: list[str], values: list[str]) -> DataFrame:
    """One row per key with a column per label and value; labels are given, so no pass finds them."""
    aggs = [F.max(F.when(F.col(label) == x, F.col(v))).alias(f"{x}_{v}") for x in labels for v in values]
    return df.groupBy(*keys).agg(*aggs)


def top_down_extent(df: DataFrame, x: str, y: str, size: int, pad: float = 0.05) -> DataFrame:
    """``x0, y0, scale``: an outline's extent, padded by a share of the larger range, and one scale for both axes."""
    box = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    larger = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return box.select((F.col("x0") - pad * larger).alias("x0"), (F.col("y0") - pad * larger).alias("y0"), F.try_divide(F.lit(float(size)), larger * (1 + 2 * pad)).alias("scale"))


def median_image(pixels: DataFrame) -> DataFrame:
    """``x, y, value``: per-pixel median of frames, truncated to whole levels."""
    return pixels.groupBy("x", "y").agg(F.median("value").cast("int").alias("value"))


def blur_summary(scores: DataFrame, kept: Column) -> DataFrame:
    return scores.agg(F.median("score").alias("median_all"), F.median(F.when(kept, F.col("score"))).alias("median_kept"), F.min(F.when(kept, F.col("score"))).alias("min_kept"))


def plate_check(pixels: DataFrame, keys: list[str], target: dict[str, tuple[float, float]], least: int = 500) -> DataFrame:
    """Colour check per plate from ``paint, a, b, mine, approved`` pixels: overlap of paint masks and per paint the
    distance of the median colour from its target (null for at most ``least`` pixels)."""
    both, either = F.count_if(F.col("mine") & F.col("approved")), F.count_if(F.col("mine") | F.col("approved"))
    aggs = [F.try_divide(both, either).alias("paint_iou")]
    for paint, (a, b) in target.items():
        on = F.col("paint") == paint
        d = F.hypot(F.median(F.when(on, F.col("a"))) - a, F.median(F.when(on, F.col("b"))) - b)
        aggs.append(F.when(F.count_if(on) > least, d).alias(f"{paint}_off"))
    return pixels.groupBy(*keys).agg(*aggs)


def visible_boxes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, box, visible, whole, share`` of placed robots from their pixels (``x, y, seen``).

    The box is that of the seen pixels (inclusive maxima; null if none is seen); ``share`` is seen of whole.
    """
    seen = lambda c: F.when(F.col("seen"), F.col(c))
    out = pixels.groupBy(*keys).agg(
        F.min(seen("x")).alias("x0"), F.min(seen("y")).alias("y0"), F.max(seen("x")).alias("x1"), F.max(seen("y")).alias("y1"),
        F.count_if("seen").alias("visible"), F.count(F.lit(1)).alias("whole"),
    )
    box = F.when(F.col("visible") > 0, F.array("x0", "y0", "x1", "y1"))
    return out.select(*keys, box.alias("box"), "visible", "whole", (F.col("visible") / F.col("whole")).alias("share"))


def accepted_layout(robots: DataFrame, image: str, seen: str, whole: str, least: float = 0.45) -> DataFrame:
    """Images none of whose robots is seen by less than ``least`` of its whole."""
    return robots.groupBy(image).agg(F.bool_and(F.coalesce(F.col(seen) >= least * F.col(whole), F.lit(False))).alias("ok")).where("ok").select(image)


def reconstruction_means(observed: DataFrame, errors: DataFrame) -> DataFrame:
    """``error, track_length, seen_mean, seen_min, seen_max`` of a reconstruction: mean error of its points (infinite without
    points), images per point and points per image, from ``observed`` (``image, point``) and ``errors`` (``point, error``)."""
    tracks = observed.groupBy("point").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("track_length"))
    seen = observed.groupBy("image").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("seen_mean"), F.min("n").alias("seen_min"), F.max("n").alias("seen_max"))
    error = errors.agg(F.coalesce(F.avg("error"), F.lit(float("inf"))).alias("error"))
    return error.crossJoin(tracks).crossJoin(seen)
