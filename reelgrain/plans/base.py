"""Views of the driver's tables that several queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.sources.tables import clean_clip, latest, table

WIDTH, HEIGHT = 1440, 762


def frames(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Manifest rows: of several rows of one (clip, frame) the latest holds."""
    raw = table(spark, d, "manifest").where("clip is not null and frame is not null").withColumn("clip", clean_clip(F.col("clip")))
    return latest(raw.select("clip", "frame", "written_at", *keep), ["clip", "frame"], "written_at", list(keep))


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """``clip, frame, k, area, on_change, moving, at_edge, bbox, mean`` of all manifest rows."""
    return frames(spark, d, "robots").select("clip", "frame", F.posexplode("robots").alias("k", "r")).select("clip", "frame", "k", "r.*")


def images(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Composed images, one row per ``image_id``."""
    raw = table(spark, d, "composed").where("image_id is not null").select("image_id", "written_at", *keep)
    return latest(raw, ["image_id"], "written_at", list(keep))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """``image_id, run, k, source, bbox, visible`` of all composed robots."""
    each = images(spark, d, "run", "robots").select("image_id", "run", F.posexplode("robots").alias("k", "r"))
    return each.select("image_id", "run", "k", "r.source", "r.bbox", "r.visible")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Splat points with finite coordinates, repeated rows once."""
    fine = " and ".join(f"{c} is not null and not isnan({c})" for c in "xyz")
    return table(spark, d, "splat_points").where(fine).distinct()


def blobs(spark: SparkSession, d: str) -> DataFrame:
    """Outlines as blobs of a 98 fps video."""
    b = lambda i: F.get("bbox", F.lit(i))
    o = outlines(spark, d).where("bbox is not null and area > 0")
    return o.select(
        "clip", "frame", (F.col("frame") / 98.0).alias("ts"), ((b(0) + b(2)) / 2).alias("cx"), ((b(1) + b(3)) / 2).alias("cy"), b(0).alias("x"), b(1).alias("y"),
        (b(2) - b(0) + 1).alias("w"), (b(3) - b(1) + 1).alias("h"), "area", F.coalesce("mean", F.lit(0.0)).alias("intensity"))


FRAMES = r"""held as (select * exclude (rn) from (select * replace (lower(regexp_replace(clip, '^\s+|\s+$', '', 'g')) as clip),
 row_number() over (partition by lower(regexp_replace(clip, '^\s+|\s+$', '', 'g')), frame order by written_at desc nulls last) as rn
 from manifest where clip is not null and frame is not null) where rn = 1)"""
OUTLINES = FRAMES + """,
outl as (select clip, frame, k::int as k, r.area as area, r.on_change as on_change, r.moving as moving, r.at_edge as at_edge, r.bbox as bbox, r.mean as mean
 from (select clip, frame, unnest(robots) as r, generate_subscripts(robots, 1) - 1 as k from held))"""
IMAGES = """img as (select * exclude (rn) from (select *, row_number() over (partition by image_id order by written_at desc nulls last) as rn
 from composed where image_id is not null) where rn = 1)"""
PLACED = IMAGES + """,
placed as (select image_id, run, k::int as k, r.source as source, r.bbox as bbox, r.visible as visible
 from (select image_id, run, unnest(robots) as r, generate_subscripts(robots, 1) - 1 as k from img))"""
POINTS = "pts as (select distinct * from splat_points where x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z))"
