"""Problem 4: train, validation and test splits that keep related records together.

Method: records that share an entity are related; components come from alternating large-star and small-star.
Each component then falls into a proportional range of its hashed identifier. Components too large for a hash to
place well (more than ``1 / HEAVY`` of all records, hence fewer than HEAVY) are placed first, largest first, where
most is missing; the ranges of the rest are the shares still missing.

Defined results: images with null ``image_id`` are left out; an image counts once (of repeated rows the latest holds);
a source that is null or has not all five parts, or without clip or frame number, names no frame; an image without
frames is a component of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.numeric import unit
from reelgrain.llm.graphs import components, join_unique
from reelgrain.sources.scratch import Scratch
from reelgrain.sources.tables import clean_clip, latest

HEAVY = 200
SEED = 11


def images_of(composed: DataFrame) -> DataFrame:
    """``image_id, sources``: every image once, with the sources of its robots."""
    raw = composed.where("image_id is not null").select("image_id", "written_at", F.transform("robots", lambda r: r["source"]).alias("sources"))
    return latest(raw, ["image_id"], "written_at", ["sources"])


def filmed_frames(images: DataFrame) -> DataFrame:
    """``image_id, clip, frame``: the filmed frames each image uses, once each."""
    parts = F.split("source", ":")
    named = images.select("image_id", F.explode("sources").alias("source")).where("source is not null").select("image_id", parts.alias("p")).where(F.size("p") == 5)
    clip = clean_clip(F.element_at(F.split(F.element_at("p", 4), "/"), -1))
    frame = F.expr("try_cast(regexp_extract(p[4], '([0-9]+)', 1) as bigint)")
    return named.select("image_id", clip.alias("clip"), frame.alias("frame")).where("clip <> '' and frame is not null").distinct()


def relate(uses: DataFrame, record: str, entity: list[str]) -> DataFrame:
    """``node, root`` of records (long ids) that share an entity, also through a chain of others.

    Every entity is replaced by its smallest record (a partial minimum per task), so that an entity used by a third of
    all records costs that many edges, not their pairs.
    """
    scratch = Scratch(uses.sparkSession, "relate")
    uses = scratch.write(uses.select(record, *entity))
    least = uses.groupBy(*entity).agg(F.min(record).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = scratch.write(least.select(F.struct(*entity).alias("e"), "b", "n"))
    total = uses.count()
    edges = join_unique(uses.select(F.col(record).alias("a"), F.struct(*entity).alias("e")), least, "e", "n", total)
    return components(edges.select("a", "b"))


def related_images(composed: DataFrame) -> DataFrame:
    """``image_id, first_image_id`` for every image related to one with a smaller id."""
    out = relate(filmed_frames(images_of(composed)), "image_id", ["clip", "frame"])
    return out.select(F.col("node").alias("image_id"), F.col("root").alias("first_image_id"))


def _range(u: Column, shares: list[tuple[str, float]]) -> Column:
    """The split whose range of the hash's unit interval ``u`` lies in."""
    at, choice = 0.0, None
    for name, share in shares[:-1]:
        at += share
        choice = F.when(u < at, name) if choice is None else choice.when(u < at, name)
    return choice.otherwise(shares[-1][0]) if choice is not None else F.lit(shares[-1][0])


def _listed(splits: DataFrame) -> list[tuple[str, int]]:
    """The fixed small table of splits, largest share first."""
    return [(r[0], r[1]) for r in splits.select("split_name", "share_pct").where("split_name is not null").orderBy(F.desc("share_pct"), "split_name").collect()]


def place(sized: DataFrame, splits: list[tuple[str, int]], total: int, seed: int = SEED) -> DataFrame:
    """``component, split_name`` for components with their ``size``; see the module's text.

    ``splits`` are names and whole percentages in order; it is a fixed small table, and the heavy components are fewer
    than HEAVY, so this much is decided on the driver.
    """
    spark = sized.sparkSession
    want = {name: share * total / 100 for name, share in splits}
    heavy = {}
    for row in sized.where(F.col("size") > max(total / HEAVY, 1)).orderBy(F.desc("size"), "component").collect():
        name = max(want, key=lambda s: want[s])
        heavy[row["component"]] = name
        want[name] -= row["size"]
    left = {s: max(0.0, w) for s, w in want.items()}
    whole = sum(left.values()) or 1.0
    by_hash = _range(unit("component", seed=seed), [(name, left[name] / whole) for name, _ in splits])
    given = spark.createDataFrame(list(heavy.items()), "component long, heavy string")
    return sized.select("component").join(F.broadcast(given), "component", "left").select("component", F.coalesce("heavy", by_hash).alias("split_name"))


def image_splits(composed: DataFrame, splits: DataFrame) -> DataFrame:
    """``image_id, component, split_name``: one row per image; ``component`` is its smallest related image."""
    return _placed(images_of(composed), splits)[0]


def _placed(images: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The images' splits, and the filmed frames they use as a written table."""
    scratch = Scratch(images.sparkSession, "splits")
    images = scratch.write(images)
    uses = scratch.write(filmed_frames(images))
    named = _listed(splits)
    related = relate(uses, "image_id", ["clip", "frame"]).select(F.col("node").alias("image_id"), "root")
    members = scratch.write(images.select("image_id").join(related, "image_id", "left").select("image_id", F.coalesce("root", "image_id").alias("component")))
    total = members.count()
    sized = scratch.write(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    placed = sized.join(place(sized, named, total), "component")
    return join_unique(members, placed, "component", "size", max(total, 1)).select("image_id", "component", "split_name"), uses


def frame_splits(composed: DataFrame, manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """``clip, frame, split_name`` of every manifest frame: that of the images using it, else by its own hash."""
    placed, uses = _placed(images_of(composed), splits)
    # the images of one frame share a split, so any of them names it
    used = uses.join(placed.select("image_id", "split_name"), "image_id").groupBy("clip", "frame").agg(F.min("split_name").alias("used"))
    frames = manifest.select(clean_clip(F.col("clip")).alias("clip"), "frame").where("clip is not null and frame is not null").distinct()
    by_hash = _range(unit("clip", "frame", seed=SEED), [(name, share / 100) for name, share in _listed(splits)])
    return frames.join(used, ["clip", "frame"], "left").select("clip", "frame", F.coalesce("used", by_hash).alias("split_name"))
