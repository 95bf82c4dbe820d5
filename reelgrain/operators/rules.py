"""Rules with reasons, warnings and verdicts as single expressions. Thresholds are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrain.functions.geometry import touches


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds, in the order given; null conditions count as false."""
    each = [F.when(F.coalesce(cond, F.lit(False)), F.lit(text) if isinstance(text, str) else text) for cond, text in rules]
    return F.array_compact(F.array(*each))


@dataclass(frozen=True)
class OutlineRules:
    max_unlabelled: float = 0.25
    min_moving: float = 0.15
    fragment: float = 0.07
    fragment_reach: int = 15


# The texts of the reasons, in the order they are given; those of two go on with the list's own words.
REASONS = {
    "none": "no robot outlined",
    "one": "only one robot found",
    "many": "more than two robot-sized things",
    "missed": "a region got no clean outline",
    "change": "unlabelled change",
    "static": "static object",
    "edge": "robot at the arena edge",
    "piece": "second outline may be a piece of the first",
    "contact": "robots in contact",
    "clip": "clip not trusted: ",
    "review": "rejected on review: ",
}


def outline_reasons(rules: OutlineRules = OutlineRules(), contact: Column | None = None, untrusted: Column | None = None, rejected: Column | None = None) -> Column:
    """Why a frame of outlines (``robots, extra, missed, unlabelled``) isn't trusted; empty means it is.

    ``contact``, ``untrusted`` and ``rejected`` come from the fold over the clip and from review lists. A null array of
    outlines counts as none.
    """
    robots = F.coalesce(F.col("robots"), F.array().cast("array<struct<area:int,on_change:double,moving:double,at_edge:boolean,bbox:array<int>,mean:double>>"))
    n = F.size(robots)
    by_area = F.array_sort(robots, lambda a, b: F.when(a["area"] < b["area"], -1).when(a["area"] > b["area"], 1).otherwise(0))
    small, big = F.get(by_area, F.lit(0)), F.get(by_area, F.lit(1))
    fragment = (n == 2) & (small["area"] < rules.fragment * big["area"]) & touches(small["bbox"], big["bbox"], rules.fragment_reach)
    holds = {
        "none": n == 0, "one": n == 1, "many": (n > 2) | F.col("extra"), "missed": F.col("missed"), "change": F.col("unlabelled") > rules.max_unlabelled,
        "static": F.exists(robots, lambda r: r["moving"] < rules.min_moving), "edge": F.exists(robots, lambda r: r["at_edge"]), "piece": fragment,
        "contact": contact, "clip": None if untrusted is None else untrusted.isNotNull(), "review": None if rejected is None else rejected.isNotNull(),
    }
    said = {"clip": untrusted, "review": rejected}
    listed = [(holds[k], F.concat(F.lit(t), said[k]) if k in said else t) for k, t in REASONS.items() if holds[k] is not None]
    return reasons(*listed)


def pose_kind(on_change: Column, at_edge: Column, moving: Column, width_ratio: Column, min_change: float = 0.55, still: float = 0.15, lifted: float = 1.4) -> Column:
    """``still`` before ``lifted``; null where the outline isn't used."""
    usable = (on_change >= min_change) & ~F.coalesce(at_edge, F.lit(False))
    return F.when(usable & (moving < still), "still").when(usable & (width_ratio > lifted), "lifted")


def graded(no_go: Column, go: Column) -> Column:
    """NO-GO, else GO, else MARGINAL; null conditions count as not met."""
    return F.when(F.coalesce(no_go, F.lit(False)), "NO-GO").when(F.coalesce(go, F.lit(False)), "GO").otherwise("MARGINAL")


def reconstruction_verdict(models: Column, ratio: Column, dominance: Column, error: Column, gap: Column) -> Column:
    no_go = (models == 0) | (ratio < 0.40) | (dominance < 0.5)
    return graded(no_go, (dominance >= 0.9) & (ratio >= 0.80) & (error < 1.0) & (gap <= 0.05))


def splat_verdict(intact: Column, psnr: Column, ssim: Column, floaters: Column, floor_ok: Column) -> Column:
    no_go = ~F.coalesce(intact, F.lit(False)) | (psnr < 18) | (floaters > 0.5)
    return graded(no_go, (psnr >= 25) & (ssim >= 0.85) & (floaters <= 0.05) & floor_ok)


def report_verdict(failed: Column, warnings: Column) -> Column:
    return F.when(F.size(failed) > 0, "NO-GO").when(F.size(warnings) > 0, "MARGINAL").otherwise("GO")
