"""Boxes, boards and projections as column expressions.

A box column is ``array<int>`` x0, y0, x1, y1 with inclusive maxima, as the manifests store it; ``xywh`` boxes are
structs x, y, w, h. The two are never mixed: ``from_xywh`` converts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def side(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def from_xywh(b: Column) -> Column:
    return F.array(b["x"], b["y"], b["x"] + b["w"] - 1, b["y"] + b["h"] - 1)


def touches(a: Column, b: Column, reach: int = 0) -> Column:
    """Boxes overlap or share a border when one is grown by ``reach``."""
    return (
        (side(a, 0) - reach <= side(b, 2)) & (side(b, 0) - reach <= side(a, 2)) & (side(a, 1) - reach <= side(b, 3)) & (side(b, 1) - reach <= side(a, 3))
    )


def in_xywh(x: Column, y: Column, b: Column, pad: int = 0) -> Column:
    return x.between(b["x"] - pad, b["x"] + b["w"] + pad) & y.between(b["y"] - pad, b["y"] + b["h"] + pad)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; sides count as x1 - x0, and 1e-9 keeps empty boxes defined."""
    w = F.greatest(F.least(side(a, 2), side(b, 2)) - F.greatest(side(a, 0), side(b, 0)), F.lit(0)).cast("double")
    h = F.greatest(F.least(side(a, 3), side(b, 3)) - F.greatest(side(a, 1), side(b, 1)), F.lit(0)).cast("double")
    area = lambda c: ((side(c, 2) - side(c, 0)) * (side(c, 3) - side(c, 1))).cast("double")
    return w * h / (area(a) + area(b) - w * h + F.lit(1e-9))


def grown(box: Column, share: float, width: int, height: int) -> Column:
    """Box padded by ``share`` of its sides and kept inside the image."""
    dx, dy = (side(box, 2) - side(box, 0)) * share, (side(box, 3) - side(box, 1)) * share
    return F.array(
        F.greatest(F.lit(0), F.floor(side(box, 0) - dx)).cast("int"), F.greatest(F.lit(0), F.floor(side(box, 1) - dy)).cast("int"),
        F.least(F.lit(width - 1), F.floor(side(box, 2) + dx)).cast("int"), F.least(F.lit(height - 1), F.floor(side(box, 3) + dy)).cast("int"),
    )


def normalised(box: Column, width: int, height: int) -> list[Column]:
    """Centre and size of a box (inclusive maxima) as shares of the image."""
    x0, y0, x1, y1 = (side(box, i).cast("double") for i in range(4))
    return [(x0 + x1 + 1) / 2 / width, (y0 + y1 + 1) / 2 / height, (x1 - x0 + 1) / width, (y1 - y0 + 1) / height]


def label_row(box: Column, width: int, height: int, cls: int = 0) -> Column:
    """Text row ``class cx cy w h`` with 6 decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(cls), *normalised(box, width, height))


def label_inside(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return (cx - w / 2 >= 0) & (cx + w / 2 <= 1) & (cy - h / 2 >= 0) & (cy + h / 2 <= 1)


def stand(box: Column) -> Column:
    """Where a robot stands: the middle of its box's lower side."""
    return F.struct(((side(box, 0) + side(box, 2)) / 2).alias("x"), side(box, 3).cast("double").alias("y"))


def moved(box: Column, x: Column, y: Column, scale: Column) -> Column:
    """Box scaled about its stand point and put at (x, y); corners are truncated."""
    w, h = (side(box, 2) - side(box, 0)) * scale, (side(box, 3) - side(box, 1)) * scale
    return F.array((x - w / 2).cast("int"), (y - h).cast("int"), (x + w / 2).cast("int"), y.cast("int"))


def project(h: list[list[float]], x: Column, y: Column) -> Column:
    """Point through a 3x3 homography."""
    r = [F.lit(float(row[0])) * x + F.lit(float(row[1])) * y + F.lit(float(row[2])) for row in h]
    return F.struct((r[0] / r[2]).alias("x"), (r[1] / r[2]).alias("y"))


def inverse(h: list[list[float]]) -> list[list[float]]:
    return np.linalg.inv(np.asarray(h, float)).tolist()


def homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[list[float]]:
    """3x3 matrix taking ``src`` to ``dst`` in the least-squares sense; at least 4 pairs, not all on a line."""
    if len(src) != len(dst) or len(src) < 4:
        raise ValueError("at least 4 pairs of points are needed, as many on either side")
    rows = []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    _, s, vt = np.linalg.svd(np.asarray(rows, float))
    if s[7] < 1e-9 * s[0]:
        raise ValueError("the points don't determine a homography")
    return (vt[-1] / vt[-1][8]).reshape(3, 3).tolist()


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Point in polygon by ray casting, as one expression."""
    odd = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]):
        if y0 == y1:
            continue
        cross = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < F.lit((x1 - x0) / (y1 - y0)) * (y - F.lit(y0)) + F.lit(x0))
        odd = odd + cross.cast("int")
    return odd % 2 == 1


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of 2-d points, counter-clockwise."""
    pts = sorted({(float(a), float(b)) for a, b in points})
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)
    half = []
    for seq in (pts, pts[::-1]):
        chain: list[tuple[float, float]] = []
        for p in seq:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        half += chain[:-1]
    return np.array(half)
