"""Neighbourhood operations on small pictures: numpy functions and Arrow functions over binary columns.

They exist because no expression reaches a pixel's neighbours. Pictures are grey, row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOB = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType() if c in ("cx", "cy", "intensity") else T.IntegerType()) for c in ("cx", "cy", "x", "y", "w", "h", "area", "intensity")]))


def box_sum(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows, borders reflected, by cumulative sums."""
    r = size // 2
    p = np.pad(a.astype(float), r, mode="reflect")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def texture_match(a: np.ndarray, b: np.ndarray, size: int = 21) -> np.ndarray:
    """Local correlation of two pictures; the product of variances is at least 1."""
    n = size * size
    ma, mb = box_sum(a, size) / n, box_sum(b, size) / n
    va, vb = box_sum(a.astype(float) ** 2, size) / n - ma**2, box_sum(b.astype(float) ** 2, size) / n - mb**2
    cov = box_sum(a.astype(float) * b, size) / n - ma * mb
    return cov / np.sqrt(np.maximum(va * vb, 1.0))


def smoothed(a: np.ndarray) -> np.ndarray:
    """5 x 5 Gaussian blur in whole levels, borders reflected: binomial weights 1 4 6 4 1 both ways."""
    p = np.pad(a.astype(np.int64), 2, mode="reflect")
    rows = sum(w * p[i : i + a.shape[0]] for i, w in enumerate((1, 4, 6, 4, 1)))
    both = sum(w * rows[:, i : i + a.shape[1]] for i, w in enumerate((1, 4, 6, 4, 1)))
    return (both + 128) // 256


def grown(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels with one of the mask within a size x size window; beyond the border there is none."""
    r = size // 2
    c = np.pad(np.pad(mask > 0, r).astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size] > 0


def shrunk(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels whose whole window, as far as it lies in the picture, is in the mask."""
    return ~grown(mask == 0, size)


def floor_gain(gray: np.ndarray, plate: np.ndarray, mask: np.ndarray) -> float:
    """Median plate level of the floor over the frame's, the latter at least 1."""
    return float(np.median(plate[mask > 0]) / max(np.median(gray[mask > 0]), 1.0))


def changed(gray: np.ndarray, plate: np.ndarray, mask: np.ndarray, diff: float = 28, match: float = 0.6) -> np.ndarray:
    """Pixels of the mask that differ from the plate in level and in texture, once the frame is as bright as the plate and
    both are blurred; specks of less than 3 x 3 are removed and gaps of less than 15 x 15 closed."""
    if not (mask > 0).any():
        return np.zeros(gray.shape, bool)
    lit = np.clip(np.rint(gray.astype(float) * floor_gain(gray, plate, mask)), 0, 255)
    a, b = smoothed(lit), smoothed(plate)
    on = (np.abs(a - b) > diff) & (texture_match(a, b) < match) & (mask > 0)
    opened = grown(shrunk(on, 3), 3)
    return shrunk(grown(opened, 15), 15)


def patch_at(gray: np.ndarray, x: float, y: float, half: int) -> np.ndarray | None:
    """The picture around a place, cut at the border; None if it is 10 pixels or less either way."""
    x, y = int(x), int(y)
    cut = gray[max(0, y - half) : max(0, y + half), max(0, x - half) : max(0, x + half)]
    return cut.copy() if min(cut.shape) > 10 else None


def find_patch(gray: np.ndarray, patch: np.ndarray, at: tuple[float, float], margin: int, least: float) -> tuple[float, float] | None:
    """Centre of the place near ``at`` that looks most like the patch (normalised correlation, ``least`` at least).

    Sums over windows come from cumulative sums, products from one Fourier transform.
    """
    h, w = patch.shape
    x0, y0 = max(0, int(at[0]) - w // 2 - margin), max(0, int(at[1]) - h // 2 - margin)
    area = gray[y0 : max(0, int(at[1]) + h // 2 + margin), x0 : max(0, int(at[0]) + w // 2 + margin)].astype(float)
    if area.shape[0] < h or area.shape[1] < w:
        return None
    own = patch.astype(float) - patch.mean()
    size = (area.shape[0] + h, area.shape[1] + w)
    cross = np.fft.irfft2(np.fft.rfft2(area, size) * np.fft.rfft2(own[::-1, ::-1], size), size)[h - 1 : area.shape[0], w - 1 : area.shape[1]]
    window = lambda a: (lambda c: c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w])(np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))))
    spread = np.maximum(window(area * area) - window(area) ** 2 / (h * w), 0)
    score = cross / np.sqrt(np.maximum(spread * (own * own).sum(), 1e-6))
    i, j = np.unravel_index(int(np.argmax(np.round(score, 9))), score.shape)
    return (x0 + j + w / 2, y0 + i + h / 2) if score[i, j] >= least else None


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1 ... n of the 8-connected regions of a mask, in scan order of their first pixel.

    Runs of a row are united with those they touch in the row before.
    """
    root: list[int] = [0]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = np.zeros(mask.shape, np.int64)
    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask > 0):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            own = [find(k) for s, e, k in above if s <= b and e >= a]
            label = min(own) if own else len(root)
            if not own:
                root.append(label)
            for k in own:
                root[k] = label
            out[y, a:b] = label
            now.append((a, b, label))
        above = now
    flat = np.array([find(i) for i in range(len(root))])
    names = np.unique(flat[1:]) if len(root) > 1 else np.zeros(0, int)
    number = np.zeros(len(root), np.int64)
    number[names] = np.arange(1, len(names) + 1)
    return number[flat][out]


def blobs(mask: np.ndarray, gray: np.ndarray, least: int = 400, most: int = 25_000) -> list[tuple]:
    """``(cx, cy, x, y, w, h, area, intensity)`` of regions of fitting area; intensity is the mean over the whole box."""
    labels = components(mask)
    out = []
    for k in range(1, int(labels.max()) + 1):
        y, x = np.nonzero(labels == k)
        if least <= len(x) <= most:
            box = gray[y.min() : y.max() + 1, x.min() : x.max() + 1]
            out.append((float(x.mean()), float(y.mean()), int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, len(x), float(box.mean())))
    return out


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest region of a mask (ties: the first)."""
    labels = components(mask)
    if not labels.any():
        return np.zeros(mask.shape, bool)
    return labels == int(np.bincount(labels.ravel())[1:].argmax()) + 1


def otsu(gray: np.ndarray) -> int:
    """Level that separates a picture's two classes best."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w = n.cumsum()
    m = (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return box_sum_zero(mask, size) > 0


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return box_sum_zero(mask == 0, size) == 0


def box_sum_zero(mask: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    c = np.pad(np.pad((mask > 0).astype(np.int64), r).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def arena(gray: np.ndarray, close: int = 15) -> np.ndarray:
    """Floor mask: bright pixels, gaps closed, largest region."""
    return largest(erode(dilate(gray > otsu(gray), close), close))


def distance(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest one outside the mask, exact: column distances, then rows' lower envelope."""
    h, w = mask.shape
    far = float(h + w)
    col = np.where(mask > 0, far, 0.0)
    for y in range(1, h):
        col[y] = np.minimum(col[y], col[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        col[y] = np.minimum(col[y], col[y + 1] + 1)
    x = np.arange(w)
    return np.sqrt(np.stack([(col[y][None, :] ** 2 + (x[:, None] - x[None, :]) ** 2).min(axis=1) for y in range(h)]))


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian."""
    g = np.pad(gray.astype(float), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def square_gap(mask: np.ndarray) -> float:
    """Share of a region's hull that it doesn't fill."""
    from reelgrain.functions.geometry import hull

    y, x = np.nonzero(largest(mask))
    if not len(x):
        return float("nan")
    corners = np.concatenate([np.stack([x + i, y + j], axis=1) for i in (0, 1) for j in (0, 1)])
    h = hull(corners)
    area = abs(float((h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)).sum())) / 2
    return 1 - len(x) / area


@F.pandas_udf(T.DoubleType())
def sharpness_of(gray: pd.Series, width: pd.Series) -> pd.Series:
    """Blur score of grey frames as bytes; null without picture."""
    return pd.Series([None if g is None else sharpness(np.frombuffer(g, np.uint8).reshape(-1, int(w))) for g, w in zip(gray, width)], dtype="float64")


@F.pandas_udf(BLOB)
def blobs_of(mask: pd.Series, gray: pd.Series, width: pd.Series) -> pd.Series:
    """Blobs of masks and frames as bytes."""
    names = ("cx", "cy", "x", "y", "w", "h", "area", "intensity")
    out = []
    for m, g, w in zip(mask, gray, width):
        shape = (-1, int(w))
        found = blobs(np.frombuffer(m, np.uint8).reshape(shape), np.frombuffer(g, np.uint8).reshape(shape)) if m is not None and g is not None else []
        out.append([dict(zip(names, b)) for b in found])
    return pd.Series(out)
