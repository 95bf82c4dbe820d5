"""Problem 1: stretches of an ordered event sequence in which the event stays (nearly) the same.

Method: associative run summaries. Rows are range-partitioned and sorted by (clip, frame); every partition
(chunk) encodes its own runs. Only the first and the last run of a chunk can grow, so those alone enter a
parallel prefix merge over a tree of chunks with fan-in ``FAN_IN``: two neighbouring summaries combine by
joining the last run of the left with the first run of the right where they are compatible. A clip that holds
a third of all rows is simply cut into more chunks.

Defined results: rows with null ``clip``, ``frame`` or ``robots`` or with a null (or malformed) ``bbox`` among
the outlines take no part; a frame without outlines belongs to no run and separates its neighbours; repeated
rows count once, of rewritten frames the latest holds (null ``written_at`` is the earliest, further ties go to
the greater content); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.sources.scratch import Scratch
from reelgrain.sources.tables import clean_clip, latest

MAX_GAP = 60
TOLERANCE = 4
FAN_IN = 64

RUN = (
    "chunk int, ordinal long, is_first boolean, is_last boolean, clip string, first_frame long, last_frame long, "
    "n_frames long, n_outlines int, first_boxes array<int>, last_boxes array<int>"
)
_COLS = [c.split()[0] for c in RUN.split(", ")]


def frames_of(manifest: DataFrame) -> DataFrame:
    """``clip, frame, n, boxes``: the frames that take part, boxes flattened to 4 integers per outline."""
    raw = manifest.select(
        clean_clip(F.col("clip")).alias("clip"),
        "frame",
        "written_at",
        F.transform("robots", lambda r: r["bbox"]).alias("b"),
    ).where("clip is not null and frame is not null")
    # null robots sort first and lose ties against content
    last = latest(raw, ["clip", "frame"], "written_at", ["b"])
    return last.where(
        "b is not null and forall(b, x -> x is not null and size(x) = 4 and forall(x, v -> v is not null))"
    ).select("clip", "frame", F.size("b").alias("n"), F.flatten("b").alias("boxes"))


def _matching(close: np.ndarray) -> bool:
    """Whether a square boolean matrix has a perfect matching (augmenting paths)."""
    owner = [-1] * len(close)

    def place(i: int, seen: set[int]) -> bool:
        for j in np.flatnonzero(close[i]):
            if j not in seen:
                seen.add(j)
                if owner[j] < 0 or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(close)))


def paired(a: np.ndarray, b: np.ndarray, tolerance: int = TOLERANCE) -> np.ndarray:
    """For boxes of shape (rows, n, 4): rows whose n boxes pair one to one, all values within ``tolerance``."""
    n = a.shape[1]
    close = np.ones((len(a), n, n), bool)
    for c in range(4):
        close &= np.abs(a[:, :, None, c] - b[:, None, :, c]) <= tolerance
    if n <= 3:
        out = np.zeros(len(a), bool)
        for p in permutations(range(n)):
            out |= close[:, list(range(n)), list(p)].all(axis=1)
        return out
    able = close.any(axis=1).all(axis=1) & close.any(axis=2).all(axis=1)
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(able):
        out[i] = bool(close[i].diagonal().all()) or _matching(close[i])
    return out


def continues(clip, frame, n, boxes, max_gap: int, tolerance: int) -> np.ndarray:
    """Flag per row (not the first): it continues the row before it. ``boxes`` is a list of flat arrays."""
    ok = (clip[1:] == clip[:-1]) & (frame[1:] - frame[:-1] <= max_gap) & (n[1:] == n[:-1]) & (n[1:] > 0)
    for size in np.unique(n[1:][ok]):
        at = np.flatnonzero(ok & (n[1:] == size))
        a = np.concatenate([boxes[i] for i in at]).reshape(len(at), size, 4).astype(np.int64)
        b = np.concatenate([boxes[i + 1] for i in at]).reshape(len(at), size, 4).astype(np.int64)
        ok[at] = paired(a, b, tolerance)
    return ok


def _encode(max_gap: int, tolerance: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, ordinal, held = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            boxes = list(pdf["boxes"])
            clip, frame, n = pdf["clip"].to_numpy(object), pdf["frame"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
            if held is not None:  # the open run goes in front, represented by its last frame
                boxes = [held["last_boxes"], *boxes]
                clip, frame, n = np.append([held["clip"]], clip), np.append([held["last_frame"]], frame), np.append([held["n_outlines"]], n)
            start = np.flatnonzero(np.append([True], ~continues(clip, frame, n, boxes, max_gap, tolerance)))
            stop = np.append(start[1:], len(frame)) - 1
            out = pd.DataFrame({
                "chunk": chunk, "ordinal": ordinal + np.arange(len(start)), "is_first": False, "is_last": False,
                "clip": clip[start], "first_frame": frame[start], "last_frame": frame[stop], "n_frames": stop - start + 1,
                "n_outlines": n[start], "first_boxes": [boxes[i] for i in start], "last_boxes": [boxes[i] for i in stop],
            })
            if held is not None:
                out.at[0, "first_frame"] = held["first_frame"]
                out.at[0, "first_boxes"] = held["first_boxes"]
                out.at[0, "n_frames"] += held["n_frames"] - 1
            out["is_first"] = out["ordinal"] == 0
            ordinal += len(out) - 1
            held = out.iloc[-1].to_dict()
            if len(out) > 1:
                yield out.iloc[:-1]
        if held is not None:
            held["is_last"] = True
            yield pd.DataFrame([held])[_COLS]

    return encode


def _merge(max_gap: int, tolerance: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Combine the ordered edge runs of one block of chunks; its own first and last run stay edges."""
        pdf = pdf.sort_values(["chunk", "ordinal"], ignore_index=True)
        clip, n = pdf["clip"].to_numpy(object), pdf["n_outlines"].to_numpy(np.int64)
        first, last = pdf["first_frame"].to_numpy(np.int64), pdf["last_frame"].to_numpy(np.int64)
        chunk = pdf["chunk"].to_numpy()
        joins = [False]
        for i in range(1, len(pdf)):
            pair = chunk[i] != chunk[i - 1] and clip[i] == clip[i - 1] and first[i] - last[i - 1] <= max_gap and n[i] == n[i - 1] > 0
            if pair:
                a = np.asarray(pdf["last_boxes"][i - 1], np.int64).reshape(1, -1, 4)
                b = np.asarray(pdf["first_boxes"][i], np.int64).reshape(1, -1, 4)
                pair = bool(paired(a, b, tolerance)[0])
            joins.append(pair)
        run = np.cumsum(~np.array(joins)) - 1
        out = pdf.assign(run=run).groupby("run", as_index=False).agg(
            clip=("clip", "first"), first_frame=("first_frame", "first"), last_frame=("last_frame", "last"), n_frames=("n_frames", "sum"),
            n_outlines=("n_outlines", "first"), first_boxes=("first_boxes", "first"), last_boxes=("last_boxes", "last"),
        )
        out["chunk"] = int(chunk[0]) // FAN_IN
        out["ordinal"] = np.arange(len(out))
        out["is_first"], out["is_last"] = out["ordinal"] == 0, out["ordinal"] == len(out) - 1
        return out[_COLS]

    return merge


def runs(frames: DataFrame, max_gap: int = MAX_GAP, tolerance: int = TOLERANCE) -> DataFrame:
    """All runs of ``frames`` (``clip, frame, n, boxes``; one row per clip and frame), single frames included.

    Result: ``clip, first_frame, last_frame, n_frames, duration, n_outlines``; ``duration`` is in frames, last - first.
    """
    spark = frames.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = frames.select("clip", "frame", "n", "boxes").repartitionByRange(parts, "clip", "frame").sortWithinPartitions("clip", "frame")
    local = Scratch(spark, "runs").write(chunks.mapInPandas(_encode(max_gap, tolerance), RUN))
    closed = local.where("not is_first and not is_last")
    # at most two rows per chunk, so every block has at most 2 * FAN_IN rows
    edge = local.where("is_first or is_last")
    done = [closed]
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), FAN_IN)))):
        merged = edge.groupBy(F.floor(F.col("chunk") / FAN_IN).alias("block")).applyInPandas(_merge(max_gap, tolerance), RUN)
        edge = merged.where("is_first or is_last")
        done.append(merged.where("not is_first and not is_last"))
    out = edge
    for part in done:
        out = out.unionByName(part)
    return out.select("clip", "first_frame", "last_frame", "n_frames", (F.col("last_frame") - F.col("first_frame")).alias("duration"), "n_outlines")


def repeated_runs(manifest: DataFrame, max_gap: int = MAX_GAP, tolerance: int = TOLERANCE, min_frames: int = 2) -> DataFrame:
    """Stretches of at least ``min_frames`` frames whose boxes stay as they were (see the module's text)."""
    return runs(frames_of(manifest), max_gap, tolerance).where(F.col("n_frames") >= min_frames)
