"""Connected components by alternating large-star and small-star, safe against hot nodes.

Before the first round every task links what is already linked among its own edges, ``BLOCK`` of them at a time: the edges
left are at most one per node and block, and chains within a block are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.sources.scratch import Scratch

HOT_SHARE = 1000
BLOCK = 1_000_000


def join_unique(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key`` and in ``n`` the rows it meets.

    Keys meeting more than ``total / HOT_SHARE`` rows are at most HOT_SHARE many, whatever the data, so that part of
    ``right`` may be broadcast and a hot key is not gathered in one task; the others are joined by a shuffle.
    """
    hot = right.where(F.col(n) > max(total / HOT_SHARE, 1000))
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= max(total / HOT_SHARE, 1000)), key)
    )


def _star(edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star over edges ``a > b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select(F.col("a").alias("b"), F.least("a", "m").alias("m"), "n")
    large = join_unique(edges, least, "b", "n", total).select("a", F.col("m").alias("b")).distinct()
    small = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_unique(large, small, "a", "n", total)
    pairs = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pairs.unionByName(small.select("a", F.col("m").alias("b"))).distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, root)`` of the graph of edges (a, b): the smallest node each is linked with."""
    nodes, at = np.unique(np.append(a, b), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:  # every label points at a root
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_edges = label[i] != label[j]
        i, j = i[open_edges], j[open_edges]
    return nodes, nodes[label]


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task, block by block, as stars: the same components, with an edge per node that isn't the smallest."""
    held, size = [], 0

    def stars() -> pd.DataFrame:
        nodes, root = roots(*(np.concatenate([h[c].to_numpy(np.int64) for h in held]) for c in ("a", "b")))
        own = nodes != root
        return pd.DataFrame({"a": nodes[own], "b": root[own]})

    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= BLOCK:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` long) that isn't its component's smallest.

    Loops, nulls and repeated edges are allowed and have no effect. Every round is a written table; the driver sees
    a count and a checksum. Ends when a round changes nothing, which is a forest of stars.
    """
    scratch = Scratch(edges.sparkSession, "components")
    given = scratch.write(edges.where("a <> b").select("a", "b"))
    tasks = -(-given.count() // BLOCK)
    now = given.coalesce(max(tasks, 1)).mapInPandas(_link, "a long, b long")
    now, before = scratch.write(now.distinct() if tasks > 1 else now), None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, last = mark, now
        now = scratch.write(_star(last, mark[0]))
        scratch.drop(last)
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
