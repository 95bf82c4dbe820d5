"""One-to-one matching within small groups (the boxes of an image, the blobs of a frame), and greedy suppression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions.geometry import iou
from reelgrain.operators.folds import streamed


def greedy_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """Finite pairs in the order of their cost (ties: the smaller row, then column), each taken if both its ends are free."""
    rows, columns = np.nonzero(np.isfinite(cost))
    left, right, out = set(), set(), []
    for at in np.lexsort((columns, rows, cost[rows, columns])):
        i, j = int(rows[at]), int(columns[at])
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


def greedy_assign(costs: DataFrame, keys: list[str], left: str, right: str, cost: str) -> DataFrame:
    """``keys, left, right, cost`` of the greedy assignment per key, from a table of allowed pairs.

    The pairs of one frame or image are few: they are sorted as an array and folded inside the JVM, so millions of groups
    cost no Python call each. Null costs and costs that aren't finite are not allowed; ties go to the smaller left, then
    right.
    """
    c = F.col(cost).cast("double")
    fine = costs.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    pair = F.struct(c.alias("c"), F.col(left).alias("l"), F.col(right).alias("r"))
    groups = fine.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    kind = groups.schema["_pairs"].dataType.simpleString()
    taken = F.aggregate(
        "_pairs",
        F.array().cast(kind),
        lambda kept, p: F.when(F.exists(kept, lambda k: (k["l"] == p["l"]) | (k["r"] == p["r"])), kept).otherwise(F.concat(kept, F.array(p))),
    )
    each = groups.select(*keys, F.explode(taken).alias("_k"))
    return each.select(*keys, F.col("_k.l").alias(left), F.col("_k.r").alias(right), F.col("_k.c").alias(cost))


def detections_matched(truth: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """``keys, k, hit, extra``: one row per true box (``k, box``) and its hit; ``extra`` found boxes unused per image, in
    a row of null ``k``. Boxes that are null count as missed or extra.

    True boxes choose in the order of ``k``: the free found box of greatest overlap (ties: the later), if that is at least
    ``least``; only hits are used up. The boxes of an image are few and are folded as arrays inside the JVM.
    """
    t = truth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "box"))).alias("t"))
    f = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "box"))).alias("f"))
    none = lambda c: F.coalesce(c, F.array())
    both = t.join(f, keys, "full").withColumn("_found", F.transform(F.filter(none(F.col("f")), lambda x: x["box"].isNotNull()), lambda x: x["box"]))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<boolean>").alias("hits"))

    def choose(state: Column, true: Column) -> Column:
        free = F.transform("_found", lambda box, i: F.struct(F.when(F.array_contains(state["used"], i), F.lit(-1.0)).otherwise(F.coalesce(iou(true["box"], box), F.lit(-1.0))).alias("o"), i.alias("i")))
        best = F.array_max(free)
        hit = F.coalesce((best["o"] >= least) & true["box"].isNotNull(), F.lit(False))
        used = F.when(hit, F.concat(state["used"], F.array(best["i"]))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    done = both.withColumn("_s", F.aggregate(F.coalesce("t", F.array().cast(t.schema["t"].dataType)), start, choose))
    true = F.transform(F.arrays_zip(F.transform("t", lambda x: x["k"].cast("bigint")).alias("k"), F.col("_s.hits").alias("hit")), lambda z: F.struct(z["k"].alias("k"), z["hit"].alias("hit"), F.lit(0).cast("bigint").alias("extra")))
    rest = F.struct(F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("boolean").alias("hit"), (F.size("_found") - F.size("_s.used")).cast("bigint").alias("extra"))
    kind = "array<struct<k:bigint,hit:boolean,extra:bigint>>"
    return done.select(*keys, F.explode(F.concat(F.coalesce(true.cast(kind), F.array().cast(kind)), F.array(rest).cast(kind))).alias("_r")).select(*keys, "_r.*")


class Scan:
    """Boxes kept so far, found again by size and place: a box can overlap another by more than ``most`` of their union only
    if their widths and heights differ by no more than that factor and their centres by less than the larger one."""

    def __init__(self, most: float):
        self.most, self.kept = most, {}

    def _cell(self, box: list) -> tuple[int, int, int]:
        w = max(box[2] - box[0], 1e-9)
        if self.most < 0.05:
            return 0, 0, 0
        level = math.floor(math.log(w) / -math.log(self.most)) if self.most < 1 else 0
        size = (1 / self.most) ** (level + 2)
        return level, math.floor((box[0] + box[2]) / 2 / size), math.floor((box[1] + box[3]) / 2 / size)

    def _near(self, box: list) -> Iterator[list]:
        if self.most < 0.05:
            yield from self.kept.get((0, 0, 0), [])
            return
        level = self._cell(box)[0]
        for own in (level - 1, level, level + 1):
            size = (1 / self.most) ** (own + 2)
            x, y = (math.floor((box[i] + box[i + 2]) / 2 / size) for i in (0, 1))
            for i in (x - 1, x, x + 1):
                for j in (y - 1, y, y + 1):
                    yield from self.kept.get((own, i, j), [])

    def take(self, box: list) -> bool:
        """Whether no kept box overlaps by more than ``most``; if so the box is kept too."""
        for k in self._near(box):
            w, h = min(box[2], k[2]) - max(box[0], k[0]), min(box[3], k[3]) - max(box[1], k[1])
            both = max(w, 0) * max(h, 0)
            union = (box[2] - box[0]) * (box[3] - box[1]) + (k[2] - k[0]) * (k[3] - k[1]) - both + 1e-9
            if both / union > self.most:
                return False
        self.kept.setdefault(self._cell(box), []).append(box)
        return True


def suppress(df: DataFrame, keys: list[str], order: list[str], box: str, most: float = 0.7) -> DataFrame:
    """Rows kept by greedy suppression in scan order: one overlapping a kept row by more than ``most`` is dropped.

    Of equal boxes only the first can be kept, so they are collapsed first, partially in every task; what is left of a key
    streams through one task in order, with an index of the kept boxes, of which a place holds few. Boxes without extent
    overlap nothing and are all kept. Rows without box or with a null in it are dropped.
    """
    rows = df.where(F.col(box).isNotNull() & F.forall(box, lambda v: v.isNotNull()) & (F.size(box) == 4))
    flat = (F.get(box, F.lit(2)) <= F.get(box, F.lit(0))) | (F.get(box, F.lit(3)) <= F.get(box, F.lit(1)))
    first = rows.where(~flat).groupBy(*keys, F.col(box).alias("_box")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    solid = first.select("_row.*")

    def fold():
        scan = Scan(most)
        return lambda key, row: dict(row) if scan.take([float(v) for v in row[box]]) else None

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return streamed(solid, keys, order, fold, shape).unionByName(rows.where(flat))

