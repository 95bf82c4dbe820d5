"""Problem 5: for every point the k nearest points of its scene, in x, y, z.

Method: learned partitions. Per scene a bounded sample (at most ``PER_PART * MAX_PARTS`` places) gives a neighbour
graph; recursive bisection with balanced refinement cuts it into parts of equal size; a small softmax classifier learns
the parts. Where a scene has more than ``SLACK * PART`` places to a part (``MAX_PARTS`` are learnt at most), each part is
held as several slices, so that no task's share grows with the scene. Every place is put in its most probable part, every query goes to its most probable parts and is reranked
there by exact distance. A check follows: parts whose bounding box comes nearer than the k-th neighbour found, and that
were not asked, are asked too, so that the result is exact.

Work is done on places (distinct coordinates of a scene): points at one place share their neighbours, and of the points
at a place only the ``k + 1`` of smallest id can be anybody's neighbour. A hot place is thus one query and one entry.

Defined results: points with a null id or scene, or a null, NaN or infinite coordinate take no part; repeated rows count
once; of equally near points the smaller id comes first; a scene of fewer points gives fewer neighbours; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.llm.graphs import join_unique
from reelgrain.sources.scratch import Scratch

K = 8
PART = 6000
MAX_PARTS = 1024
PER_PART = 32
GRAPH_K = 8
SALT = 100_000
COVER = 0.97
MAX_ROUTES = 5
SLACK = 2
PLACE = ["scene", "x", "y", "z"]


# ---- training on a sample ----


def knn_graph(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric edges (a, b) of the k-nearest-neighbour graph of a few thousand points."""
    n, k = len(points), min(k, len(points) - 1)
    norm = (points**2).sum(axis=1)
    near = np.empty((n, k), np.int64)
    step = max(1, 8_000_000 // n)
    for at in range(0, n, step):
        d = norm - 2 * points[at : at + step] @ points.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near[at : at + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    a, b = np.repeat(np.arange(n), k), near.ravel()
    return np.append(a, b), np.append(b, a)


def _bisect(points: np.ndarray, a: np.ndarray, b: np.ndarray, left: float) -> np.ndarray:
    """Side (bool) of each node of a graph: ``left`` of them False, few edges between the sides."""
    n = len(points)
    centred = points - points.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    v = centred @ axis
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    for _ in range(10):  # smoothing along the edges brings neighbours to one side
        v = v / 2 + np.bincount(a, v[b], n) / degree / 2
    cut = int(round(n * left))
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[cut:]] = True
    for _ in range(5):  # exchange the nodes that gain most, as many from either side
        other = np.bincount(a, (side[a] != side[b]).astype(float), n)
        gain = 2 * other - degree
        one, two = np.flatnonzero(~side), np.flatnonzero(side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(len(one), len(two))
        take = int((gain[one[:m]] + gain[two[:m]] > 0).sum())
        if not take:
            break
        take = max(1, take // 2)
        side[one[:take]], side[two[:take]] = True, False
    return side


def partition_graph(points: np.ndarray, parts: int, k: int = GRAPH_K) -> np.ndarray:
    """Balanced parts 0 ... parts - 1 of the points' neighbour graph."""
    label = np.zeros(len(points), np.int64)
    a, b = knn_graph(points, k)
    todo = [(np.arange(len(points)), 0, parts)]
    while todo:
        nodes, first, n = todo.pop()
        if n == 1 or len(nodes) < 2:
            label[nodes] = first
            continue
        number = np.full(len(points), -1)
        number[nodes] = np.arange(len(nodes))
        inside = (number[a] >= 0) & (number[b] >= 0)
        side = _bisect(points[nodes], number[a[inside]], number[b[inside]], (n // 2) / n)
        todo += [(nodes[~side], first, n // 2), (nodes[side], first + n // 2, n - n // 2)]
    return label


def features(points: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised coordinates, their squares and 1; coordinates far out are drawn in."""
    u = np.clip((points - mean) / scale, -8, 8)
    return np.hstack([u, u * u, np.ones((len(u), 1))])


def train(points: np.ndarray, parts: int) -> dict:
    """The classifier of one scene: softmax regression on the parts of the sample's neighbour graph."""
    mean = np.median(points, axis=0)
    scale = np.maximum(np.quantile(np.abs(points - mean), 0.75, axis=0), 1e-12)
    parts = max(1, min(parts, len(points) // 2))
    label = partition_graph((points - mean) / scale, parts)
    _, label = np.unique(label, return_inverse=True)
    parts = int(label.max()) + 1
    x = features(points, mean, scale)
    u = x[:, :3]
    size = np.bincount(label, minlength=parts).astype(float)
    centre = np.stack([np.bincount(label, u[:, c], parts) for c in range(3)], axis=1) / size[:, None]
    spread = max(float(((u - centre[label]) ** 2).mean()), 1e-9)
    # linear discriminants start it, gradient steps sharpen it
    w = np.zeros((7, parts))
    w[:3], w[6] = centre.T / spread, np.log(size / len(u)) - (centre**2).sum(axis=1) / (2 * spread)
    m, v = np.zeros_like(w), np.zeros_like(w)
    rounds = 40 if parts > 1 else 0
    rng = np.random.default_rng(5)
    for t in range(1, rounds + 1):
        rows = np.arange(len(x)) if len(x) <= 4096 else rng.choice(len(x), 4096, replace=False)
        p = _softmax(x[rows] @ w)
        p[np.arange(len(rows)), label[rows]] -= 1
        g = x[rows].T @ p / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * 0.2
    return {"mean": mean.tolist(), "scale": scale.tolist(), "w": w.ravel().tolist(), "parts": parts}


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def route(points: np.ndarray, model: dict, cover: float = COVER, most: int = MAX_ROUTES) -> np.ndarray:
    """Most probable parts of each point, best first, -1 where ``cover`` is reached."""
    parts = int(model["parts"])
    w = np.asarray(model["w"], float).reshape(7, parts)
    most = min(most, parts)
    out = np.full((len(points), most), -1, np.int64)
    step = max(1, 4_000_000 // parts)
    for at in range(0, len(points), step):
        p = _softmax(features(points[at : at + step], np.asarray(model["mean"]), np.asarray(model["scale"])) @ w)
        top = np.argpartition(-p, most - 1, axis=1)[:, :most] if most < parts else np.tile(np.arange(parts), (len(p), 1))
        q = np.take_along_axis(p, top, axis=1)
        order = np.argsort(-q, axis=1, kind="stable")
        top, q = np.take_along_axis(top, order, axis=1), np.take_along_axis(q, order, axis=1)
        before = np.cumsum(q, axis=1) - q
        top[before >= cover] = -1
        out[at : at + step] = top
    return out


# ---- exact distances within a part ----


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size`` near each other, by halving along the widest axis."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = points[rows]
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _kth(queries: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances but for rounding, and each query's k-th smallest."""
    d = (queries**2).sum(axis=1)[:, None] + (places**2).sum(axis=1) - 2 * queries @ places.T
    return d, np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else d.max(axis=1)


def nearest(queries: np.ndarray, places: np.ndarray, first: np.ndarray, ids: np.ndarray, k: int, leaf: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, distances, ids)``: for each query the k nearest ids of ``places``, by distance, then id.

    The ids at place i are ``ids[first[i] : first[i + 1]]``; the result of query j lies at ``offsets[j] : offsets[j + 1]``.
    Queries are taken in small groups: some places around a group bound its k-th distances, and only places within that
    bound of the group's box are compared.
    """
    counts, m = np.diff(first), min(k, len(places))
    found: list[list[np.ndarray]] = [[], [], []]
    few = 4 * (leaf + k)
    for rows in leaves(queries, leaf if len(places) > 2 * few else max(leaf, 2_000_000 // len(places))):
        block = queries[rows]
        lo, hi = block.min(axis=0), block.max(axis=0)
        centre = (lo + hi) / 2
        near = np.arange(len(places))
        if len(places) > 2 * few:
            gap = np.maximum(np.maximum(lo - places, places - hi), 0)
            gap = (gap * gap).sum(axis=1)
            some = np.argpartition(gap, few)[:few]
            bound = _kth(block - centre, places[some] - centre, m)[1].max()
            near = np.flatnonzero(gap <= bound + 1e-9 * (1 + bound + ((hi - lo) ** 2).sum()))
        q, p = block - centre, places[near] - centre
        d, kth = _kth(q, p, m)
        # rounding is far below this; whatever is kept too much falls to the exact distances
        slack = 1e-9 * (1 + np.abs(kth) + (q**2).sum(axis=1))
        row, col = np.nonzero(d <= (kth + slack)[:, None])
        col = near[col]
        diff = block[row] - places[col]
        exact = np.sqrt(diff[:, 0] * diff[:, 0] + diff[:, 1] * diff[:, 1] + diff[:, 2] * diff[:, 2])
        n = counts[col]
        if n.max(initial=1) > 1:
            row, exact = np.repeat(row, n), np.repeat(exact, n)
            own = ids[np.repeat(first[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        else:
            own = ids[first[col]]
        found[0].append(rows[row])
        found[1].append(exact)
        found[2].append(own)
    row, exact, own = (np.concatenate(x) for x in found)
    order = np.lexsort((own, exact, row))
    row, exact, own = row[order], exact[order], own[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(queries)))[row] < k
    return np.append([0], np.cumsum(np.bincount(row[keep], minlength=len(queries)))), exact[keep], own[keep]


# ---- the distributed steps ----


def _xyz(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["x", "y", "z"]].to_numpy(np.float64)


def _train(part: int, max_parts: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "z"])
        parts = min(max_parts, int(np.ceil(pdf["n"].iloc[0] / part)))
        return pd.DataFrame([{"scene": pdf["scene"].iloc[0], **train(_xyz(pdf), parts)}])

    return fit


def _assign(cover: float, most: int):
    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*PLACE, "ids", "asked", "part", "routes"]})
        left = left.reset_index(drop=True)
        routes = route(_xyz(left), right.iloc[0], cover, most)
        out = left[[*PLACE, "ids", "asked"]].copy()
        # a scene too large for its parts: each part is several slices of even size, and a query asks them all
        slices = int(right["slices"].iloc[0])
        out["part"] = routes[:, 0] * slices + left["slice"].to_numpy() % slices
        every = np.arange(slices)
        out["routes"] = [(r[r >= 0, None] * slices + every).ravel() if a else np.zeros(0, np.int64) for r, a in zip(routes, left["asked"])]
        return out

    return assign


_FOUND = pa.schema([("scene", pa.string()), *[(c, pa.float64()) for c in "xyz"], ("d", pa.list_(pa.float64())), ("near", pa.list_(pa.int64()))])


def _rerank(k: int):
    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        xyz = lambda t: np.stack([t[c].to_numpy() for c in "xyz"], axis=1)
        ids = right["ids"].combine_chunks()
        ids = ids if isinstance(ids, pa.ListArray) else ids.chunk(0)
        first = ids.offsets.to_numpy().astype(np.int64)
        offsets, d, near = nearest(xyz(left), xyz(right), first - first[0], ids.flatten().to_numpy(), k)
        at = pa.array(offsets.astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(d)), pa.ListArray.from_arrays(at, pa.array(near.astype(np.int64)))]
        return pa.table([*[left[c] for c in PLACE], *lists], schema=_FOUND)

    return rerank


def _missed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Parts not asked whose box is nearer than the farthest neighbour found."""
    if not len(left):
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*PLACE, "part"]})
    left = left.reset_index(drop=True)
    lo, hi = right[["x0", "y0", "z0"]].to_numpy(float), right[["x1", "y1", "z1"]].to_numpy(float)
    part = right["part"].to_numpy(np.int64)
    xyz, r = _xyz(left), left["r"].to_numpy(float)
    rows, cols = [], []
    step = max(1, 2_000_000 // len(part))
    for at in range(0, len(xyz), step):
        q = xyz[at : at + step]
        gap = np.zeros((len(q), len(part)))
        for c in range(3):
            g = np.maximum(np.maximum(lo[:, c] - q[:, c, None], q[:, c, None] - hi[:, c]), 0)
            gap += g * g
        reach = r[at : at + step, None] * (1 + 1e-9) + 1e-12
        i, j = np.nonzero(gap <= reach * reach)
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), part[np.concatenate(cols)]
    asked = [set(x) for x in left["routes"]]
    new = np.fromiter((b not in asked[a] for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
    out = left.loc[i[new], PLACE].reset_index(drop=True)
    out["part"] = j[new]
    return out


def neighbours(points: DataFrame, k: int = K, asked: DataFrame | None = None, part: int = PART, cover: float = COVER, most: int = MAX_ROUTES, salted: int = SALT, max_parts: int = MAX_PARTS) -> DataFrame:
    """``row_id, near, distance``: for every point its k nearest of the same scene, nearest first.

    ``asked`` (``row_id``) limits the queries to some points; the index always holds all. ``part`` is the size of a part,
    ``salted`` the most places of a scene in a task, ``cover`` and ``most`` bound the parts the classifier chooses.
    """
    spark = points.sparkSession
    scratch = Scratch(spark, "neighbours")
    fine = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz")
    pts = points.where("row_id is not null and scene is not null").where(fine)
    pts = pts.select("row_id", "scene", *[F.col(c).cast("double").alias(c) for c in "xyz"]).distinct()
    queries = pts if asked is None else pts.join(asked.select("row_id").where("row_id is not null").distinct(), "row_id", "left_semi")
    queries = scratch.write(queries)
    # per place the k + 1 smallest ids; WindowGroupLimit keeps no more of a place in any task before the shuffle
    rank = F.row_number().over(Window.partitionBy(*PLACE).orderBy("row_id"))
    places = (pts if asked is not None else queries).withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy(*PLACE).agg(F.array_sort(F.collect_list("row_id")).alias("ids"))
    if asked is None:
        places = places.withColumn("asked", F.lit(True))
    else:
        marked = queries.select(*PLACE).distinct().withColumn("mark", F.lit(True))
        places = places.join(marked, PLACE, "left").select(*PLACE, "ids", F.coalesce("mark", F.lit(False)).alias("asked"))
    places = scratch.write(places)
    sizes = scratch.write(places.groupBy("scene").agg(F.count(F.lit(1)).alias("n")))
    total = places.count()
    sized = join_unique(places, sizes, "scene", "n", max(total, 1))
    salt = F.pmod(F.xxhash64("x", "y", "z"), F.ceil(F.col("n") / salted)).cast("int").alias("salt")
    unit = F.xxhash64("z", "y", "x").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    wanted = F.least(F.ceil(F.col("n") / part), F.lit(max_parts)) * PER_PART
    sample = sized.where(unit * F.col("n") < wanted * 1.1 + 64).select(*PLACE, "n")
    models = scratch.write(sample.groupBy("scene").applyInPandas(_train(part, max_parts), "scene string, mean array<double>, scale array<double>, w array<double>, parts int"))
    salts = sizes.select(F.col("scene").alias("of"), "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / salted).cast("int") - 1)).alias("s"))
    slices = F.ceil(F.col("n") / (F.col("parts") * part * SLACK)).cast("int")
    spread = models.join(salts, F.col("scene") == F.col("of")).select("of", "s", "mean", "scale", "w", "parts", slices.alias("slices"))
    slice_ = F.xxhash64("y", "z", "x").bitwiseAND(F.lit((1 << 31) - 1)).alias("slice")
    index = sized.select(*PLACE, "ids", "asked", slice_, salt).groupBy("scene", "salt").cogroup(spread.groupBy("of", "s")).applyInPandas(
        _assign(cover, most), "scene string, x double, y double, z double, ids array<long>, asked boolean, part int, routes array<int>")
    index = scratch.write(index)
    held = index.select(F.col("scene").alias("in_scene"), F.col("part").alias("in_part"), "x", "y", "z", "ids")
    shape = "scene string, x double, y double, z double, d array<double>, near array<long>"

    def ask(routes: DataFrame) -> DataFrame:
        return routes.groupBy("scene", "part").cogroup(held.groupBy("in_scene", "in_part")).applyInArrow(_rerank(k + 1), shape)

    def best(found: DataFrame) -> DataFrame:
        pairs = F.flatten(F.collect_list(F.arrays_zip("d", "near")))
        return found.groupBy(*PLACE).agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("top"))

    first = scratch.write(best(ask(index.where("asked").select(*PLACE, F.explode("routes").alias("part")))))
    boxes = index.groupBy("scene", "part").agg(*[F.min(c).alias(f"{c}0") for c in "xyz"], *[F.max(c).alias(f"{c}1") for c in "xyz"])
    boxes = boxes.join(salts, F.col("scene") == F.col("of")).select("of", "s", "part", *[f"{c}{i}" for c in "xyz" for i in (0, 1)])
    r = F.when(F.size("top") > k, F.element_at("top", k + 1)["d"]).otherwise(F.lit(1e300))
    known = first.join(index.where("asked").select(*PLACE, "routes"), PLACE).select(*PLACE, "routes", r.alias("r"))
    known = join_unique(known, sizes, "scene", "n", max(total, 1)).select(*PLACE, "routes", "r", salt)
    more = known.groupBy("scene", "salt").cogroup(boxes.groupBy("of", "s")).applyInPandas(_missed, "scene string, x double, y double, z double, part int")
    late = ask(scratch.write(more))
    found = first.select(*PLACE, F.col("top.d").alias("d"), F.col("top.near").alias("near")).unionByName(late)
    answers = scratch.write(best(found))
    crowd = queries.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
    keyed = answers.join(crowd, PLACE).select(F.struct(*PLACE).alias("place"), "top", "n")
    out = join_unique(queries.select("row_id", F.struct(*PLACE).alias("place")), keyed, "place", "n", max(total, 1))
    top = F.slice(F.filter("top", lambda t: t["near"] != F.col("row_id")), 1, k)
    return out.select("row_id", top.alias("top")).select("row_id", F.col("top.near").alias("near"), F.col("top.d").alias("distance"))


def pairs(found: DataFrame) -> DataFrame:
    """``row_id_a < row_id_b``: the pairs of which one is among the other's neighbours, once each."""
    each = found.select("row_id", F.explode("near").alias("other"))
    return each.select(F.least("row_id", "other").alias("row_id_a"), F.greatest("row_id", "other").alias("row_id_b")).distinct()
