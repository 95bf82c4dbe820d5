"""Readers of manifests, label files, meshes, listings and reconstruction files. Missing inputs give empty tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.sources import schemas


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths (globs allowed) that match something."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found):
            out.append(p)
    return out


def json_documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Whole-document JSON with an explicit schema; paths that don't exist are left out."""
    there = existing(spark, paths)
    return spark.read.schema(schema).json(there, multiLine=True) if there else spark.createDataFrame([], schema)


def outline_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per kept frame of outline documents."""
    docs = json_documents(spark, paths, schemas.OUTLINES)
    return docs.select("clip", F.explode("items").alias("i")).select("clip", "i.*")


def composed_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of partial manifests, one row per image."""
    docs = json_documents(spark, paths, schemas.COMPOSED)
    return docs.select("run", "seed", F.explode("items").alias("i")).select("run", "seed", "i.*")


def pair_poses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Outlines of followed pairs with their names: tracks, frames and robots unrolled by position."""
    docs = json_documents(spark, paths, schemas.TRACKS)
    t = docs.select("clip", F.posexplode("tracks").alias("track", "t")).select("clip", "track", "t.names", F.explode("t.frames").alias("f"))
    r = t.select("clip", "track", "names", "f.frame", F.posexplode("f.robots").alias("k", "r"))
    return r.select("clip", "track", "frame", "k", "r.bbox", F.get("names", "k").alias("robot"))


def sprite_pool(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of sprite indexes with the path of each file; ``kind`` defaults to cutout."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], f"{schemas.SPRITES}, path string")
    rows = spark.read.schema(schemas.SPRITES).json(there, multiLine=True)
    folder = F.regexp_replace(F.input_file_name(), "[^/]*$", "")
    return rows.withColumn("path", F.concat(folder, "file")).withColumn("kind", F.coalesce("kind", F.lit("cutout")))


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """``image, cls, cx, cy, w, h`` of label text files; the image is the file's stem. Malformed rows have nulls."""
    there = existing(spark, [path])
    if not there:
        return spark.createDataFrame([], "image string, cls int, cx double, cy double, w double, h double")
    p = F.split(F.trim("value"), r"\s+")
    image = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    num = lambda i: F.get(p, F.lit(i)).try_cast("double")
    rows = spark.read.text(there).where(F.trim("value") != "")
    return rows.select(image.alias("image"), num(0).cast("int").alias("cls"), *[num(i + 1).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vertices, corners)`` of a Wavefront file: ``kind, i, x, y, z`` (kinds v, vt, vn) and ``face, triangle, corner,
    v, vt, vn`` with 0-based numbers; polygons become fans of triangles.

    Line order matters, so each file is one record; numbers below zero count from the end of what was read.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen, face = [], {"v": 0, "vt": 0, "vn": 0}, 0
            for text in pdf["content"]:
                for line in bytes(text).decode("utf-8", "replace").splitlines():
                    p = line.split()
                    if p and p[0] in seen:
                        xyz = [float(v) for v in p[1:4]] + [None] * (4 - len(p))
                        rows.append((p[0], seen[p[0]], *xyz, None, None, None, None, None))
                        seen[p[0]] += 1
                    elif p and p[0] == "f":
                        refs = []
                        for ref in p[1:]:
                            own = (ref.split("/") + ["", ""])[:3]
                            refs.append([None if not s else int(s) - 1 if int(s) > 0 else seen[k] + int(s) for s, k in zip(own, seen)])
                        for t in range(1, len(refs) - 1):
                            for c, r in enumerate((refs[0], refs[t], refs[t + 1])):
                                rows.append(("f", face, None, None, None, t - 1, c, *r))
                        face += 1
            yield pd.DataFrame(rows, columns=["kind", "i", "x", "y", "z", "triangle", "corner", "v", "vt", "vn"]).astype({c: "Int64" for c in ("triangle", "corner", "v", "vt", "vn")})

    raw = spark.read.format("binaryFile").load(path).select("content")
    rows = raw.mapInPandas(parse, "kind string, i long, x double, y double, z double, triangle long, corner long, v long, vt long, vn long")
    return rows.where("kind <> 'f'").select("kind", "i", "x", "y", "z"), rows.where("kind = 'f'").select(F.col("i").alias("face"), "triangle", "corner", "v", "vt", "vn")


def face_depths(vertices: DataFrame, corners: DataFrame) -> DataFrame:
    """``face, triangle, depth``: mean z of each triangle, the order in which a painter draws them."""
    v = vertices.where("kind = 'v'").select(F.col("i").alias("v"), "x", "y", "z")
    return corners.join(v, "v").groupBy("face", "triangle").agg(F.avg("z").alias("depth"))


_PLY = {"float": "<f4", "float32": "<f4", "double": "<f8", "uchar": "u1", "uint8": "u1", "int": "<i4", "uint": "<u4", "short": "<i2", "ushort": "<u2", "char": "i1"}


def ply_header(data: bytes) -> tuple[int, np.dtype, int]:
    """``(vertices, record type, header length)`` of a binary little-endian file; raises if it is anything else."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no header")
    n, fields, on = 0, [], False
    for line in data[:end].decode("ascii").splitlines():
        p = line.split()
        if p[:1] == ["format"] and p[1] != "binary_little_endian":
            raise ValueError(f"format {p[1]}")
        if p[:1] == ["element"]:
            on = p[1] == "vertex"
            n = int(p[2]) if on else n
        elif p[:1] == ["property"] and on:
            fields.append((p[2], _PLY[p[1]]))
    return n, np.dtype(fields), end + len(b"end_header\n")


def ply_points(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``row_id`` (position in the file) and float columns; the size is checked against the header."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                data = bytes(data)
                n, kind, start = ply_header(data)
                if len(data) != start + n * kind.itemsize:
                    raise ValueError(f"{len(data)} bytes, {start + n * kind.itemsize} expected")
                a = np.frombuffer(data, kind, n, start)
                for at in range(0, n, 100_000):
                    part = a[at : at + 100_000]
                    yield pd.DataFrame({"row_id": np.arange(at, at + len(part)), **{c: part[c].astype(np.float32) for c in columns}})

    shape = "row_id long, " + ", ".join(f"{c} float" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, shape)


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths a glob matches; only names are read, as for any scan the driver lists the files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found] if found is not None else []


def submodels(spark: SparkSession, folder: str) -> DataFrame:
    """``name, position`` of the sub-folders that hold images.bin, numeric names first in number order, others as 99."""
    names = [(p.split("/")[-2],) for p in _names(spark, f"{folder}/*/images.bin")]
    at = F.coalesce(F.expr("try_cast(name as bigint)"), F.lit(99)).cast("bigint")
    return spark.createDataFrame(names, "name string").select("name", at.alias("position")).orderBy("position", "name")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` of the pictures in a folder, in order."""
    files = spark.createDataFrame([(p.split("/")[-1],) for p in _names(spark, f"{folder}/*")], "name string")
    return files.where(F.lower("name").rlike(r"\.(jpg|jpeg|png)$")).orderBy("name")


def registered_images(spark: SparkSession, path: str) -> DataFrame:
    """``name, qvec, tvec, point3d_ids`` of a binary reconstruction (images.bin)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                data, at = bytes(data), 8
                for _ in range(struct.unpack_from("<Q", data)[0]):
                    v = struct.unpack_from("<i7di", data, at)
                    at += struct.calcsize("<i7di")
                    end = data.index(b"\0", at)
                    name, at = data[at:end].decode(), end + 1
                    n = struct.unpack_from("<Q", data, at)[0]
                    obs = np.frombuffer(data, np.dtype([("xy", "<f8", 2), ("id", "<i8")]), n, at + 8)
                    at += 8 + n * 24
                    rows.append((name, list(v[1:5]), list(v[5:8]), obs["id"].tolist()))
            yield pd.DataFrame(rows, columns=["name", "qvec", "tvec", "point3d_ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "name string, qvec array<double>, tvec array<double>, point3d_ids array<long>")


def scene_points(spark: SparkSession, path: str) -> DataFrame:
    """``id, x, y, z, error, image_ids`` of a binary reconstruction (points3D.bin)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                data, at = bytes(data), 8
                for _ in range(struct.unpack_from("<Q", data)[0]):
                    v = struct.unpack_from("<Q3d3BdQ", data, at)
                    at += struct.calcsize("<Q3d3BdQ")
                    track = np.frombuffer(data, "<i4", 2 * v[8], at)
                    at += 8 * v[8]
                    rows.append((v[0], *v[1:4], v[7], track[::2].tolist()))
            yield pd.DataFrame(rows, columns=["id", "x", "y", "z", "error", "image_ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "id long, x double, y double, z double, error double, image_ids array<int>")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``tag, step, value`` of the scalars in event files (length-framed records of protocol buffers)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                data, at = bytes(data), 0
                while at + 12 <= len(data):
                    size = struct.unpack_from("<Q", data, at)[0]
                    record, at = data[at + 12 : at + 12 + size], at + 16 + size
                    step, summaries = 0, []
                    for f, v in _fields(record):
                        if f == 2:
                            step = v
                        elif f == 5:
                            summaries.append(v)
                    for s in summaries:
                        for f, v in _fields(s):
                            own = dict(_fields(v)) if f == 1 else {}
                            if 1 in own and 2 in own:
                                rows.append((own[1].decode(), step, struct.unpack("<f", own[2])[0]))
            yield pd.DataFrame(rows, columns=["tag", "step", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "tag string, step long, value double")


def frame_list_gaps(listed: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """``listed, missing``: how many names a list has and how many of them aren't there."""
    mark = present.select(name).distinct().withColumn("_on", F.lit(True))
    return listed.join(mark, name, "left").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("_on").isNull()).alias("missing"))


def homography(spark: SparkSession, path: str) -> list[list[float]]:
    """The 3 x 3 matrix of a document of nested lists."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<double>>").alias("h")).first()["h"]
    if text is None or len(text) != 3 or any(row is None or len(row) != 3 for row in text):
        raise ValueError("not three rows of three numbers")
    return [list(row) for row in text]


def train_share(text: Column) -> Column:
    """The ``train_split_fraction`` of a run's settings; null where they name none."""
    return F.nullif(F.regexp_extract(text, r"train_split_fraction: ([0-9.]+)", 1), F.lit("")).try_cast("double")


def file_names(*lists: DataFrame) -> DataFrame:
    """Names of several file lists, each once; null names are left out."""
    out = None
    for names in lists:
        one = names.select(F.col(names.columns[0]).alias("name")).where("name is not null")
        out = one if out is None else out.unionByName(one)
    return out.distinct()
