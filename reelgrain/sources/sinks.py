"""Writers. Data go out from the executors; small documents (settings, reports) from the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.operators.aggregates import wide


def _system(path: str) -> tuple[FileSystem, str]:
    """File system and path of an address (hdfs://, s3://, file://, ...) or a plain path, its folder made."""
    fs, root = FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    fs.create_dir(root, recursive=True)
    return fs, root


def write_text(path: str, text: str) -> None:
    """A small document, written whole."""
    folder, name = os.path.split(path)
    fs, root = _system(folder or ".")
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(text.encode())


def tracking_csv(tracks: DataFrame, labels: list[str], path: str) -> DataFrame:
    """Wide CSV, one row per frame: per label pixels (2 decimals), metres (4 decimals, empty without calibration), source.

    ``tracks``: ``frame, time_s, label, px_x, px_y, x_m, y_m, source``. Returns what is written.
    """
    t = tracks.withColumns({"px_x": F.round("px_x", 2), "px_y": F.round("px_y", 2), "x_m": F.round("x_m", 4), "y_m": F.round("y_m", 4), "time_s": F.round("time_s", 4)})
    out = wide(t, ["frame", "time_s"], "label", labels, ["px_x", "px_y", "x_m", "y_m", "source"])
    out.repartitionByRange("frame").sortWithinPartitions("frame").write.mode("overwrite").csv(path, header=True)
    return out


def label_files(images: DataFrame, rows: DataFrame, folder: str) -> None:
    """One text file per image, empty for images without rows. ``rows``: ``image, k, line``. Tasks write their own files
    to a folder all executors share; a rewritten file is the same."""
    lines = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    every = images.select("image").distinct().join(lines, "image", "left").select("image", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))

    def write(part) -> None:
        fs, root = _system(folder)
        for r in part:
            with fs.open_output_stream(f"{root}/{os.path.splitext(r['image'])[0]}.txt") as f:
                f.write((f"{r['text']}\n" if r["text"] else "").encode())

    every.foreachPartition(write)


def data_yaml(folder: str, classes: dict[int, str]) -> str:
    text = "path: .\ntrain: images\nval: images\nnames:\n" + "".join(f"  {k}: {v}\n" for k, v in sorted(classes.items()))
    write_text(f"{folder}/data.yaml", text)
    return text


def documents(items: DataFrame, keys: list[str], order: list[str], path: str) -> None:
    """One nested JSON document per key, its items in order; keys go to tasks, not to the driver."""
    body = F.struct(*order, *[c for c in items.columns if c not in keys + order])
    docs = items.groupBy(*keys).agg(F.array_sort(F.collect_list(body)).alias("items"))
    docs.write.mode("overwrite").json(path)


def parts(items: DataFrame, start: str, each: int, path: str) -> None:
    """Manifest parts: rows by ranges of ``each`` of the column ``start``, one folder per part."""
    items.withColumn("part", (F.floor(F.col(start) / each) * each).cast("bigint")).repartition("part").write.mode("overwrite").partitionBy("part").json(path)


def report(row: DataFrame, path: str) -> dict:
    """A report of one row as a document."""
    text = row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]
    write_text(path, json.dumps(json.loads(text), indent=1))
    return json.loads(text)


def homography(h: list[list[float]], path: str) -> None:
    """A 3 x 3 matrix as nested lists; ``documents.homography`` reads it."""
    if len(h) != 3 or any(len(row) != 3 for row in h):
        raise ValueError("a homography has three rows of three")
    write_text(path, json.dumps([[float(v) for v in row] for row in h]))


def gate(checked: DataFrame, ok: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows split into ``kept`` and ``set_aside`` folders; the input stays as it is, so a second run changes nothing."""
    marked = checked.withColumn("gate", F.when(F.coalesce(ok, F.lit(False)), "kept").otherwise("set_aside"))
    marked.write.mode("overwrite").partitionBy("gate").parquet(path)
    spark = checked.sparkSession
    back = spark.read.schema(marked.schema).parquet(path)
    return back.where("gate = 'kept'").drop("gate"), back.where("gate = 'set_aside'").drop("gate")


def ply(points: DataFrame, columns: list[str], path: str, comment: str = "") -> int:
    """Binary little-endian file in ``row_id`` order; returns the number of points.

    Tasks encode their range of points as one block of bytes; a single file has a single writer, which appends the blocks
    one at a time.
    """
    n = points.count()
    ordered = points.select("row_id", *columns).repartitionByRange("row_id").sortWithinPartitions("row_id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"block": [pdf[columns].to_numpy("<f4").tobytes()]})

    folder, name = os.path.split(path)
    fs, root = _system(folder or ".")
    with fs.open_output_stream(f"{root}/{name}") as f:
        head = ["ply", "format binary_little_endian 1.0", *([f"comment {comment}"] if comment else []), f"element vertex {n}"]
        f.write("\n".join([*head, *[f"property float {c}" for c in columns], "end_header", ""]).encode())
        for row in ordered.mapInPandas(encode, "block binary").toLocalIterator(prefetchPartitions=True):
            f.write(bytes(row["block"]))
    return n


def renumbered(chosen: DataFrame, order: list[str], digits: int = 5) -> DataFrame:
    """Chosen frames with names frame_00001 ... in order."""
    from reelgrain.operators.ranks import numbered

    rows = numbered(chosen.withColumn("_one", F.lit(1)), ["_one"], order, F.floor(F.col(order[0]) / 10_000), "number")
    return rows.drop("_one").withColumn("name", F.format_string(f"frame_%0{digits}d.png", "number"))
