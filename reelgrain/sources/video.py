"""Uncompressed video (YUV4MPEG2) as a Spark data source, batch and streaming: one row per frame.

    spark.dataSource.register(RawVideo)
    spark.read.format("rawvideo").option("path", p).option("start", 100).option("every", 30).load()

Only the brightness plane is read. ``start``, ``stop`` and ``every`` are pushed into the reader: frames that aren't
wanted are skipped by seeking, and the range is split over tasks. Compressed video needs a decoder, which is not part of
this package; its frames come as tables of ``clip, frame, ts, gray``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "frame bigint, ts double, width int, height int, gray binary"


def probe(path: str) -> dict:
    """``width, height, num, den, offset, stride, gray, frames`` of a file."""
    import os

    with open(path, "rb") as f:
        head = f.readline()
        marker = f.readline()
    if not head.startswith(b"YUV4MPEG2") or (marker and not marker.startswith(b"FRAME")):
        raise OSError(f"{path} is no raw video")
    p = {x[:1]: x[1:] for x in head.decode("ascii").split()[1:]}
    w, h = int(p["W"]), int(p["H"])
    num, den = (int(v) for v in p.get("F", "25:1").split(":"))
    kind = p.get("C", "420")
    rest = {"mono": 0, "420": 2 * ((w + 1) // 2) * ((h + 1) // 2), "422": 2 * ((w + 1) // 2) * h, "444": 2 * w * h}
    extra = next(v for k, v in rest.items() if kind.startswith(k))
    stride = len(marker) + w * h + extra
    frames = (os.path.getsize(path) - len(head)) // stride if marker else 0
    return {"width": w, "height": h, "num": num, "den": den, "offset": len(head), "stride": stride, "marker": len(marker), "frames": frames}


def write_video(path: str, frames: list[np.ndarray], rate: tuple[int, int] = (98, 1)) -> None:
    """Grey frames as a raw video."""
    h, w = frames[0].shape
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F{rate[0]}:{rate[1]} Cmono\n".encode())
        for x in frames:
            f.write(b"FRAME\n" + np.ascontiguousarray(x, np.uint8).tobytes())


def _read(path: str, numbers: range) -> Iterator[tuple]:
    v = probe(path)
    with open(path, "rb") as f:
        for n in numbers:
            f.seek(v["offset"] + n * v["stride"] + v["marker"])
            data = f.read(v["width"] * v["height"])
            if len(data) < v["width"] * v["height"]:  # a short read ends the video
                return
            yield n, n * v["den"] / v["num"], v["width"], v["height"], data


class _Part(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.every, self.each = options["path"], int(options.get("every", 1)), int(options.get("framesPerTask", 500))
        v = probe(self.path)
        self.start = int(options.get("start", 0))
        self.stop = min(int(options.get("stop", v["frames"])), v["frames"])

    def partitions(self) -> list[_Part]:
        step = max(1, self.each // self.every) * self.every
        return [_Part(a, min(a + step, self.stop)) for a in range(self.start, self.stop, step)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _read(self.path, range(partition.start, partition.stop, self.every))


class _Stream(DataSourceStreamReader):
    """Frames by number as offsets; the tasks read them, so a lost one is read again."""

    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("framesPerTask", 100))

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        return {"frame": probe(self.path)["frames"]}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(a, min(a + self.each, end["frame"])) for a in range(start["frame"], end["frame"], self.each)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _read(self.path, range(partition.start, partition.stop))


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def frame_at(frames: DataFrame, n: int) -> DataFrame:
    """Frame ``n``, or the last there is if the clip is shorter; no row of an empty clip."""
    return frames.where(F.col("frame") <= n).orderBy(F.desc("frame")).limit(1)


def throughput(frames: DataFrame, most: int = 500) -> DataFrame:
    """``frames, last_ts`` of the first ``most`` frames; the time it takes is measured by the caller."""
    return frames.orderBy("frame").limit(most).agg(F.count(F.lit(1)).alias("frames"), F.max("ts").alias("last_ts"))
