"""Structured Streaming: tracking with state per clip, and windows, sessions and duplicates with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from reelgrain.operators.tracking import OUT, advance, new_track, rows_of, seeds_from

WARM_UP = 100


_NUMBERS = ("x", "y", "vx", "vy", "p", "c", "q", "level", "area")
HELD = "ts double, frame bigint, seen bigint, late bigint, tracks array<struct<label:string,stale:int,source:string," + ",".join(f"{c}:double" for c in _NUMBERS) + ">>"


def track_stream(frames: DataFrame, warm_up: int = 0, first_dt: float = 1 / 98, least_dt: float = 1e-3) -> DataFrame:
    """Tracks of a stream of frames (``clip, frame, ts, blobs``), one row per frame and label, in append mode.

    The state of a clip is typed (``HELD``): two tracks, the last time, and how many frames were seen and came too late; it
    never expires, as tracks are neither made nor dropped. The first ``warm_up`` frames of a clip give nothing. Frames of a
    micro-batch are taken in order, batch by batch of Arrow; a frame not after the last one taken is too late: it changes no
    track and is counted in ``late`` of the rows that follow.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, frame, seen, late, held = state.get if state.exists else (None, None, 0, 0, None)
        tracks = [{**new_track(r["label"], 0, 0), **{c: r[c] for c in ("stale", "source", *_NUMBERS)}} for r in map(_as_dict, held)] if held else None
        out = []
        for row in pd.concat(list(batches)).sort_values("frame").to_dict("records"):
            if frame is not None and row["frame"] <= frame:
                late += 1
                continue
            frame, seen = int(row["frame"]), seen + 1
            if seen <= warm_up:
                continue
            found = [_as_dict(b) for b in row["blobs"]]
            if tracks is None:
                if len(found) < 2:
                    continue
                tracks = seeds_from(found)
            dt = first_dt if ts is None else max(row["ts"] - ts, least_dt)
            ts = float(row["ts"])
            advance(tracks, found, dt)
            out += [{**r, "late": late} for r in rows_of(key[0], frame, tracks)]
        kept = None if tracks is None else [(t["label"], int(t["stale"]), t["source"], *(None if t[c] is None else float(t[c]) for c in _NUMBERS)) for t in tracks]
        state.update((ts, frame, seen, late, kept))
        if out:
            yield pd.DataFrame(out)

    return frames.groupBy("clip").applyInPandasWithState(update, f"{OUT}, late bigint", HELD, "append", "NoTimeout")


def _as_dict(row) -> dict:
    return dict(row) if isinstance(row, dict) else row.asDict()


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """``start, keys, n`` per tumbling or sliding window, events later than the watermark left out."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    w = F.window(ts, width, slide or width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, ts: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """``first, end, keys, n`` per session of events less than ``gap`` apart."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("s.start").alias("first"), F.col("s.end").alias("end"), *keys, "n")


def once(events: DataFrame, id_: str, ts: str, late: str) -> DataFrame:
    """Events by id once, duplicates within the watermark dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_]) if events.isStreaming else rows.dropDuplicates([id_])


def run_all(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table below ``folder`` (checkpointed, exactly once) and read it."""
    spark, path = stream.sparkSession, f"{folder}/{name}"
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def pace(query) -> dict:
    """Rows a second of a stream's last micro-batches, to set against the 98 frames a second of the source."""
    each = [p for p in query.recentProgress if p["numInputRows"]]
    rows, ms = sum(p["numInputRows"] for p in each), sum(p["durationMs"]["triggerExecution"] for p in each)
    return {"batches": len(each), "rows": rows, "rows_per_second": 1000 * rows / ms if ms else None}


def run_complete(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run an aggregated stream over all there is; the whole result of its last micro-batch is the table read back. Tasks
    write it, so it never gathers in the driver."""
    spark, path = stream.sparkSession, f"{folder}/{name}"
    save = lambda df, batch: df.write.mode("overwrite").parquet(path)
    stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
