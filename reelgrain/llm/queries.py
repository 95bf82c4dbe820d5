"""The pN_ queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.llm import calibrate, leakage, mixture, neighbours, oracles, packing, runs, sentences, splits
from reelgrain.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated_runs(table(spark, d, "manifest")).select("clip", "first_frame", "last_frame")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated_runs(table(spark, d, "manifest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    report = calibrate.sample(table(spark, d, "composed"), table(spark, d, "targets"))[1]
    return report.where("gap > 0").select("run", "robot")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    report = calibrate.sample(table(spark, d, "composed"), table(spark, d, "targets"))[1]
    return report.select("run", "robot", "share_pct", "entries", "size", "needed", "gap")


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.sample(table(spark, d, "composed"), table(spark, d, "targets"))[1].select("run", "robot", "expected", "drawn")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.sample(table(spark, d, "composed"), table(spark, d, "targets"))[0]


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.sample(table(spark, d, "composed"), table(spark, d, "targets"))[2]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.members(table(spark, d, "manifest"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mixture.clusters(table(spark, d, "manifest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_images(table(spark, d, "composed")).select("first_image_id", "image_id")


def p4_images(spark: SparkSession, d: str) -> DataFrame:
    return splits.image_splits(table(spark, d, "composed"), table(spark, d, "splits"))


def p4_frames(spark: SparkSession, d: str) -> DataFrame:
    return splits.frame_splits(table(spark, d, "composed"), table(spark, d, "manifest"), table(spark, d, "splits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.neighbours(table(spark, d, "splat_points"), asked=table(spark, d, "knn_probes")))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Of every point its neighbours, nearest first, as one text, and how far the last is."""
    found = neighbours.neighbours(table(spark, d, "splat_points"))
    return found.select("row_id", F.array_join(F.transform("near", lambda n: n.cast("string")), ",").alias("near"), F.array_max("distance").alias("farthest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(table(spark, d, "documents"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "eval_items"), table(spark, d, "documents")).select("item_id", "doc_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "eval_items"), table(spark, d, "documents"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.clean(table(spark, d, "eval_items"), table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    named = [p1_found, p1_runs, p2_found, p2_report, p2_sizes, p2_sample, p2_kinds, p3_found, p3_clusters, p4_found, p4_images, p4_frames, p5_found, p5_neighbours, p6_found, p6_containers, p7_found, p7_matches, p7_clean, p8_found]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": oracles.P1_FOUND, "p1_runs": oracles.P1_RUNS, "p2_found": oracles.P2_FOUND, "p3_found": oracles.P3_FOUND, "p4_found": oracles.P4_FOUND, "p5_found": oracles.P5_FOUND, "p6_found": oracles.P6_FOUND, "p2_report": oracles.P2_REPORT, "p5_neighbours": oracles.P5_NEIGHBOURS, "p7_found": oracles.P7_FOUND, "p7_clean": oracles.P7_CLEAN, "p4_images": oracles.P4_IMAGES, "p4_frames": oracles.P4_FRAMES}
