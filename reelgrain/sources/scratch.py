"""Intermediate tables in the shared folder the session names, so that a lost executor loses no work.

The folder is read from ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests, a single machine)
a temporary folder of this process is used; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """Results read these tables until the program ends; then they go, if the session still runs."""
    for spark, root in _roots:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # noqa: BLE001 - a session that is gone can't delete; the folder's owner does
            return


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share; a local one of this process if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="reelgrain-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


class Scratch:
    """Written tables of one operator call; ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _roots.append((spark, self.root))

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written as parquet and read again: its lineage ends here."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def path_of(self, df: DataFrame) -> str:
        """Folder of a table returned by ``write``."""
        return df._scratch_path

    def drop(self, df: DataFrame | None) -> None:
        """Delete the files behind a table returned by ``write``. Unknown tables are left alone."""
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            _delete(self.spark, path)
