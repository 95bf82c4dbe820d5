import datetime as dt
from collections import Counter

from reelgrain.plans import catalogue


def test_all_outlines_are_rounded_like_python(spark, tmp_path):
    ties = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]
    xs = ties + [x + e for x in ties for e in (-1e-4, 1e-4, -1e-16, 1e-16)] + [0.0, 0.31, 1.0, None]
    rows = [("a", i, dt.datetime(2024, 1, 1), [(x,)]) for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "clip string, frame long, written_at timestamp_ntz, robots array<struct<on_change:double>>").write.parquet(f"{tmp_path}/manifest.parquet")
    got = catalogue.queries()["even_rounding"](spark, str(tmp_path)).collect()
    assert dict(map(tuple, got)) == Counter(round(x, 1) for x in xs if x is not None)
