"""Keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reason_key(reason: Column) -> Column:
    """What a reason is counted under: its text before the first colon."""
    return F.split_part(reason, F.lit(":"), F.lit(1))


def source_key(source: Column) -> Column:
    """Cut-outs count under robot and paint, whole synthetic sources under themselves, others under their first three parts."""
    parts = F.split(source, ":")
    kind = F.get(parts, F.lit(0))
    return (
        F.when(kind == "cutout", F.array_join(F.slice(parts, 2, 2), ":"))
        .when(kind.isin("mesh", "new"), source)
        .otherwise(F.array_join(F.slice(parts, 1, 3), ":"))
    )


def source_of(kind: Column, robot: Column, paint: Column, clip: Column, frame: Column) -> Column:
    return F.concat_ws(":", F.coalesce(kind, F.lit("cutout")), robot, paint, clip, frame.cast("string"))


def padded(n: Column, digits: int) -> Column:
    return F.lpad(n.cast("string"), digits, "0")


def rate(text: Column) -> Column:
    """A frame rate written as num/den."""
    p = F.split(text, "/")
    return F.try_divide(F.get(p, F.lit(0)).cast("double"), F.coalesce(F.get(p, F.lit(1)), F.lit("1")).cast("double"))
