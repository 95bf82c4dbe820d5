"""Scalar column functions. All are built-in expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_round(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, half to even, as IEEE languages do it (up to 2 digits).

    ``round`` in SQL rounds the shortest decimal text of a double, so 0.745 becomes 0.75 though the double is below the
    tie. Below 1000 a double is a whole number of 2^-53, below 1 (and not below the first tie) of 2^-62, so the comparison
    is done in whole numbers; from 1000 on ``bround`` is used.
    """
    size = F.abs(x)
    one = F.when(size < 1, F.lit(2**62).cast("decimal(19,0)")).otherwise(F.lit(2**53).cast("decimal(19,0)"))
    units = F.when(size < 1, size * F.lit(2.0**62)).otherwise(size * F.lit(2.0**53))
    q = units.cast("bigint").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(5,0)")
    rest = q % one
    whole = ((q - rest) / one).cast("double")
    up = (rest * 2 > one) | ((rest * 2 == one) & (F.pmod(whole, F.lit(2.0)) == 1))
    small = F.signum(x) * (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(10.0**digits)
    return F.when(x.isNull() | F.isnan(x), x).when(size < 1000, small).otherwise(F.bround(x, digits))


def trunc(x: Column) -> Column:
    """Towards zero, as a cast to int does; stated so that no dialect rounds."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def floor_div(x: Column, n: int) -> Column:
    """Floor division, also below zero."""
    return F.floor(x / F.lit(float(n)))


def hue(a: Column, b: Column) -> Column:
    """Angle of (a, b) in degrees, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def in_hue_range(h: Column, low: float, high: float) -> Column:
    """Whether a hue lies in a range that may pass through 0."""
    return F.pmod(h - low, F.lit(360.0)) <= (high - low) % 360.0


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio of images in 0 to 1; null without error."""
    return F.when(mse > 0, -10 * F.log10(mse))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def share_off(share: Column, target: Column, n: Column, least: float = 0.04) -> Column:
    """Whether a share strays from its target by more than chance: max(least, 3 sigma)."""
    return F.abs(share - target) > F.greatest(F.lit(least), 3 * F.sqrt(target * (1 - target) / n))


def elevation_bucket(y: Column, height: Column, buckets: int = 3) -> Column:
    return F.least(F.floor(buckets * y / height), F.lit(buckets - 1))


def spacing(segment: Column, frames: Column, oversample: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(segment / (frames * oversample)))


def unit(*keys: Column | str, seed: int = 0) -> Column:
    """Uniform number in [0, 1) from a hash of the keys' texts: the same in any partition layout and any SQL dialect."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def signature(v: Column) -> Column:
    """A vector less its mean over its (population) deviation."""
    n = F.size(v).cast("double")
    x = F.transform(v, lambda a: a.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, a: s + a) / n
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + (a - mean) * (a - mean)) / n)
    return F.transform(x, lambda a: (a - mean) / (spread + 1e-9))
