"""Draws and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.constants import MIN_FLOOR, Z95


def draw(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) that the parts alone decide."""
    key = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def share(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def wilson(num: Column, den: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval, within 0 and 1; null without observations, an error with more successes than those."""
    num = F.when(num > den, F.raise_error(F.format_string("%s successes of %s", num, den)).cast("long")).otherwise(num)
    n, p = F.nullif(den.cast("double"), F.lit(0.0)), share(num, den)
    z2 = Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), middle - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), middle + half))


def floor_of(sigma: Column) -> Column:
    """The change that runs of one configuration show by chance: two deviations, and a least value."""
    return F.greatest(2 * F.coalesce(sigma, F.lit(0.0)), F.lit(MIN_FLOOR))
