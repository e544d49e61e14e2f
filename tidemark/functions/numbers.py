"""Rounding."""

from pyspark.sql import functions as F

# Below this a double times 10,000 is off by less than a hundredth.
_LARGEST = 1e9


def round4(x):
    """``F.round(x, 4)`` of a double column, to the bit, at a fraction of its time.

    ``F.round`` goes through the decimal text of the double. That is left to
    values within a hundredth of a step of the middle between two results, and to
    large ones; for all others the nearest integer of ten thousandths is the same
    one, and its division by 10,000 is rounded correctly either way.
    """
    steps = x * F.lit(1e4)
    apart = F.abs(steps - F.floor(steps) - F.lit(0.5))
    plain = (F.abs(x) < F.lit(_LARGEST)) & (apart > F.lit(0.01))
    return F.when(plain, F.floor(steps + F.lit(0.5)) / F.lit(1e4)).otherwise(F.round(x, 4))
