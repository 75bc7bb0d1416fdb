"""Column functions for exact fractions, labels and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs, by Euclid's rule within one expression."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    steps = F.sequence(F.lit(1), F.lit(96))  # longs need fewer than 96 steps

    def step(s: Column, _: Column) -> Column:
        return F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))

    return F.aggregate(steps, start, step, lambda s: s["x"])


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; null where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def interval_label(low: Column, high: Column) -> Column:
    """``low-high``, or the one value if both are equal."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def block_label(value: Column, width: int) -> Column:
    """The label of the block of ``width`` whole numbers, counted from 1, that ``value`` lies in."""
    low = (value - 1) - (value - 1) % width + 1
    return F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string"))


def na(value: Column) -> Column:
    """Text of a value, ``NA`` where it does not apply."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def cell_is_clean(cell: Column) -> Column:
    """Non-empty, trimmed, not ``?``, no NUL, CR, LF or TAB; a null cell is not clean."""
    bad = r"[\x00\r\n\t]"
    return F.coalesce((F.length(cell) > 0) & (cell == F.trim(cell)) & (cell != "?") & ~cell.rlike(bad), F.lit(False))


def endpoint_sign(low: Column, high: Column) -> Column:
    return F.when(low > 0, "positive").when(high < 0, "negative").otherwise("includes_zero")
