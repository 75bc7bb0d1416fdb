"""Sums of doubles that do not depend on the order of the rows, rounded once.

Every number is cut in pieces of 32 bits at fixed places of the exponent range. Pieces of the same place are whole numbers, whose sums are
exact, so they can be added up by any number of tasks in any order; at the end the places (70 at most) of a group are put together
and rounded to the nearest double.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a piece; places go from LOW to HIGH, and those beyond stand for what is not finite.
BITS, LOW, HIGH = 32, -36, 32
INFINITE, NEGATIVE_INFINITE, NOT_A_NUMBER = HIGH + 1, HIGH + 2, HIGH + 3
_BASE = float(1 << BITS)


def _half_power(place: Column) -> Column:
    """2 ** (-16 place), so that two of them scale a number exactly, subnormal ones included."""
    return F.element_at(F.array(*[F.lit(math.ldexp(1.0, -16 * k)) for k in range(LOW, HIGH + 1)]), place - F.lit(LOW) + 1)


def pieces(x: Column) -> Column:
    """``place, part`` of a double: x is the sum of part * 2 ** (32 place). Null has none."""
    a = F.abs(x)
    # the logarithm may be off by a little at the places' ends
    guess = F.floor(F.log2(a) / BITS).cast("int")
    sign = F.signum(x)

    def parts(p: Column) -> Column:
        y = a * _half_power(p) * _half_power(p)
        first = F.floor(y)
        rest = (y - first) * F.lit(_BASE)
        second = F.floor(rest)
        third = (rest - second) * F.lit(_BASE)
        return F.array(*[F.struct((p - k).alias("place"), (sign * v).cast("decimal(20,0)").alias("part")) for k, v in enumerate((first, second, third))])

    def special(place: int) -> Column:
        return F.array(F.struct(F.lit(place).alias("place"), F.lit(1).cast("decimal(20,0)").alias("part")))

    infinite = F.lit(math.inf)
    found = F.when(F.isnan(x), special(NOT_A_NUMBER)).when(x == infinite, special(INFINITE)).when(x == -infinite, special(NEGATIVE_INFINITE))
    found = found.when(x == 0, F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("decimal(20,0)").alias("part"))))
    # a piece of 33 bits is as good as one of 32
    return found.otherwise(parts(F.least(F.greatest(guess, F.lit(LOW + 2)), F.lit(HIGH - 1))))


def together(places: dict[int, int]) -> float | None:
    """The double nearest to the sum of part * 2 ** (32 place) over the items; None for no items."""
    if not places:
        return None
    if places.get(NOT_A_NUMBER) or (places.get(INFINITE) and places.get(NEGATIVE_INFINITE)):
        return math.nan
    if places.get(INFINITE) or places.get(NEGATIVE_INFINITE):
        return math.inf if places.get(INFINITE) else -math.inf
    whole = sum(n << (BITS * (place - LOW)) for place, n in places.items() if place <= HIGH)
    try:
        return whole / (1 << (BITS * -LOW))  # the division of whole numbers rounds once
    except OverflowError:
        return math.inf if whole > 0 else -math.inf


@F.pandas_udf(T.StringType())
def _rounded(lists: pd.Series) -> pd.Series:
    """The sums as shortest texts, as a series would take NaN for null."""

    def one(items) -> str | None:
        found = together({int(item["place"]): int(item["total"]) for item in items})
        return None if found is None else repr(found)

    return pd.Series([one(items) for items in lists], dtype=object)


def exact_sums(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """``<by>`` and for each of ``values`` the sum of its doubles in the group, rounded once: the same bits however the rows are dealt.

    Nulls are left out; the sum of nothing is null. NaN and infinities go their usual ways.
    """
    empty = F.array().cast("array<struct<place:int,part:decimal(20,0)>>")

    def numbered(k: int, x: Column) -> Column:
        made = F.when(x.isNotNull(), pieces(x.cast("double"))).otherwise(empty)
        return F.transform(made, lambda p: F.struct(F.lit(k).alias("value"), p["place"].alias("place"), p["part"].alias("part")))

    def chosen(k: int) -> Column:
        mine = F.filter("all", lambda p: p["value"] == k)
        return _rounded(F.transform(mine, lambda p: F.struct(p["place"].alias("place"), p["total"].cast("string").alias("total")))).cast("double")

    nothing = F.array(F.struct(F.lit(-1).alias("value"), F.lit(0).alias("place"), F.lit(0).cast("decimal(20,0)").alias("part")))  # keeps groups of nulls
    each = rows.select(*by, F.explode(F.concat(nothing, *[numbered(k, x) for k, x in enumerate(values.values())])).alias("p"))
    added = each.groupBy(*by, "p.value", "p.place").agg(F.sum("p.part").alias("total"))
    # at most 70 places for each value
    grouped = added.groupBy(*by).agg(F.collect_list(F.struct("value", "place", "total")).alias("all"))
    return grouped.select(*by, *[chosen(k).alias(name) for k, name in enumerate(values)])
