"""Portable pseudo-random numbers: functions of a key, equal in every engine and order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(stream: str, *keys: Column) -> Column:
    """md5 of ``stream|key|key...`` as hex; orders rows at random without looking at their place."""
    return F.md5(F.concat_ws("|", F.lit(stream), *[k.cast("string") for k in keys]))


def uniform(stream: str, *keys: Column) -> Column:
    """A double in [0, 1) from the first 32 bits of :func:`keyed_hash`."""
    return F.conv(F.substring(keyed_hash(stream, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
