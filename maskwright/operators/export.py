"""Published families: flattening, rendering, and the guard between private and public columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import na
from .schema import require

#: Columns that never leave the private side.
PRIVATE = frozenset(("rid", "row_id", "target_pos", "perm_hash", "winning", "true_label", "is_outlier", "success", "z", "draw"))


def public(frame: DataFrame) -> DataFrame:
    """``frame``, if none of its columns, nested ones included, is private."""

    def names(schema) -> set[str]:
        out: set[str] = set()
        for f in schema.fields:
            out.add(f.name.lower())
            kind = f.dataType
            while hasattr(kind, "elementType"):
                kind = kind.elementType
            if hasattr(kind, "fields"):
                out |= names(kind)
        return out

    leaked = names(frame.schema) & PRIVATE
    require(not leaked, "PUBLIC_SCHEMA", f"private columns: {', '.join(sorted(leaked))}")
    return frame


def guard_report(frames: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """How many private columns each named frame has."""
    return [(name, len({c.lower() for c in f.columns} & PRIVATE)) for name, f in sorted(frames.items())]


def flatten(nested: DataFrame, struct: str, prefix: str = "") -> DataFrame:
    """The fields of a struct as columns beside the others."""
    fields = nested.schema[struct].dataType.names
    return nested.select(*[c for c in nested.columns if c != struct], *[F.col(f"{struct}.{f}").alias(f"{prefix}{f}") for f in fields])


def rendered(frame: DataFrame) -> DataFrame:
    """Every column as text, ``NA`` for what does not apply."""
    return frame.select(*[na(F.col(c)).alias(c) for c in frame.columns])


def canonical_hash(*columns):
    """SHA-256 of the values as text in the given order, tab-joined, NA for null."""
    return F.sha2(F.concat_ws("\t", *[na(c) for c in columns]), 256)
