"""Comparison forms: ids, names and type names compare without regard to letter case and surrounding blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as surrounding blanks.
BLANKS = " \t\r\n\f\x0b "


def key(col: Column | str) -> Column:
    """Lower case without surrounding blanks; null for null and blank."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def folded(col: Column | str) -> Column:
    """Lower case without surrounding blanks; a blank stays ''."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp column as microseconds since 1970 in its own clock; works for TIMESTAMP and TIMESTAMP_NTZ."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(c)
