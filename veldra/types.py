"""The four types of the dialect, and what else may pass through."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Family(Enum):
    """Types compare and compute within their family only."""

    INTEGER = "INTEGER"
    FLOAT = "FLOAT"
    VARCHAR = "VARCHAR"
    BOOLEAN = "BOOLEAN"
    OTHER = "OTHER"


SPARK_TYPE = {
    Family.INTEGER: T.IntegerType(),
    Family.FLOAT: T.DoubleType(),
    Family.VARCHAR: T.StringType(),
    Family.BOOLEAN: T.BooleanType(),
}
#: Spellings of column types.
SPELLING = {"INT": Family.INTEGER, "INTEGER": Family.INTEGER, "FLOAT": Family.FLOAT, "VARCHAR": Family.VARCHAR, "BOOLEAN": Family.BOOLEAN}


def family_of(kind: T.DataType) -> Family:
    """Integral widths are one family, as are both floating ones; dates, arrays and so on are OTHER."""
    if isinstance(kind, T.IntegralType):
        return Family.INTEGER
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return Family.FLOAT
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Family.VARCHAR
    return Family.BOOLEAN if isinstance(kind, T.BooleanType) else Family.OTHER


def show_value(value: object) -> str:
    """As in plans and printed results."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:.6f}" if isinstance(value, float) else str(value)
