"""Table order: values as numbers or natural text, missing values always last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def natural_key(text: Column) -> Column:
    """Text key without regard to case and accents in which digit runs compare as numbers.

    A run is led by its length, so that more digits sort later.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def comparable(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        counted = F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(part.rlike(r"^\d"), counted).otherwise(part)

    return F.collate(F.array_join(F.transform(parts, comparable), ""), "UNICODE_CI_AI")


def sort_table(df: DataFrame, column: str, direction: str = "ascending", ties: list[str] | None = None) -> DataFrame:
    """Order rows by one column; null, empty, NaN and infinite come last both ways.

    Rows have no order of their own, so ``ties`` names the columns that decide
    between equal values.
    """
    if column not in df.columns:
        raise ValueError("Cannot sort by this column")
    if direction not in ("ascending", "descending"):
        raise ValueError("Sort direction is neither ascending nor descending")
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        missing = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        key = value
    elif isinstance(kind, T.StringType):
        missing = value.isNull() | (value == "")
        key = natural_key(value)
    else:
        missing, key = value.isNull(), value
    shown = F.when(~missing, key)
    ordered = shown.asc() if direction == "ascending" else shown.desc()
    return df.orderBy(missing.asc(), ordered, *(ties or []))


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of an ordered table; the whole table is ordered first."""
    return df.offset(number * size).limit(size)
