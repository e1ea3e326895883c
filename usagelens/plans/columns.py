"""Result columns in a form every SQL engine hashes alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(name: str = "cost_usd") -> Column:
    return F.round(F.col(name) * 100).cast("bigint").alias("cost_cents")


def flat(df: DataFrame) -> DataFrame:
    """Money as whole cents, doubles rounded, string arrays joined.

    Latencies are whole milliseconds underneath and can end in a half digit, so
    they keep more places.
    """
    out = []
    for name, kind in df.dtypes:
        if name == "cost_usd":
            out.append(cents())
        elif kind == "double":
            out.append(F.round(name, 9 if name.startswith("latency") else 6).alias(name))
        elif kind == "array<string>":
            out.append(F.array_join(name, ",").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
