"""A table of bits, by which rows that surely lack a partner pass by a large step.

The table has a fixed size, so it can be sent to every task whatever the input. A key
whose bit is not set is not among the keys. One whose bit is set may be: such rows take
the exact step, and the fuller the table, the more of them there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a table.
WORDS = 1 << 20


def _word(key: Column) -> Column:
    return F.pmod(key, F.lit(WORDS).cast("bigint"))


def _bit(key: Column) -> Column:
    return F.shiftright(key, 32).bitwiseAND(F.lit(63)).cast("int")


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """The bits of 64-bit hashes, one row per word that has any."""
    # A shift by a column is known to SQL only.
    told = keys.select(_word(F.col(key)).alias("_word"), _bit(F.col(key)).alias("_bit"))
    return told.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))


def with_bit(rows: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds whether a row's hash may be in the table."""
    held = rows.withColumn("_key", key).withColumns({"_word": _word(F.col("_key")), "_bit": _bit(F.col("_key"))})
    # A fixed size, so this may be said.
    found = held.join(F.broadcast(table), "_word", "left")
    return found.withColumn(name, F.coalesce(F.expr("getbit(_bits, _bit)") == 1, F.lit(False))).drop("_key", "_word", "_bit", "_bits")
