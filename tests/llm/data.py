"""Small tables that every corpus operator must stand: nulls, empty and long texts, ties, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, _order long, chunk int, "
    "n_words string, score string, fp string, hash string, kept string, bucket string, _text string, _words string, shard string, null string"
)


def words(seed: int, n: int, pool: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{k:x}" for k in (r.randrange(pool) for _ in range(n)))


def texts() -> list[tuple[int | None, str | None]]:
    long = words(1, 30_000, 1 << 20)
    passage = words(2, 90)
    near = words(3, 120).split()
    edited = [*near[:60], "changed", *near[61:]]
    return [
        (1, words(4, 60) + " " + passage + " " + words(5, 30)),
        (2, passage),
        (3, words(6, 15) + "\n" + passage + "\t" + words(7, 10)),
        (4, ""),
        (5, None),
        (6, " ".join(near)),
        (7, " ".join(edited)),
        (8, " ".join(near)),
        (8, " ".join(near)),  # a repeated row
        (9, long),
        (10, "one"),
        (11, "Ünïcödé 日本語 🎉 " * 40),
        (12, "a " * 300),
        (13, "aaaaaaaaaa" * 100),
        (None, words(8, 50)),
        (None, None),
        (None, passage + " " + words(9, 5)),
        (14, "  \n\t "),
        (15, "x\x00y \x1c z</s>[INST]<|endoftext|> end"),
        (-3, words(10, 25)),
    ]


def docs(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The texts with columns whose names operators use inside."""
    rows = texts() if rows is None else rows
    rest = ("l", "s", 0, 7, "r", 5, 3, *"abcdefghijkl"[:10])
    return spark.createDataFrame([(i, t, *rest) for i, t in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
