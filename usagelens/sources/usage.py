"""Ledger, rollup and provider tables of many machines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import schemas

TABLES = {"proxy_request_logs": schemas.REQUESTS, "usage_daily_rollups": schemas.ROLLUPS, "providers": schemas.PROVIDERS}


@dataclass(frozen=True)
class Source:
    """Where one machine's tables are landed, one folder or file per table."""

    host: str
    path: str
    fmt: str = "parquet"
    timezone: str = "UTC"
    collected_at: str | None = None
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class UsageTables:
    requests: DataFrame
    rollups: DataFrame
    providers: DataFrame
    sources: DataFrame


def conform(df: DataFrame, schema: str, name: str) -> DataFrame:
    """The wanted columns with their types; optional ones may be missing, others not."""
    wanted = schemas.columns(schema)
    missing = sorted(set(wanted) - set(df.columns) - set(schemas.OPTIONAL))
    if missing:
        raise ValueError(f"Table {name} lacks {', '.join(missing)}")
    kinds = {part.split()[0]: part.split(maxsplit=1)[1] for part in _fields(schema)}
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(schemas.OPTIONAL[c])).cast(kinds[c]).alias(c)
            for c in wanted
        ]
    )


def _fields(schema: str) -> list[str]:
    return [part.strip().replace(";", ",") for part in schema.replace("(38,18)", "(38;18)").split(",")]


def read_table(spark: SparkSession, source: Source, name: str) -> DataFrame:
    reader = spark.read.format(source.fmt).options(**dict(source.options))
    df = conform(reader.load(f"{source.path}/{name}"), TABLES[name], name)
    return df.withColumn("host", F.lit(source.host))


def read_usage(spark: SparkSession, sources: list[Source]) -> UsageTables:
    """Tables of all machines together; a source that cannot be read fails the read.

    The order of ``sources`` decides which host keeps a copied request.
    """
    if not sources:
        raise ValueError("No sources given")
    parts: dict[str, list[DataFrame]] = {name: [] for name in TABLES}
    for order, source in enumerate(sources):
        for name in TABLES:
            parts[name].append(read_table(spark, source, name).withColumn("host_order", F.lit(order)))
    together = {name: reduce(lambda a, b: a.unionByName(b), dfs) for name, dfs in parts.items()}
    rows = [(s.host, order, s.collected_at, s.timezone, "fresh") for order, s in enumerate(sources)]
    machines = spark.createDataFrame(
        rows, "host string, host_order int, collected_at string, host_timezone string, status string"
    ).withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    return UsageTables(
        together["proxy_request_logs"], together["usage_daily_rollups"], together["providers"].drop("host_order"), machines
    )
