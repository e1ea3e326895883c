"""The usual flow from the ledger to the facts, over the given tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from usagelens.operators import dedupe, facts
from usagelens.sources import adapters


# Columns of a ledger row that session facts need besides its usage.
SESSION_COLUMNS = ("session_id", "status_code", "duration_ms", "latency_ms", "native_response_ms")


@dataclass
class Usage:
    """Lazy steps; each is a plan, nothing runs until a result is asked for.

    Deduplication is per host first and then across hosts. What is known of a session
    meets its rows after that, so copies do not carry it around.
    """

    spark: SparkSession
    sf_dir: str
    timezone: str = "UTC"

    @cached_property
    def requests(self) -> DataFrame:
        return adapters.requests(self.spark, self.sf_dir)

    @cached_property
    def enriched(self) -> DataFrame:
        return adapters.enriched_requests(self.spark, self.sf_dir, projects=False)

    @cached_property
    def rollups(self) -> DataFrame:
        return adapters.rollups(self.spark, self.sf_dir)

    @cached_property
    def providers(self) -> DataFrame:
        return adapters.providers(self.spark, self.sf_dir)

    @cached_property
    def sources(self) -> DataFrame:
        return adapters.sources(self.spark, self.sf_dir)

    @cached_property
    def effective(self) -> DataFrame:
        return dedupe.effective_requests(self.enriched)

    def unique(self, *columns: str) -> DataFrame:
        return dedupe.unique_requests(self.effective, (*dedupe.USAGE_COLUMNS, *columns))

    def request_rows(self, *columns: str) -> DataFrame:
        return facts.request_rows(self.unique(*columns), self.providers, self.timezone)

    @cached_property
    def rollup_rows(self) -> DataFrame:
        return facts.rollup_rows(self.rollups, self.providers)

    @cached_property
    def usage(self) -> DataFrame:
        return facts.usage_rows(self.request_rows(), self.rollup_rows)

    @cached_property
    def daily(self) -> DataFrame:
        return facts.daily_usage(self.usage)

    @cached_property
    def hourly(self) -> DataFrame:
        return facts.hourly_usage(self.usage)

    def with_sessions(self, rows: DataFrame) -> DataFrame:
        return adapters.with_sessions(rows, adapters.session_evidence(self.spark, self.sf_dir))

    @cached_property
    def session_rows(self) -> DataFrame:
        """Requests that name a session, dealt out by it; most of them for the first time."""
        effective = dedupe.effective_requests(self.enriched, sparse=True)
        unique = dedupe.unique_requests(effective, (*dedupe.USAGE_COLUMNS, *SESSION_COLUMNS), dedupe.repeated_ids(self.requests))
        dealt = facts.deal_sessions(unique)
        return self.with_sessions(facts.request_rows(dealt, self.providers, self.timezone))

    @cached_property
    def sessions(self) -> DataFrame:
        return facts.session_daily(self.session_rows, dealt=True)

    @cached_property
    def timed_rows(self) -> DataFrame:
        return self.request_rows("status_code", "duration_ms", "latency_ms", "native_response_ms", "first_token_ms")

    @cached_property
    def responses(self) -> DataFrame:
        return facts.response_fact(self.timed_rows)
