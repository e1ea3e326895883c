"""Live computations over journals of streamed rows.

Each is a batch operator over the journal, so a run over one file a batch and a run
over all files at once give the same rows. A running service limits the journal to
the part that can still change: 30 minutes for pairs, 10 for receipts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators import live, pairing
from usagelens.streaming import follow


def pairs(events: DataFrame) -> DataFrame:
    """Outcomes of boundary events; events without any identity are outcomes, too."""
    return pairing.pair_responses(events.drop("batch"))


def rates(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens per second over the trailing window, what arrived too late for it), each sample once."""
    in_time, late = follow.split_late(follow.first_arrivals(samples, ["event_key"], "received_at"))
    cells = live.rate_cells(live.rebased(in_time))
    rated = cells.groupBy("second", "runtime", "session_key").agg(F.sum("tps").alias("tps"))
    return rated, late.groupBy("runtime").agg(F.count(F.lit(1)).alias("responses"), F.sum("output_tokens").alias("output_tokens"))


def receipts(samples: DataFrame) -> DataFrame:
    """Counted output per arrival second; what copies finally disagree about does not count."""
    return live.receipt_seconds(live.receipt_deltas(samples.drop("batch")))


def minutes(requests: DataFrame) -> DataFrame:
    """Output tokens per minute and app of streamed ledger rows, each request once."""
    once = follow.first_arrivals(requests, ["app_type", "request_id"], "created_at")
    return once.groupBy((F.floor(F.col("created_at") / 60) * 60).alias("minute"), "app_type").agg(
        F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests")
    )
