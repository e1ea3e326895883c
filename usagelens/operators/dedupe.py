"""Removal of copied records: within a host, across hosts, and overlap flags."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.operators.bits import bit_table, with_bit

SIGNATURE = ("created_at", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")

# Columns the usage totals need; narrower than a whole ledger row.
USAGE_COLUMNS = (
    "provider_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
    "input_token_semantics", "total_cost_usd", "created_at", "data_source", "session_provider",
)


#: Windows that one stretch of time has.
STRETCH = 12


def effective_requests(requests: DataFrame, window_s: int = 600, sparse: bool = False) -> DataFrame:
    """Drop session-log rows that a successful proxy row of the same host already covers.

    A proxy covers a session row when tokens agree, the app agrees (a desktop
    proxy also covers the command-line app), cache writes agree or the session
    did not record them, models agree or one is unknown, and the times differ by
    at most ``window_s``. A null model counts as unknown.

    Times are cut into stretches of ``STRETCH`` windows. A proxy lies in its own stretch
    and, within a window of its end, in the next one, too, so a session row meets all
    proxies near it in its own. Proxies are dealt out once, by tokens and stretch, and
    shrink there to the first and last time per key and window; what is left of a key
    differs in app, cache writes and model only, of which there are few. The ledger is
    read for proxies, for session rows and for all others, which pass by untouched.
    ``sparse`` reads session rows once more, for a table of bits of their tokens and
    stretches; proxies that meet no session row are then not dealt out.
    """
    source = F.coalesce(F.col("data_source"), F.lit("proxy"))
    model = F.lower(U.model_label(F.col("model")))
    tokens = ["host", "input_tokens", "output_tokens", "cache_read_tokens"]
    at = F.col("created_at")

    def stretch(time: Column) -> Column:
        return F.floor(time / (window_s * STRETCH))

    copied = F.coalesce(F.col("data_source").isin(*U.SESSION_SOURCES), F.lit(False))
    copies, others = requests.where(copied), requests.where(~copied)
    places = F.array_distinct(F.array(stretch(at - window_s), stretch(at + window_s)))
    proxies = requests.where((source == "proxy") & U.success()).select(
        *tokens, F.col("app_type").alias("p_app"), F.col("cache_creation_tokens").alias("p_cache"), model.alias("p_model"),
        at.alias("p_at"), F.explode(places).alias("_place"),
    )
    if sparse:
        met = [*tokens, "_place"]
        near = bit_table(copies.withColumn("_place", stretch(at)).select(F.xxhash64(*met).alias("_met")), "_met")
        proxies = with_bit(proxies, near, F.xxhash64(*met), "_near").where("_near").drop("_near")
    cover = (
        proxies.repartition(*tokens, "_place")
        .groupBy(*tokens, "_place", "p_app", "p_cache", "p_model", F.floor(F.col("p_at") / window_s).alias("p_bin"))
        .agg(F.min("p_at").alias("p_first"), F.max("p_at").alias("p_last"))
    )

    named = copies.withColumns({"_place": stretch(at), "_name": model})
    app = (F.col("app_type") == F.col("p_app")) | ((F.col("app_type") == "claude") & (F.col("p_app") == "claude-desktop"))
    no_writes = (F.col("cache_creation_tokens") == 0) & (F.col("data_source") != "session_log")
    writes = no_writes | (F.col("cache_creation_tokens") == F.col("p_cache"))
    models = (F.col("_name") == F.col("p_model")) | (F.col("_name") == "unknown") | (F.col("p_model") == "unknown")
    # First and last are less than a window apart: if they reach into the two windows around a row, one of them is there.
    time = (F.col("p_first") - at <= window_s) & (at - F.col("p_last") <= window_s)
    same = reduce(and_, [F.col(f"r.{k}") == F.col(f"c.{k}") for k in (*tokens, "_place")])
    kept = named.alias("r").join(cover.alias("c"), same & app & writes & models & time, "left_anti")
    return others.unionByName(kept.select(*others.columns))


def signature() -> Column:
    """A 64-bit fingerprint of what copies must agree on; a null is a value of its own."""
    return F.xxhash64(*SIGNATURE, *[F.col(c).isNull() for c in SIGNATURE])


KEYS = ("app_type", "request_id")


def repeated_ids(requests: DataFrame) -> DataFrame:
    """A table of bits of the ids that more than one row has; only hashes are dealt out."""
    hashes = requests.select(F.xxhash64(*KEYS).alias("_hash")).repartition("_hash")
    return bit_table(hashes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "_hash")


def unique_requests(
    requests: DataFrame, columns: tuple[str, ...] | None = None, repeated: DataFrame | None = None
) -> DataFrame:
    """One row per (app, request id) over all hosts; the first host wins.

    Most ids have one row, so rows are dealt out by id as they are, without a sort
    before. The first row of an id is a minimum over a struct, and whether its copies
    agree a minimum and a maximum of their signatures, so no task holds an id's rows. A
    hash of the id leads the key: rows are then sorted by a number. The job stops when
    copies differ in time, model or tokens. ``columns`` limits the payload that is
    carried. With ``repeated``, the ``repeated_ids`` of these rows or of more, an id that
    has one row stays where it is.
    """
    keys = list(KEYS)
    carried = [c for c in (columns or requests.columns) if c in requests.columns]
    lead = ["host_order", "host", "created_at"]
    order = [*lead, *[c for c in carried if c not in keys and c not in lead]]
    needed = dict.fromkeys([*keys, *order, *SIGNATURE])
    wanted = requests.select(*needed)
    if repeated is not None:
        wanted = with_bit(wanted, repeated, F.xxhash64(*keys), "_repeated")
        single = wanted.where("NOT _repeated").select(*keys, *order)
        wanted = wanted.where("_repeated").drop("_repeated")
    dealt = wanted.repartition(*keys)
    rows = dealt.select(F.xxhash64(*keys).alias("_hash"), *keys, F.struct(*order).alias("_row"), signature().alias("_signature"))
    first = rows.groupBy("_hash", *keys).agg(
        F.min("_row").alias("_row"), F.min("_signature").alias("_least"), F.max("_signature").alias("_most")
    )
    agreed = U.require(F.col("_least") == F.col("_most"), F.concat(F.lit("Hosts disagree about request "), F.col("request_id")))
    unique = first.where(agreed).select(*keys, "_row.*")
    return unique if repeated is None else unique.unionByName(single)


ROLLUP_SIGNATURE = (
    "date", "app_type", "model", "request_count", "input_tokens", "output_tokens", "cache_read_tokens",
    "cache_creation_tokens", "input_token_semantics",
)


def rollup_overlap(rollups: DataFrame) -> DataFrame:
    """Rollup signatures a host repeats after another host reported them.

    With hosts in order, the row that follows another host's is the first of each
    host but the first: one per (signature, later host). Rows are kept in totals.
    """
    held = rollups.groupBy(*ROLLUP_SIGNATURE, "host", "host_order").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min("host_order").over(Window.partitionBy(*ROLLUP_SIGNATURE))
    return held.withColumn("_first", first).where(F.col("host_order") > F.col("_first")).drop("_first")
