"""Titles, projects, providers and native timing attached to ledger rows.

Evidence is reduced to one row per key before it meets the ledger, so a ledger
row is never multiplied. Conflicting evidence fails or leaves the row unassigned;
it is never picked from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions import usage as U
from usagelens.functions.projects import with_project

NO_PARENT = "Parent title unavailable"


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def spread_nulls(key: Column, row_id: Column) -> Column:
    """A join key in which rows without a key match nothing and do not share a partition."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row_id), F.lit(65536)).cast("string")))


def family(app_type: Column) -> Column:
    """Which client's saved conversations an app's sessions belong to."""
    return F.when(app_type == "codex", F.lit("codex")).when(app_type.isin(*U.CLAUDE_APPS), F.lit("claude"))


def newest_threads(threads: DataFrame) -> DataFrame:
    """The row of the newest version per thread."""
    fields = [c for c in threads.columns if c not in ("id", "version")]
    return threads.groupBy("id").agg(F.max(F.struct("version", *fields)).alias("t")).select(
        "id", *[F.col(f"t.{c}").alias(c) for c in fields]
    )


def thread_titles(index: DataFrame, threads: DataFrame) -> DataFrame:
    """Saved title per thread: a non-blank thread name, else the index title.

    A sub-agent is titled after its parent's thread name or index title.
    """
    indexed = (
        index.where(~F.coalesce(F.col("thread_name") == "", F.lit(True)))
        .groupBy("id")
        .agg(F.max_by("thread_name", "ordinal").alias("indexed"))
    )
    saved = newest_threads(threads).select(
        "id", F.when(~_blank(F.col("name")), F.col("name")).alias("name"), "parent_id"
    )
    own = saved.join(indexed, "id", "full").withColumn("own_title", F.coalesce("name", "indexed"))
    parents = own.select(F.col("id").alias("parent_id"), F.col("own_title").alias("parent_title"))
    # Threads without a parent spread over all partitions of the self join.
    keyed = own.withColumn("parent_key", spread_nulls(F.col("parent_id"), F.col("id")))
    joined = keyed.join(parents.withColumnRenamed("parent_id", "parent_key"), "parent_key", "left")
    child = F.concat(F.lit("Subagent of: "), F.coalesce("parent_title", F.lit(NO_PARENT)))
    title = F.when(F.col("parent_id").isNotNull(), child).otherwise(F.col("own_title"))
    return joined.select(F.col("id").alias("session_id"), title.alias("title")).where("title IS NOT NULL")


def session_titles(custom: DataFrame) -> DataFrame:
    """Titles saved per conversation, kept where all copies agree."""
    named = custom.where(~_blank(F.col("title"))).groupBy("session_id").agg(
        F.min("title").alias("title"), F.max("title").alias("_most")
    )
    return named.where(F.col("title") == F.col("_most")).drop("_most")


def conversation_titles(custom: DataFrame, files: DataFrame, desktop: DataFrame) -> DataFrame:
    """One title per conversation, and where it was saved: ``desktop``, ``file`` or ``log``.

    The desktop app's title wins where all its copies agree, then that of the
    conversation's own file (of several the last by path), then the log's.
    """
    own = files.where(~_blank(F.col("title"))).groupBy("session_id").agg(F.max_by("title", F.struct("file", "title")).alias("title"))
    told = None
    for rank, (source, titles) in enumerate((("log", custom.where(~_blank(F.col("title")))), ("file", own), ("desktop", session_titles(desktop)))):
        part = titles.select("session_id", F.struct(F.lit(rank).alias("rank"), "title", F.lit(source).alias("source")).alias("t"))
        told = part if told is None else told.unionByName(part)
    best = told.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("t").alias("t"))
    return best.select("session_id", "t.title", "t.source")


def session_projects(dirs: DataFrame) -> DataFrame:
    """The one project each session was seen in; key null where there were several."""
    known = with_project(dirs.select("session_id", "cwd").distinct(), "cwd").where("project_key IS NOT NULL")
    seen = known.groupBy("session_id").agg(
        F.min("project_key").alias("_least"),
        F.max("project_key").alias("_most"),
        F.min_by("project_name", F.struct("project_key", "cwd")).alias("_name"),
    )
    one = F.col("_least") == F.col("_most")
    return seen.select(
        "session_id", F.when(one, F.col("_least")).alias("project_key"), F.when(one, F.col("_name")).alias("project_name")
    )


def session_providers(headers: DataFrame) -> DataFrame:
    """Provider per session from its headers; two different ones stop the job."""
    found = headers.where(~F.coalesce(F.col("model_provider") == "", F.lit(True))).groupBy("session_id").agg(
        F.min("model_provider").alias("session_provider"), F.max("model_provider").alias("_most")
    )
    agreed = U.require(
        F.col("session_provider") == F.col("_most"), "Headers of one session name different providers"
    )
    return found.where(agreed).drop("_most")


def header_projects(headers: DataFrame) -> DataFrame:
    """Distinct project count and one project per session, from headers."""
    known = with_project(headers.select("session_id", "cwd").distinct(), "cwd").where("project_key IS NOT NULL")
    pair = F.struct("project_key", "project_name")
    return known.groupBy("session_id").agg(F.min(pair).alias("_first"), F.max(pair).alias("_last")).select(
        "session_id",
        F.col("_first.project_key").alias("header_key"),
        F.col("_first.project_name").alias("header_name"),
        F.col("_first").eqNullSafe(F.col("_last")).alias("header_single"),
    )


def message_evidence(messages: DataFrame, titles: DataFrame, projects: DataFrame) -> DataFrame:
    """Per message: its session when there is one, and what all its sessions agree on.

    Messages are dealt out once, with their session only, by the id that a request has:
    grouping and the join with requests leave them there. What is told of a message is
    the same however often it was seen, so copies need no step of their own.
    """
    seen = messages.select(F.concat(F.lit("session:"), F.col("message_id")).alias("request_id"), "session_id")
    joined = seen.repartition("request_id").join(titles, "session_id", "left").join(projects, "session_id", "left")
    grouped = joined.groupBy("request_id").agg(
        F.min("session_id").alias("_s"), F.max("session_id").alias("_s2"),
        F.min("title").alias("_t"), F.max("title").alias("_t2"),
        F.count_if(_blank(F.col("title"))).alias("_untitled"),
        F.min("project_key").alias("_p"), F.max("project_key").alias("_p2"), F.max("project_name").alias("_pn"),
        F.count_if(F.col("project_key").isNull()).alias("_unplaced"),
    )
    one = F.col("_s") == F.col("_s2")
    same_title = ~one & (F.col("_untitled") == 0) & (F.col("_t") == F.col("_t2"))
    same_project = (F.col("_unplaced") == 0) & (F.col("_p") == F.col("_p2"))
    return grouped.select(
        "request_id",
        F.when(one, F.col("_s")).alias("linked_session"),
        F.when(same_title, F.trim(F.col("_t"))).alias("message_title"),
        F.when(same_project, F.col("_p")).alias("message_project"),
        F.when(same_project, F.col("_pn")).alias("message_project_name"),
        F.lit(True).alias("in_messages"),
    )


def link_messages(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Give a request the session of its message; several sessions leave it ambiguous.

    ``link`` is linked, same_title, ambiguous or null. Messages tell of Claude's requests
    only, so all others pass by untouched.
    """
    told = F.coalesce(F.col("app_type").isin(*U.CLAUDE_APPS), F.lit(False)) & F.col("request_id").isNotNull()
    rows = requests.where(told).join(evidence, "request_id", "left").unionByName(requests.where(~told), allowMissingColumns=True)
    claude = F.col("app_type").isin(*U.CLAUDE_APPS) & F.col("in_messages").isNotNull()
    session = F.when(claude & F.col("linked_session").isNotNull(), F.col("linked_session")).otherwise(F.col("session_id"))
    link = (
        F.when(claude & F.col("linked_session").isNotNull() & ~F.col("linked_session").eqNullSafe(F.col("session_id")), "linked")
        .when(claude & F.col("linked_session").isNull() & F.col("message_title").isNotNull(), "same_title")
        .when(claude & F.col("linked_session").isNull(), "ambiguous")
    )
    return rows.withColumns(
        {
            "link": link,
            "session_id": session,
            "message_title": F.when(claude, F.col("message_title")),
            "message_project": F.when(claude, F.col("message_project")),
            "message_project_name": F.when(claude, F.col("message_project_name")),
            "in_messages": claude,
        }
    ).drop("linked_session")


def by_session(titles: DataFrame, projects: DataFrame, of: str) -> DataFrame:
    """Title and project of a client's sessions in one table."""
    return titles.join(projects, "session_id", "full").withColumn("family", F.lit(of))


def attach_sessions(linked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session title, and the project on which every candidate session agrees."""
    dimension = sessions.select(
        F.col("session_id").alias("_sid"),
        F.col("family").alias("_family"),
        F.col("title").alias("_title"),
        F.col("project_key").alias("_project"),
        F.col("project_name").alias("_project_name"),
    )
    rows = linked.withColumns(
        {"_key": spread_nulls(F.col("session_id"), F.col("request_id")), "_app": family(F.col("app_type"))}
    )
    joined = rows.join(dimension, (F.col("_key") == F.col("_sid")) & (F.col("_app") == F.col("_family")), "left")
    from_message = F.col("in_messages")
    return joined.withColumns(
        {
            "session_title": F.nullif(F.coalesce("message_title", "_title"), F.lit("")),
            "project_key": F.when(from_message, F.col("message_project")).otherwise(F.col("_project")),
            "project_name": F.when(from_message, F.col("message_project_name")).otherwise(F.col("_project_name")),
        }
    ).drop("_key", "_app", *dimension.columns, "message_title", "message_project", "message_project_name", "in_messages")


def attach_headers(rows: DataFrame, headers: DataFrame, land: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Session provider for rows from session logs, and projects checked against headers.

    ``land`` may write what headers tell of sessions before it meets the rows.
    """
    evidence = session_providers(headers).join(header_projects(headers), "session_id", "full")
    evidence = land(evidence) if land else evidence
    keyed = rows.withColumn("_key", spread_nulls(F.col("session_id"), F.col("request_id")))
    joined = keyed.join(evidence.withColumnRenamed("session_id", "_key"), "_key", "left")
    agrees = F.col("header_single") & (
        F.col("project_key").isNull()
        | (
            (F.col("project_key") == F.col("header_key"))
            & (F.coalesce("project_name", F.lit("")) == F.coalesce("header_name", F.lit("")))
        )
    )
    placed = F.col("header_key").isNotNull()
    return joined.withColumns(
        {
            "session_provider": F.when(F.col("data_source") == "codex_session", F.col("session_provider")),
            "project_name": F.when(~placed, F.col("project_name")).when(agrees, F.col("header_name")),
            "project_key": F.when(~placed, F.col("project_key")).when(agrees, F.col("header_key")),
        }
    ).drop("_key", "header_key", "header_name", "header_single")


def hash_sessions(rows: DataFrame) -> DataFrame:
    """Replace the session id by its key; the id itself goes no further."""
    return rows.withColumn("session_key", U.session_key(F.col("session_id"))).drop("session_id")


TIMING_KEY = ("session_id", "created_at", "input_tokens", "output_tokens", "cache_read_tokens")


def attach_native_timing(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Native response time where one ledger row and one log event share a signature.

    A signature is session, second and token counts. Both sides are counted
    first; a signature that is not unique on both sides gives nothing.
    """
    logged = F.col("data_source") == "codex_session"
    asked = requests.where(logged & F.col("session_id").isNotNull()).groupBy(*TIMING_KEY).agg(F.count(F.lit(1)).alias("_rows"))
    timed = (
        intervals.groupBy(
            "session_id",
            F.col("second").alias("created_at"),
            "input_tokens",
            "output_tokens",
            F.col("cached_input_tokens").alias("cache_read_tokens"),
        )
        .agg(F.count(F.lit(1)).alias("_events"), F.max("duration_ms").alias("_native"))
        .where((F.col("_events") == 1) & F.col("_native").isNotNull())
    )
    matched = asked.where("_rows = 1").join(timed, list(TIMING_KEY)).select(*TIMING_KEY, "_native")
    keyed = requests.withColumn("_sid", F.col("session_id")).withColumn(
        "session_id", spread_nulls(F.when(logged, F.col("session_id")), F.col("request_id"))
    )
    joined = keyed.join(matched, list(TIMING_KEY), "left")
    return joined.withColumns({"session_id": F.col("_sid"), "native_response_ms": F.col("_native")}).drop("_sid", "_native")


def enrichment_audit(rows: DataFrame) -> DataFrame:
    """How many rows each kind of evidence reached."""
    return rows.agg(
        F.count_if(F.col("session_title").isNotNull()).alias("requests_with_saved_title"),
        F.count_if(F.col("link") == "linked").alias("requests_linked_by_message_id"),
        F.count_if(F.col("link") == "ambiguous").alias("ambiguous_message_id_requests"),
        F.count_if(F.col("link") == "same_title").alias("message_id_requests_resolved_by_same_title"),
        F.count_if(F.col("session_provider").isNotNull()).alias("requests_matched"),
        F.count_if(F.col("project_key").isNotNull()).alias("requests_with_project"),
    )
