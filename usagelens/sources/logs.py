"""Conversation logs read line by line, with positions, as typed events.

Files may be far larger than a task's memory, so lines are read as a splittable
text scan. A line's number is a running count over the file's splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.functions import usage as U
from usagelens.operators import intervals
from usagelens.operators.prefix import running_sums


def read_lines(spark: SparkSession, *paths: str, pattern: str = "*.jsonl") -> DataFrame:
    """Every line of every matching file below the paths, numbered from 0 in its file.

    ``ended`` is false for a file's last line if no line break follows it yet.
    """
    text = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(list(paths))
    ).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    # Lines of one split are read in order by one task; splits are ordered by their offset.
    # A line's bytes and its break add up to the file's size, but for a break that is not there yet.
    counts = {"upto": F.lit(1).cast("bigint"), "bytes": F.octet_length("value") + F.lit(1).cast("bigint")}
    numbered = running_sums(text, ["file"], F.col("block"), [F.col("place")], counts)
    return numbered.select("file", (F.col("upto") - 1).alias("ordinal"), (F.col("bytes") <= F.col("size")).alias("ended"), "value")


def read_records(spark: SparkSession, *paths: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """Parsed lines. A last line that still lacks its line break may be torn and is
    dropped if it does not parse; any other such line stops the job."""
    lines = read_lines(spark, *paths, pattern=pattern).where(F.trim("value") != "")
    # One expression, so that no filter can drop a bad line before it is judged.
    keep = (
        F.when(F.try_parse_json("value").isNotNull(), F.lit(True))
        .when(~F.col("ended"), F.lit(False))
        .otherwise(U.fail(F.concat(F.lit("Line is no JSON in "), F.col("file"))))
    )
    return lines.where(keep).select("file", "ordinal", F.from_json("value", schema).alias("r"))


def file_session(file: Column) -> Column:
    """The session id that ends a log's file name."""
    return F.regexp_extract(file, r"([^/]{36})\.jsonl$", 1)


def only_sessions(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of files named after one of the wanted sessions."""
    named = records.withColumn("_sid", file_session(F.col("file")))
    return named.join(wanted.select(F.col("session_id").alias("_sid")).distinct(), "_sid", "left_semi").drop("_sid")


def session_headers(records: DataFrame) -> DataFrame:
    """First record of each file, where it is a session header."""
    return records.where((F.col("ordinal") == 0) & (F.col("r.type") == "session_meta")).select(
        "file",
        F.col("r.payload.id").alias("session_id"),
        F.col("r.payload.model_provider").alias("model_provider"),
        F.col("r.payload.cwd").alias("cwd"),
        F.coalesce("r.payload.subagent_history_start_ordinal", F.lit(0)).alias("inherited_until"),
    )


def epoch_s(text: Column) -> Column:
    return F.unix_micros(F.to_timestamp(text)) / 1e6


def line_events_a(records: DataFrame) -> DataFrame:
    """The event that a line of a log of kind A is, from the line alone; ``header`` for its first."""
    kind, typ, payload = F.col("r.type"), F.col("r.payload.type"), "r.payload."
    task = kind == "event_msg"
    item = kind == "response_item"
    role = F.col(payload + "role")
    last = F.col(payload + "info.last_token_usage")
    event = (
        F.when((F.col("ordinal") == 0) & (kind == "session_meta"), "header")
        .when(F.col("ordinal") == 0, F.lit(None))
        .when(task & (typ == "task_started"), "start")
        .when((task & typ.isin("task_complete", "turn_aborted")) | (kind == "compacted"), "reset")
        .when(item & (typ == "message") & (role == "user"), "input")
        .when(item & typ.isin("function_call_output", "custom_tool_call_output"), "result")
        .when(item & typ.isin("function_call", "custom_tool_call"), "call")
        .when(item & ((typ == "reasoning") | ((typ == "message") & (role == "assistant"))), "output")
        .when(kind == "token_usage_record", "usage")
        .when(task & (typ == "token_count") & last.isNotNull(), "count")
        .when(kind == "turn_context", "context")
    )
    use = F.when(kind == "token_usage_record", F.col(payload + "usage")).otherwise(last)
    header = event == "header"
    return records.where(event.isNotNull()).select(
        "file", "ordinal", epoch_s(F.col("r.timestamp")).alias("stamp"), event.alias("event"),
        F.when(event.isin("call", "result"), F.col(payload + "call_id")).alias("call_id"),
        F.when(event == "context", F.col(payload + "model")).alias("model"),
        F.when(event == "usage", F.col(payload + "response_id")).alias("response_id"),
        F.when(event.isin("usage", "count"), use["input_tokens"]).alias("input_tokens"),
        F.when(event.isin("usage", "count"), use["output_tokens"]).alias("output_tokens"),
        F.when(event.isin("usage", "count"), F.coalesce(use["cached_input_tokens"], F.lit(0))).alias("cached_input_tokens"),
        F.when(event == "count", F.to_json(F.col(payload + "info.total_token_usage"))).alias("total"),
        F.when(event == "usage", F.col(payload + "thread_id")).alias("thread_id"),
        F.when(header, F.col(payload + "id")).alias("session_id"),
        F.when(header, F.col(payload + "model_provider")).alias("model_provider"),
        F.when(header, F.coalesce(payload + "subagent_history_start_ordinal", F.lit(0))).cast("bigint").alias("inherited_until"),
    )


def log_a_events(records: DataFrame, live: bool = False) -> DataFrame:
    """Ordered events of logs of kind A, one session per file.

    Live reading also skips the copied start of a forked log and usage of other
    threads.
    """
    headers = session_headers(records).select("file", "session_id", "model_provider", "inherited_until")
    lines = line_events_a(records).where("event <> 'header'").drop("session_id", "model_provider", "inherited_until")
    rows = lines.join(headers, "file")
    if live:
        own = F.col("thread_id").isNull() | (F.col("thread_id") == F.col("session_id"))
        rows = rows.where((F.col("ordinal") > F.col("inherited_until")) & own)
    events = rows.select(
        "file", "session_id", "ordinal", "stamp", "event", "call_id", "model", "response_id", "input_tokens", "output_tokens",
        "cached_input_tokens", "total", U.clean_label(F.col("model_provider"), 120, "Provider unreported").alias("provider"),
    )
    return _without_repeated_totals(events) if live else events.drop("total")


def _without_repeated_totals(events: DataFrame) -> DataFrame:
    """Drop counts whose cumulative total repeats the count before."""
    counted = events.where((F.col("event") == "count") & F.col("total").isNotNull())
    fresh = intervals.drop_repeats(counted, F.col("total"), "ordinal", ["session_id"])
    others = events.where(~((F.col("event") == "count") & F.col("total").isNotNull()))
    return others.unionByName(fresh)


def native_samples_a(events: DataFrame) -> DataFrame:
    """Response samples of live logs of kind A, with the model of the latest turn context."""
    contexts = running_sums(
        events, ["session_id"], F.floor(F.col("ordinal") / intervals.CHUNK), [F.col("ordinal")],
        {"context": (F.col("event") == "context").cast("bigint")},
    )
    named = Window.partitionBy("session_id", "context").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    labelled = contexts.withColumn("model", U.clean_label(F.first("model", ignorenulls=True).over(named), 120))
    carried = labelled.select("session_id", "ordinal", "provider")
    rows = intervals.response_intervals(labelled.where("event <> 'context'"), live=True).where("NOT mirror")
    return keyed_samples_a(rows.join(carried, ["session_id", "ordinal"]).where("output_tokens > 0"))


def keyed_samples_a(rows: DataFrame) -> DataFrame:
    """Samples of reported responses: by response id, else by what the log says of them."""
    named_id = U.usable_identity(F.col("response_id"))
    key = F.when(named_id.isNotNull(), U.opaque_identity(F.lit("codex"), F.lit("response"), named_id)).otherwise(
        U.opaque_identity(
            F.lit("codex"), F.col("session_id"), F.col("event"), F.col("second"), F.col("input_tokens"),
            F.col("cached_input_tokens"), F.col("output_tokens"),
        )
    )
    return _samples(rows.withColumn("event_key", key), "codex")


def log_b_events(records: DataFrame) -> DataFrame:
    """Ordered events of logs of kind B; a line's tool blocks become events of their own."""
    line, message = F.col("r"), F.col("r.message")
    blocks = F.coalesce(F.from_json(message["content"], schemas.LOG_B_BLOCKS), F.array().cast(schemas.LOG_B_BLOCKS))
    agent = U.usable_identity(line["agentId"])
    session = U.usable_identity(line["sessionId"])
    sid = F.when(agent.isNotNull(), F.concat(session, F.lit(":agent:"), agent)).otherwise(session)
    rows = records.where(line["type"].isin("user", "assistant")).select(
        "file", "ordinal", sid.alias("session_id"), epoch_s(line["timestamp"]).alias("stamp"), line["type"].alias("side"),
        message["id"].alias("message_id"), U.clean_label(message["model"], 120).alias("model"),
        U.clean_label(F.coalesce(line["model_provider"], line["provider"]), 120, "Provider unreported").alias("provider"),
        message["usage"]["output_tokens"].alias("output_tokens"),
        F.coalesce(line["isApiErrorMessage"], F.lit(False)).alias("failed"), message["stop_reason"].alias("stop"), blocks.alias("blocks"),
    )
    user = F.col("side") == "user"
    no_text = F.lit(None).cast("string")

    def event(name: str, part: int, call: Column = no_text) -> Column:
        return F.struct(F.lit(name).alias("event"), F.lit(part).alias("part"), call.alias("call_id"))

    results = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: event("result", 0, b["tool_use_id"]))
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: event("call", 2, b["id"]))
    counted = F.coalesce(F.col("output_tokens") > 0, F.lit(False))
    ending = F.when(~counted & F.col("failed"), F.array(event("failed", 3))).when(
        ~counted & F.col("stop").isNotNull(), F.array(event("stop", 3))
    )
    reply = F.concat(F.array(event("output", 1)), calls)
    reply = F.when(ending.isNotNull(), F.concat(reply, ending)).otherwise(reply)
    asked = F.concat(results, F.array(event("input", 1)))
    exploded = rows.withColumn("e", F.explode(F.when(user, asked).otherwise(reply)))
    return exploded.where("session_id IS NOT NULL").select(
        "file", "session_id", "ordinal", "e.part", "stamp", "e.event", "e.call_id", "message_id", "model", "provider", "output_tokens"
    )


def native_samples_b(events: DataFrame) -> DataFrame:
    return keyed_samples_b(intervals.message_intervals(events))


def keyed_samples_b(rows: DataFrame) -> DataFrame:
    """Samples of messages, by message id."""
    key = U.opaque_identity(F.lit("claude"), F.lit("response"), F.col("message_id"))
    return _samples(rows.withColumn("event_key", key), "claude")


def _samples(rows: DataFrame, runtime: str) -> DataFrame:
    return rows.select(
        "event_key",
        U.opaque_identity(F.lit(runtime), F.col("session_id")).alias("session_key"),
        F.lit(runtime).alias("runtime"), "provider", "model", "output_tokens", "start",
        F.coalesce("end", "stamp").alias("end"), F.lit("native_log").alias("basis"),
        F.when(F.col("start").isNull(), F.lit("missing_timing")).otherwise(F.lit("measured")).alias("status"),
    )


def assistant_messages(records: DataFrame) -> DataFrame:
    """Message ids with the conversation each was seen in."""
    return records.where((F.col("r.type") == "assistant") & (F.col("r.sessionId") != "")).select(
        F.col("r.message.id").alias("message_id"), F.col("r.sessionId").alias("session_id")
    ).where("message_id IS NOT NULL").distinct()


def conversation_dirs(records: DataFrame) -> DataFrame:
    return records.select(F.col("r.sessionId").alias("session_id"), F.col("r.cwd").alias("cwd")).where(
        "session_id IS NOT NULL AND cwd IS NOT NULL"
    ).distinct()


def custom_titles(records: DataFrame) -> DataFrame:
    """The last title a conversation saved in its own log."""
    own = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    titled = records.where(
        (F.col("r.type") == "custom-title") & (F.col("r.sessionId") == own) & (F.trim("r.customTitle") != "")
    )
    return titled.groupBy(F.col("r.sessionId").alias("session_id")).agg(F.max_by("r.customTitle", "ordinal").alias("title"))


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Small files below a path, one row each: file, value."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("file"), "value")


def titles_of_files(files: DataFrame) -> DataFrame:
    """Titles of files that each lie in the folder of their conversation."""
    title = F.from_json("value", "customTitle string")["customTitle"]
    return files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("session_id"), title.alias("title"), "file").where(
        F.trim("title") != ""
    )


def title_files(spark: SparkSession, path: str) -> DataFrame:
    """Titles kept one per file in the conversation's folder."""
    return titles_of_files(read_files(spark, path, "custom-title.json"))


def titles_of_desktop(files: DataFrame) -> DataFrame:
    """Titles and directories of files that each describe one conversation; what is no object describes none."""
    talk = files.select(F.from_json("value", "cliSessionId string, title string, originCwd string, cwd string").alias("t"))
    directory = F.coalesce(F.nullif(F.col("t.originCwd"), F.lit("")), "t.cwd")
    return talk.select(F.col("t.cliSessionId").alias("session_id"), "t.title", directory.alias("cwd")).where("session_id IS NOT NULL")


def desktop_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles and directories the desktop app keeps, one file per conversation."""
    return titles_of_desktop(read_files(spark, path, "*.json"))


def newest_state(spark: SparkSession, path: str, pattern: str = "*") -> tuple[int, str] | None:
    """(version, path) of the state table whose name ends in the greatest number; of equal ones the last by name.

    A table is a file, or a folder of part files. Files are listed and not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    state = F.regexp_replace("path", r"/part-[^/]*$", "")
    number = F.regexp_extract(state, r"_(\d+)(?:\.[^/]*)?$", 1).try_cast("bigint")
    newest = files.agg(F.max(F.struct(F.coalesce(number, F.lit(-1)).alias("version"), state.alias("path"))).alias("s")).first().s
    return None if newest is None else (newest.version, newest.path)


def read_threads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Threads of the newest state table; older ones are not opened, and what only they hold is gone."""
    newest = newest_state(spark, path)
    if newest is None:
        return spark.createDataFrame([], "id string, name string, cwd string, parent_id string, version bigint")
    rows = spark.read.format(fmt).load(newest[1])
    have = set(rows.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    parent = F.get_json_object(text("source"), "$.subagent.thread_spawn.parent_thread_id")
    return rows.select(
        text("id").alias("id"), text("name").alias("name"), text("cwd").alias("cwd"),
        F.nullif(parent, F.lit("")).alias("parent_id"), F.lit(newest[0]).cast("bigint").alias("version"),
    )


def read_session_index(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    lines = read_lines(spark, path, pattern=pattern).where(F.trim("value") != "")
    entry = F.from_json("value", "id string, thread_name string")
    return lines.select(entry["id"].alias("id"), entry["thread_name"].alias("thread_name"), "ordinal").where(
        "id IS NOT NULL AND thread_name IS NOT NULL"
    )
