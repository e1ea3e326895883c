"""Registered queries over saved titles: of conversations and of threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.operators import enrich
from usagelens.session import materialize, new_path
from usagelens.sources import adapters, logs


def saved_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of conversations, from logs, title files and the desktop app.

    What a machine holds in one small file per conversation is landed as rows of path and text.
    """
    turns = adapters.table(spark, sf, "conversations").withColumn("sid", F.concat(F.lit("conv-"), "conv_id"))

    def landed(rows: DataFrame, folder: Column, name: Column, **fields: Column) -> DataFrame:
        value = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
        return rows.select(F.concat(folder, F.lit("/"), name).alias("file"), F.col("turn").alias("ordinal"), value.alias("value"))

    sid, text = F.col("sid"), F.col("text")
    # A line about another conversation than the file's gives no title.
    about = F.when(F.col("role") == "user", sid).otherwise(F.lit("another"))
    lines = landed(turns, F.lit("/p"), F.concat(sid, F.lit(".jsonl")), type=F.lit("custom-title"), sessionId=about, customTitle=text)
    own = landed(turns.where("turn = 2"), F.concat(F.lit("/p/"), sid), F.lit("custom-title.json"), customTitle=text)
    copies = turns.where("turn IN (3, 4)")
    app = landed(copies, F.lit("/app"), F.concat(sid, F.lit("-"), F.col("turn"), F.lit(".json")), cliSessionId=sid, title=F.substring(text, 1, 12))
    records = materialize(lines, "title_lines").select("file", "ordinal", F.from_json("value", schemas.LOG_B).alias("r"))
    files = logs.titles_of_files(materialize(own, "title_files"))
    desktop = logs.titles_of_desktop(materialize(app, "title_desktop"))
    return enrich.conversation_titles(logs.custom_titles(records), files, desktop)


def thread_states(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of threads from the newest of three state tables and from the index; sub-agents after their parents."""
    customers, folder, index = adapters.table(spark, sf, "customer"), new_path(spark, "states"), new_path(spark, "index")
    key = F.concat(F.lit("c"), F.col("c_custkey"))
    spawn = F.struct(F.concat(F.lit("c"), F.col("c_nationkey") + 1).alias("parent_thread_id"))
    source = F.when(F.col("c_mktsegment") == "BUILDING", F.to_json(F.struct(F.struct(spawn.alias("thread_spawn")).alias("subagent"))))
    threads = customers.select(
        key.alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(F.lit(" ")).alias("name"),
        F.col("c_address").alias("cwd") if "c_address" in customers.columns else F.lit(None).cast("string").alias("cwd"), source.alias("source"),
    )
    # Names end in a number, which counts as one: 10 is newer than 9. The one in between is no table at all.
    former = adapters.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    former.write.parquet(f"{folder}/state_4.parquet")
    former.select("name").write.text(f"{folder}/state_9.parquet")
    threads.write.parquet(f"{folder}/state_10.parquet")
    line = F.to_json(F.struct(key.alias("id"), F.concat(F.lit("Customer "), F.col("c_custkey")).alias("thread_name")))
    customers.where("c_acctbal < 1000").select(line.alias("value")).write.text(index)
    return enrich.thread_titles(logs.read_session_index(spark, index, "*.txt"), logs.read_threads(spark, folder))


QUERIES = {"saved_titles": saved_titles, "thread_states": thread_states}

ORACLES = {
    "saved_titles": """WITH told AS (
  SELECT conv_id, 0 AS rank, arg_max(text, turn) AS title, 'log' AS source FROM conversations
  WHERE role = 'user' AND trim(text) <> '' GROUP BY 1
  UNION ALL SELECT conv_id, 1, text, 'file' FROM conversations WHERE turn = 2 AND trim(text) <> ''
  UNION ALL SELECT conv_id, 2, min(substr(text, 1, 12)), 'desktop' FROM conversations
  WHERE turn IN (3, 4) AND trim(substr(text, 1, 12)) <> '' GROUP BY 1 HAVING count(DISTINCT substr(text, 1, 12)) = 1)
SELECT 'conv-' || conv_id AS session_id, arg_max(title, rank) AS title, arg_max(source, rank) AS source FROM told GROUP BY conv_id""",
    "thread_states": """WITH own AS (
  SELECT 'c' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'c' || (c_nationkey + 1) END AS parent,
    CASE WHEN c_acctbal >= 0 THEN c_name WHEN c_acctbal < 1000 THEN 'Customer ' || c_custkey END AS title FROM customer)
SELECT own.id AS session_id,
  CASE WHEN own.parent IS NULL THEN own.title ELSE 'Subagent of: ' || coalesce(p.title, 'Parent title unavailable') END AS title
FROM own LEFT JOIN own p ON p.id = own.parent WHERE own.parent IS NOT NULL OR own.title IS NOT NULL""",
}
