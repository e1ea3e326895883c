"""Row rules: bad rows are set aside and counted, or stop the job in strict mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.usage import require

Rules = dict[str, Column]


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def _count(name: str) -> Column:
    return F.col(name) >= 0


def _text(name: str, limit: int) -> Column:
    return (F.col(name) != "") & (F.length(name) <= limit)


def archive_rules() -> Rules:
    return {
        "app": F.length("app") <= 512,
        "model": F.length("model") <= 512,
        "tokens": _count("tokens"),
        "requests": _count("requests"),
        "cost_usd": F.col("cost_usd") >= 0,
        "date": F.col("date").isNotNull(),
    }


def minute_rules() -> Rules:
    seconds = ("total_covered_s", "average_covered_s", "partial_s")
    rules = {name: finite(F.col(name)) & F.col(name).between(0, 60.001) for name in seconds}
    for name in ("total_integral", "average_integral"):
        rules[name] = finite(F.col(name)) & (F.col(name) >= 0)
    return {**rules, "minute": F.col("minute") % 60 == 0, "tokens": _count("tokens")}


def sample_rules() -> Rules:
    start, end = F.col("start"), F.col("end")
    return {
        "event_key": _text("event_key", 256),
        "session_key": F.col("session_key").isNull() | _text("session_key", 256),
        "output_tokens": F.col("output_tokens") > 0,
        "interval": finite(start) & finite(end) & (end > start),
        "end": end <= F.col("sampled_at") + 1,
    }


def pending_rules() -> Rules:
    return {
        # The ways a session can be pending.
        "status": F.col("status").isin("awaiting_usage", "missing_timing", "ambiguous_identity"),
        "session_key": F.col("session_key").isNull() | _text("session_key", 256),
    }


def with_broken_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """Add the names of the rules each row breaks; an unknown outcome breaks a rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("broken_rules", F.array_compact(F.array(*broken)))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with the rules they break."""
    judged = with_broken_rules(df, rules)
    return judged.where(F.size("broken_rules") == 0).drop("broken_rules"), judged.where(F.size("broken_rules") > 0)


def strict(df: DataFrame, rules: Rules, what: str) -> DataFrame:
    """All rows, or a failed job that names the broken rules."""
    judged = with_broken_rules(df, rules)
    message = F.concat(F.lit(f"Invalid {what}: "), F.array_join("broken_rules", ", "))
    return judged.where(require(F.size("broken_rules") == 0, message)).drop("broken_rules")


def broken_counts(df: DataFrame, rules: Rules) -> DataFrame:
    return (
        with_broken_rules(df, rules)
        .select(F.explode("broken_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
