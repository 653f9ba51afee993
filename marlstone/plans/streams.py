"""Registered queries that run as streams over a table; their SQL is that of the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import conversation, funnel


def stream_funnel(spark: SparkSession, sf: str) -> DataFrame:
    counts = funnel.windowed_funnel(funnel.read_events(spark, f"{sf}/events.parquet"))
    rows = funnel.run_updates(counts, funnel.scratch(spark, "funnel"), ["window", "event_type"])
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM_FUNNEL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events through keyed state: how many, and the errors in a row at their end."""
    events = funnel.read_table(spark, f"{sf}/events.parquet").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    rows = funnel.run_updates(funnel.session_state(events, "user_id", "failed", "event_id"), funnel.scratch(spark, "sessions"), ["user_id"])
    return rows.select("user_id", "n_turns", "failures")


STREAM_SESSIONS = """WITH l AS (SELECT user_id, max(event_id) FILTER (event_type IS DISTINCT FROM 'error') AS good FROM events GROUP BY user_id)
    SELECT user_id, count(*) AS n_turns, count(*) FILTER (event_id > coalesce(good, -1)) AS failures FROM events JOIN l USING (user_id) GROUP BY user_id"""

def stream_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as turns: what they wished, their last budgets and failures since their last silence of six hours."""
    conversation.state_store(spark)
    events, n = funnel.read_events(spark, f"{sf}/events.parquet"), F.col("event_id")
    turns = events.select(
        "user_id", "event_id", "ts", "event_type", (F.col("event_type") == "error").alias("failed"), F.concat(F.lit("c"), n % 4).alias("colour"), F.when(n % 3 == 0, F.concat(F.lit("o"), n % 5)).alias("occasion"),
        F.when(n % 2 == 0, F.round("value", 2)).alias("budget"),
    )
    told = conversation.conversations(turns, "user_id", "event_id", "ts", "failed", "event_type", ["colour", "occasion"], "budget")
    return funnel.run_updates(told, funnel.scratch(spark, "conversations"), ["user_id"])


STREAM_CONVERSATIONS = """WITH g AS (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 6 * 3600000 THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM g), l AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY user_id)),
    t AS (SELECT user_id, 'colour:c' || event_id % 4 AS t FROM l UNION ALL SELECT user_id, 'occasion:o' || event_id % 5 FROM l WHERE event_id % 3 = 0),
    c AS (SELECT user_id, string_agg(t || '=' || n, ';' ORDER BY t) AS tastes FROM (SELECT user_id, t, count(*) AS n FROM t GROUP BY ALL) GROUP BY user_id),
    b AS (SELECT user_id, list(printf('%.2f', round(value, 2)) ORDER BY event_id) AS b FROM l WHERE event_id % 2 = 0 AND round(value, 2) > 0 GROUP BY user_id),
    a AS (SELECT user_id, count(*) AS n_turns, coalesce(max(event_id) FILTER (event_type <> 'error'), -1) AS good, arg_max(event_type, event_id) AS intent FROM l GROUP BY user_id),
    f AS (SELECT user_id, count(*) FILTER (event_id > good) AS failures FROM l JOIN a USING (user_id) GROUP BY user_id)
    SELECT user_id, n_turns, failures, intent, tastes, coalesce(array_to_string(b[-10:], ';'), '') AS budgets FROM a JOIN f USING (user_id) JOIN c USING (user_id) LEFT JOIN b USING (user_id)"""

QUERIES = {"q_stream_conversations": (stream_conversations, STREAM_CONVERSATIONS), "q_stream_funnel": (stream_funnel, STREAM_FUNNEL), "q_stream_sessions": (stream_sessions, STREAM_SESSIONS)}
