"""Bulk-run queries over orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import batch, flow
from tracewright.workspace import table


def batch_items(spark, d):
    return batch.numbered(table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), "o_orderkey")


def required_log_sources(spark, d):
    ids = table(spark, d, "part").select((F.col("p_partkey") * 7 % 8000).cast("string").alias("id"), F.col("p_partkey").alias("ord"))
    return batch.required_sources(ids).select("source", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))


def alarm_merge(spark, d):
    m = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("event"), F.col("l_returnflag").alias("technique"), F.col("l_linestatus").alias("level")).groupBy("l_orderkey", "event", "technique").agg(F.min("level").alias("level"))
    return batch.merged_alarm(m, ["l_orderkey"]).withColumn("events", F.array_join("events", ","))


def second_pass_candidates(spark, d):
    c = table(spark, d, "events").select("user_id", F.col("event_type").alias("technique")).distinct()
    bad = table(spark, d, "events").where("value > 485").select("user_id", F.col("event_type").alias("technique"))
    return batch.without_rejected(c, bad, ["user_id"])


def noise_classes(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 3 != 0).alias("kept"), F.concat_ws(" ", "event_type", "props").alias("t"))
    return batch.noise_counts(rows, {"nines": r'"k": 9\d', "errors": "^error", "views": "^view"}, "t")


def token_usage(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 100 + F.col("conv_id") % 7).alias("counter"))
    return batch.usage_deltas(c, "conv_id", "turn", "counter")


def evidence_for_reader(spark, d):
    p = table(spark, d, "orders")
    quotes = F.array(F.concat(F.lit("EventID="), "o_orderkey", F.lit(" User="), "o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("priority "), "o_orderpriority")))
    return p.select("o_orderkey", batch.evidence_text(F.array_compact(quotes), F.when(F.col("o_orderkey") % 5 == 0, "because"), F.lit("T1")).alias("evidence"))


def trusted_folders(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 4 == 0, "C:\\Windows\\System32\\").when(F.col("p_partkey") % 4 == 1, "D:/Program Files/x/").when(F.col("p_partkey") % 4 == 2, "C:\\Temp\\Windows\\System32\\").otherwise(""), F.lit("a.exe")).alias("path"))
    return p.select("p_partkey", text.trusted_folder(F.col("path")).alias("trusted"))


def bulk_incidents(spark, d):
    """Events as a log table, all the way to incidents, related within the operator's own window."""
    ids = {"click": "4688", "error": "4625", "purchase": "7045", "signup": "4720", "view": "4698"}
    of = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    k = F.get_json_object("props", "$.k")
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), of[F.col("event_type")].alias("EventID"), F.concat(F.lit("h"), k).alias("Hostname"), F.concat(F.lit("u"), "user_id").alias("SubjectUserName"), F.when(F.col("event_type") == "click", "C:\\Windows\\System32\\cmd.exe").alias("NewProcessName"))
    i = flow.incidents(rows)
    return i.select("n_rows", "first_ts", "last_ts", "phases", "score", "severity", "chain", F.array_join("techniques", ",").alias("techniques"), "host", "account", F.length("report").alias("report_chars"))


QUERIES = {f.__name__: f for f in (batch_items, required_log_sources, alarm_merge, second_pass_candidates, noise_classes, token_usage, evidence_for_reader, trusted_folders, bulk_incidents)}
ORACLE_SQL = {
    "batch_items": "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders WHERE o_orderstatus <> 'P'",
    "required_log_sources": "WITH i AS (SELECT p_partkey * 7 % 8000 AS id, min(p_partkey) AS ord FROM part GROUP BY 1), s AS (SELECT *, CASE WHEN id IN (4104) THEN 'PowerShell operational' WHEN id IN (400, 403, 104) THEN 'PowerShell classic' WHEN id = 1102 THEN 'Windows Security' WHEN id BETWEEN 1 AND 30 THEN 'Sysmon' WHEN id BETWEEN 4000 AND 5999 THEN 'Windows Security' WHEN id BETWEEN 7000 AND 7999 THEN 'Windows System' ELSE 'unknown' END AS source FROM i) SELECT source, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ord) AS ids FROM s GROUP BY 1",
    "alarm_merge": "WITH m AS (SELECT l_orderkey, l_linenumber AS event, l_returnflag AS technique, min(l_linestatus) AS level FROM lineitem GROUP BY ALL) SELECT l_orderkey, technique, arg_min(level, event) AS level, string_agg(CAST(event AS VARCHAR), ',' ORDER BY event) AS events FROM m GROUP BY ALL",
    "second_pass_candidates": "SELECT DISTINCT user_id, event_type AS technique FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 485",
    "noise_classes": """SELECT CASE WHEN regexp_matches(props, '"k": 9\\d') THEN 'nines' WHEN event_type = 'error' THEN 'errors' WHEN event_type = 'view' THEN 'views' ELSE 'other' END AS family, count(*) AS before, count(*) FILTER (event_id % 3 <> 0) AS after FROM events GROUP BY 1""",
    "token_usage": "WITH c AS (SELECT conv_id, turn, turn * 100 + conv_id % 7 AS total FROM conversations) SELECT conv_id, turn, total - coalesce(lag(total) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS added, total FROM c",
    "evidence_for_reader": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'priority ' || o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'because' ELSE 'EventID=' || o_orderkey || ' User=' || o_custkey END AS evidence FROM orders",
    "trusted_folders": "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS trusted FROM part",
}
