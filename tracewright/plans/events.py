"""Normalisation queries over documents, events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import normalise, report
from tracewright.workspace import table


def _texts(spark, d):
    c = F.concat
    t = c(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 1, " ran schtasks.exe /S host").when(F.col("doc_id") % 7 == 2, " in /etc/cron by bash").when(F.col("doc_id") % 7 == 3, " launchd osascript").otherwise(""))
    return table(spark, d, "documents").select("doc_id", t.alias("t"))


def platform_detection(spark, d):
    x = _texts(spark, d).withColumn("id", F.when(F.col("doc_id") % 10 == 0, "4688"))
    return x.select("doc_id", normalise.platform(F.col("id"), F.col("t")).alias("platform"))


def tool_detection(spark, d):
    x = _texts(spark, d).select("doc_id", F.array_join(normalise.tools(F.col("t")), ",").alias("tools"), normalise.is_remote(F.col("t")).alias("remote"))
    return x.groupBy("tools", "remote").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def grouped_timeline(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("row"), "ts", F.concat_ws(" ", "event_type", "props").alias("sentence"))
    return normalise.grouped_timeline(e, ["user_id"]).select("user_id", "sentence", "n", "first_ts", "last_ts", F.array_join("rows", ",").alias("rows"))


def event_sentence(spark, d):
    f = F.create_map(F.lit("process.name"), F.col("event_type"), F.lit("object.name"), F.when(F.col("event_id") % 3 != 0, F.col("props")))
    return table(spark, d, "events").select("event_id", report.sentence(f, F.lit("touched")).alias("sentence"))


def technique_sentences(spark, d):
    """What happened in the first row of each user's techniques, by the fields that say most about such an event."""
    e = table(spark, d, "events")
    ids = F.when(F.col("event_type") == "click", "4663").when(F.col("event_type") == "error", "4625").when(F.col("event_type") == "purchase", "5156").when(F.col("event_type") == "view", "4672").otherwise("99")
    some = lambda n, c: F.when(F.col("event_id") % n == 0, c)
    k = F.col("event_id").cast("string")
    cells = {"event.id": ids, "process.name": some(2, F.concat(F.lit("C:\\Dir x\\p"), k, F.lit(".exe"))), "account.name": some(3, F.concat(F.lit("user"), k)), "object.name": some(5, F.repeat(F.concat(F.lit("key  "), k), 9)), "destination.ip": some(2, F.lit("::1")), "destination.port": some(4, F.lit("443")), "source.ip": some(7, F.lit("10.0.0.1"))}
    rows = e.select(F.col("event_id").alias("row"), F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c)]).alias("fields"))
    return report.technique_sentences(e.select("user_id", F.col("event_type").alias("technique"), F.col("event_id").alias("row"), "ts"), rows, ["user_id"])


_T = "t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 7 WHEN 1 THEN ' ran schtasks.exe /S host' WHEN 2 THEN ' in /etc/cron by bash' WHEN 3 THEN ' launchd osascript' ELSE '' END AS t FROM documents)"
_N = {p: " + ".join(f"CAST(contains(lower(t), '{w}') AS INTEGER)" for w in ws) for p, ws in normalise.PLATFORMS.items()}
QUERIES = {f.__name__: f for f in (platform_detection, tool_detection, grouped_timeline, event_sentence, technique_sentences)}
ORACLE_SQL = {
    "technique_sentences": r"""WITH f AS (SELECT user_id, event_type AS technique, min(event_id) AS k, min(ts) AS ts FROM events GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'p' || k || '.exe' END AS pr, CASE WHEN k % 3 = 0 THEN 'user' || k END AS ac, CASE WHEN k % 5 = 0 THEN repeat('key ' || k, 9) END AS ob, CASE WHEN k % 7 = 0 THEN '10.0.0.1' END AS si, CASE WHEN k % 4 = 0 THEN '[::1]:443' WHEN k % 2 = 0 THEN '::1' END AS di FROM f),
w AS (SELECT *, CASE technique WHEN 'click' THEN coalesce(pr, ac) WHEN 'error' THEN ac WHEN 'purchase' THEN pr WHEN 'view' THEN ac END AS who, CASE technique WHEN 'click' THEN CASE WHEN length(ob) > 70 THEN rtrim(left(ob, 67)) || '...' ELSE ob END WHEN 'error' THEN si WHEN 'purchase' THEN coalesce(di, si) END AS what FROM p)
SELECT user_id, technique, concat_ws(', ', concat_ws(' ', strftime(ts, '%H:%M'), concat_ws(' > ', who, what)), CASE technique WHEN 'click' THEN 'object accessed' WHEN 'purchase' THEN 'network connection made' END) || CASE technique WHEN 'click' THEN ' (4663)' WHEN 'error' THEN ' (4625)' WHEN 'purchase' THEN ' (5156)' ELSE ' (4672)' END AS sentence FROM w WHERE technique <> 'signup' AND (who IS NOT NULL OR what IS NOT NULL)""",
    "platform_detection": f"WITH {_T}, n AS (SELECT doc_id, {', '.join(f'{c} AS {p}' for p, c in _N.items())} FROM t) SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Windows' WHEN greatest(Windows, Linux, macOS) = 0 THEN NULL WHEN Windows = greatest(Windows, Linux, macOS) THEN 'Windows' WHEN Linux = greatest(Windows, Linux, macOS) THEN 'Linux' ELSE 'macOS' END AS platform FROM n",
    "tool_detection": f"WITH {_T}, x AS (SELECT doc_id, concat_ws(',', {', '.join(f'''CASE WHEN regexp_matches(t, '(?i)\\b{x.removesuffix('.exe')}(\\.exe)?\\b') THEN '{x}' END''' for x in normalise.TOOLS)}) AS tools, {' OR '.join(f'''contains(lower(t), '{w}')''' for w in normalise.REMOTE)} AS remote FROM t) SELECT tools, remote, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM x GROUP BY ALL",
    "grouped_timeline": "SELECT user_id, event_type || ' ' || props AS sentence, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS rows FROM events GROUP BY 1, 2",
    "event_sentence": "SELECT event_id, event_type || ' touched' || CASE WHEN event_id % 3 <> 0 THEN ' ' || props ELSE '' END AS sentence FROM events",
}
