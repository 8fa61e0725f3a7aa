"""Correlation and incident queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import batch, correlate, incident, report
from tracewright.workspace import table

# A phase or two for each event type, so that the chain has something to place.
TACTICS_OF = {"click": ["Execution"], "error": ["Impact", "Credential Access"], "purchase": ["Exfiltration"], "signup": ["Persistence", "Initial Access"], "view": ["Discovery"]}
_PRIMARY = {"click": ("Execution", 4), "error": ("Credential Access", 9), "purchase": ("Exfiltration", 14), "signup": ("Initial Access", 3), "view": ("Discovery", 10)}
_PRIMARY_SQL = "(VALUES " + ", ".join(f"('{k}', '{t}', {p})" for k, (t, p) in _PRIMARY.items()) + ") m(event_type, tactic, phase)"
_ALL_SQL = "(VALUES " + ", ".join(f"('{k}', '{t}', {incident.TACTICS.index(t) + 1})" for k, v in TACTICS_OF.items() for t in v) + ") m(event_type, tactic, phase)"
_ISLANDS = """
e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 24 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e)
"""


def _events(spark, d):
    return table(spark, d, "events")


def _islands(spark, d):
    return correlate.islands(_events(spark, d), ["user_id"], "ts", "event_id")


def _entries(spark, d):
    return _islands(spark, d).select("user_id", "island", F.col("event_type").alias("technique"), F.col("event_id").alias("row"), F.col("event_id").alias("ord"), "ts", F.round(F.col("value") / 500, 4).alias("score"), F.lit(None).cast("string").alias("level"), F.array(F.col("props")).alias("evidence"))


def incidents_by_user(spark, d):
    i = _islands(spark, d).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("event_id").alias("first_row"))
    score = F.least(F.lit(100), 15 * F.col("n_types") + F.least(F.col("n"), F.lit(25)))
    return i.where("n >= 2").withColumn("score", score.cast("int")).withColumn("severity", incident.severity(F.col("score")))


def technique_dedup(spark, d):
    t = incident.dedupe_techniques(_entries(spark, d), ["user_id"])
    return t.select("user_id", "technique", "occurrences", "n_rows", "first_seen", "max_score", "representative", F.array_join("evidence", "|").alias("evidence"))


def strong_weak_split(spark, d):
    t = incident.dedupe_techniques(_entries(spark, d), ["user_id", "island"])
    s = t.withColumn("strong", incident.is_strong(F.col("level"), F.col("max_score")))
    return s.groupBy("user_id", "island").agg(F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"))


def _techniques(spark, d):
    tactics_of = F.create_map(*[x for k, v in TACTICS_OF.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    t = incident.dedupe_techniques(_entries(spark, d), ["user_id", "island"])
    return t.withColumn("tactics", tactics_of[F.col("technique")]).withColumn("score", F.col("max_score"))


def attack_chain_primary(spark, d):
    c = incident.attack_chain(_techniques(spark, d), ["user_id", "island"])
    return c.select("user_id", "island", "phase", "tactic", F.array_join("techniques", ",").alias("techniques"))


def chain_diagrams(spark, d):
    """A flow chart of each incident's phases."""
    c = incident.attack_chain(_techniques(spark, d), ["user_id", "island"])
    return report.chain_diagram(c, ["user_id", "island"]).select("user_id", "island", F.md5(F.col("diagram").cast("binary")).alias("digest"), F.length("diagram").alias("size"))


def incident_ids(spark, d):
    """Orders by customer as incidents, numbered in the order of their first row."""
    i = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("incident"), F.count("*").alias("n"))
    return batch.incident_ids(i).select("id", "incident", "n")


def attack_chain_all(spark, d):
    c = incident.attack_chain(_techniques(spark, d), ["user_id", "island"], primary_only=False)
    return c.select("user_id", "island", "phase", "tactic", F.array_join("techniques", ",").alias("techniques"))


def incident_risk(spark, d):
    strong = _techniques(spark, d).where(incident.is_strong(F.col("level"), F.col("max_score")))
    return incident.risk_scores(strong, ["user_id", "island"])


def incident_timeline(spark, d):
    return incident.timeline(_entries(spark, d), ["user_id", "island"])


def incident_primary_customer(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return incident.most_common(o, ["o_orderpriority", "o_orderstatus"], "o_custkey", "o_orderkey")


def rule_params(spark, d):
    hits = _islands(spark, d).select("user_id", "island", F.col("event_id").alias("row"), "ts", F.col("event_type").alias("id"), F.col("props").alias("host"), F.col("user_id").cast("string").alias("user"))
    return incident.rule_parameters(hits, ["user_id", "island"]).withColumn("ids", F.array_join("ids", ",")).drop("processes", "correlate_value")


def _components(spark, d, lineage=False, **window):
    e = _events(spark, d)
    items = e.select(F.col("event_id").alias("row"), "ts", F.col("user_id").cast("string").alias("user"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("type_k"))
    if lineage:
        pid = lambda of, n: F.when(F.col("event_type") == of, F.pmod("user_id", F.lit(n)).cast("string"))
        items = e.select(F.col("event_id").alias("row"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"), F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k")).alias("process_guid"), F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k")).alias("parent_process_guid"), pid("signup", 7).alias("process_id"), pid("error", 7).alias("parent_process_id"), F.lit(None).cast("string").alias("none"))
        g = correlate.incident_groups(items, ["none"], **window)
    else:
        g = correlate.incident_groups(items, ["user", "type_k"], lineage=False, **window)
    return g.groupBy("incident").agg(F.count("*").alias("n"), F.max("row").alias("last_row"), F.sum("row").alias("sum_rows"))


def incident_components(spark, d):
    """Relations within three minutes only: its SQL compares pairs."""
    return _components(spark, d, hours=0.05)


def lineage_components(spark, d):
    """Parents and children alone, by GUID and by process id, within a minute and a half; every 97th row has no time."""
    return _components(spark, d, lineage=True, hours=0.025)


def incident_components_day(spark, d):
    """All relations within the operator's own window."""
    return _components(spark, d)


def ioc_distinct(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    p = table(spark, d, "pages").select(F.lit(0).alias("inc"), F.col("page_id").alias("ord"), F.lit("host").alias("kind"), host.alias("value"))
    return incident.distinct_indicators(p, ["inc"]).select("kind", "value", "n")


def reputation_lookup_quota(spark, d):
    """The first ten hosts in order of first sight, and whether a cached reputation spares the look-up."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    seen = table(spark, d, "pages").select("page_id", host.alias("host")).where("host <> ''").groupBy("host").agg(F.min("page_id").alias("first_page"))
    return seen.orderBy("first_page", "host").limit(10)


_SCORED = f"""WITH {_ISLANDS},
t AS (SELECT user_id, island, event_type AS technique, max(round(value / 500, 4)) AS score FROM i GROUP BY ALL),
c AS (SELECT t.*, m.tactic, m.phase FROM t JOIN {_PRIMARY_SQL} ON m.event_type = t.technique)"""

QUERIES = {f.__name__: f for f in (incidents_by_user, technique_dedup, strong_weak_split, attack_chain_primary, chain_diagrams, incident_ids, attack_chain_all, incident_risk, incident_timeline, incident_primary_customer, rule_params, incident_components, lineage_components, incident_components_day, ioc_distinct, reputation_lookup_quota)}
ORACLE_SQL = {
    "incidents_by_user": f"""WITH {_ISLANDS}, g AS (SELECT user_id, island, count(*) AS n, count(DISTINCT event_type) AS n_types, min(ts) AS first_ts, max(ts) AS last_ts, min(event_id) AS first_row FROM i GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT *, CAST(least(100, 15 * n_types + least(n, 25)) AS INTEGER) AS score FROM g)
SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS severity FROM s""",
    "technique_dedup": """WITH e AS (SELECT user_id, event_type AS technique, event_id, ts, props, round(value / 500, 4) AS score FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, technique ORDER BY score DESC, event_id) AS r FROM e),
q AS (SELECT user_id, technique, props, min(event_id) AS f FROM e GROUP BY ALL), q5 AS (SELECT *, row_number() OVER (PARTITION BY user_id, technique ORDER BY f) AS n FROM q),
v AS (SELECT user_id, technique, string_agg(props, '|' ORDER BY n) AS evidence FROM q5 WHERE n <= 5 GROUP BY ALL)
SELECT b.user_id, b.technique, count(*) AS occurrences, count(DISTINCT event_id) AS n_rows, min(ts) AS first_seen, max(score) AS max_score, max(CASE WHEN r = 1 THEN event_id END) AS representative, any_value(v.evidence) AS evidence
FROM b JOIN v USING (user_id, technique) GROUP BY b.user_id, b.technique""",
    "strong_weak_split": f"WITH {_ISLANDS}, t AS (SELECT user_id, island, event_type, max(round(value / 500, 4)) AS s FROM i GROUP BY ALL) SELECT user_id, island, count(*) FILTER (s >= 0.5) AS strong, count(*) FILTER (s < 0.5) AS weak FROM t GROUP BY ALL",
    "attack_chain_primary": f"WITH {_ISLANDS} SELECT user_id, island, CAST(phase AS INTEGER) AS phase, tactic, string_agg(DISTINCT i.event_type, ',' ORDER BY i.event_type) AS techniques FROM i JOIN {_PRIMARY_SQL} USING (event_type) GROUP BY ALL",
    "chain_diagrams": f"""WITH {_ISLANDS}, c AS (SELECT user_id, island, phase, tactic, list(DISTINCT i.event_type ORDER BY i.event_type) AS t FROM i JOIN {_PRIMARY_SQL} USING (event_type) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY phase, tactic) - 1 AS k FROM c),
b AS (SELECT user_id, island, k, '  subgraph p' || k || '["' || tactic || '"]' || chr(10) || array_to_string([('    p' || k || 't' || (x - 1) || '["' || t[x] || '"]') FOR x IN range(1, len(t) + 1)], chr(10)) || chr(10) || '  end' || CASE WHEN k > 0 THEN chr(10) || '  p' || (k - 1) || ' --> p' || k ELSE '' END AS s FROM p),
d AS (SELECT user_id, island, 'flowchart TD' || chr(10) || string_agg(s, chr(10) ORDER BY k) AS diagram FROM b GROUP BY ALL)
SELECT user_id, island, md5(diagram) AS digest, CAST(length(diagram) AS INTEGER) AS size FROM d""",
    "incident_ids": "WITH i AS (SELECT min(o_orderkey) AS incident, count(*) AS n FROM orders GROUP BY o_custkey) SELECT 'INC-' || row_number() OVER (ORDER BY incident) AS id, incident, n FROM i",
    "attack_chain_all": f"WITH {_ISLANDS} SELECT user_id, island, CAST(phase AS INTEGER) AS phase, tactic, string_agg(DISTINCT i.event_type, ',' ORDER BY i.event_type) AS techniques FROM i JOIN {_ALL_SQL} USING (event_type) GROUP BY ALL",
    "incident_risk": f"""{_SCORED}, g AS (SELECT user_id, island, count(DISTINCT tactic) AS phases, count(DISTINCT tactic) FILTER (tactic IN ({", ".join(repr(x) for x in incident.HIGH_RISK)})) AS high, count(*) AS n_techniques, avg(score) AS mean FROM c WHERE score >= 0.5 GROUP BY ALL),
s AS (SELECT user_id, island, phases, n_techniques, CAST(greatest(0, least(100, round_even(round(30.0::DOUBLE * phases / 15 + least(15 * high, 30) + least(3 * n_techniques, 20) + 20 * mean, 6), 0))) AS INTEGER) AS score FROM g)
SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS severity FROM s""",
    "incident_timeline": f"WITH {_ISLANDS} SELECT user_id, island, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS INTEGER) AS place, event_id AS row, ts, event_type AS technique FROM i",
    "incident_primary_customer": "WITH c AS (SELECT o_orderpriority, o_orderstatus, o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT o_orderpriority, o_orderstatus, o_custkey, n FROM c QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY n DESC, f) = 1",
    "rule_params": f"""WITH {_ISLANDS}, g AS (SELECT user_id, island, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS ids, count(DISTINCT event_type) AS k, count(DISTINCT props) AS hosts, count(DISTINCT event_id) AS n, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS span FROM i GROUP BY ALL)
SELECT user_id, island, ids, CASE WHEN hosts = 1 THEN 'host' ELSE 'user' END AS correlate_by, CAST(greatest(15, least(1440, floor(span / 60 * 1.5) + 1)) AS INTEGER) AS window_minutes, CAST(least(n, 3) AS INTEGER) AS threshold FROM g WHERE k >= 2""",
    # the pairwise definition, and the labels that reach each row
    "incident_components": """WITH RECURSIVE k AS (SELECT event_id AS row, ts, 'u' || user_id AS key FROM events UNION ALL SELECT event_id, ts, 't' || event_type || ':' || json_extract_string(props, '$.k') FROM events),
b AS (SELECT DISTINCT x.row AS a, y.row AS b FROM k x JOIN k y ON x.key = y.key AND x.row <> y.row AND y.ts BETWEEN x.ts - INTERVAL 180 SECOND AND x.ts + INTERVAL 180 SECOND),
r(row, label) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, r.label FROM r JOIN b ON r.row = b.a WHERE r.label < b.b),
m AS (SELECT row, min(label) AS incident FROM r GROUP BY row)
SELECT incident, count(*) AS n, max(row) AS last_row, CAST(sum(row) AS BIGINT) AS sum_rows FROM m GROUP BY incident""",
    "lineage_components": """WITH RECURSIVE e AS (SELECT event_id AS row, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, event_type, json_extract_string(props, '$.k') AS k, user_id % 7 AS pid FROM events),
x AS (SELECT p.row AS a, c.row AS b, p.ts AS s, c.ts AS t FROM e p JOIN e c ON p.event_type = 'click' AND c.event_type = 'view' AND p.k = c.k UNION ALL SELECT p.row, c.row, p.ts, c.ts FROM e p JOIN e c ON p.event_type = 'signup' AND c.event_type = 'error' AND p.pid = c.pid),
l AS (SELECT a, b FROM x WHERE s IS NULL OR t IS NULL OR abs(epoch_us(s) - epoch_us(t)) <= 90000000), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(row, label) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, r.label FROM r JOIN b ON r.row = b.a WHERE r.label < b.b),
m AS (SELECT row, min(label) AS incident FROM r GROUP BY row)
SELECT incident, count(*) AS n, max(row) AS last_row, CAST(sum(row) AS BIGINT) AS sum_rows FROM m GROUP BY incident""",
    "ioc_distinct": "WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS value FROM pages), c AS (SELECT *, lower(value) AS l FROM h WHERE value <> '') SELECT 'host' AS kind, arg_min(value, page_id) AS value, count(*) AS n FROM c GROUP BY l",
    "reputation_lookup_quota": "WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, page_id FROM pages) SELECT host, min(page_id) AS first_page FROM h WHERE host <> '' GROUP BY host ORDER BY first_page, host LIMIT 10",
}
