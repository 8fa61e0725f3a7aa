"""Parsing and rule queries over the general tables, put into the shape of logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import logparse, text
from tracewright.operators import normalise, rulebook, rules
from tracewright.operators.rules import Condition, Rule
from tracewright.sources import catalog
from tracewright.workspace import materialize, spread, table

_RULES = [
    Rule("T1", "Bulk purchase", "TA1", ("purchase",), (), ((Condition("value", r"^[2-4]\d\d"),),), 3, "high"),
    Rule("T1", "Bulk purchase", "TA1", ("purchase", "signup"), (), ((Condition("props", r'"k": 9\d'), Condition("value", r"^4\d\d\.")),), 1, "medium"),
    Rule("T2", "Failure", "TA2", ("error",), ("view",), (), 5, "medium"),
    Rule("T3", "Quiet look", "TA3", (), ("error", "purchase"), ((Condition("value", r"^\d\.", r"5$"),),), 1, "low"),
    Rule("T1685", "Impaired", "TA4", ("view",), (), ((Condition("value", r"^1"),),), 1, "high"),
]


def _rows(spark, d):
    e = table(spark, d, "events")
    v = lambda k, c: (F.lit(k), c.cast("string"))
    pairs = [v("EventID", F.col("event_type")), v("value", F.col("value")), v("props", F.col("props")), v("Message", F.when(F.col("event_id") % 3 == 0, "service was disabled").otherwise("nothing of note"))]
    return e.select(F.col("event_id").alias("row"), "user_id", "event_type", F.create_map(*[x for p in pairs for x in p]).alias("fields"))


def rules_findings(spark, d):
    f = rules.findings(_rows(spark, d), _RULES, ["user_id"], F.col("event_type"))
    return f.select("user_id", "technique", "level", "n_rows", "first_row", "last_row", "n_rules")


def review_findings(spark, d):
    look = [Rule("licensed", "licensed", "", (), (), ((Condition("Message", r"(?i)licen[cs]e"),), (Condition("Message", r"(?i)version\s+[23]"),)), 1, "low"), Rule("insult", "insult", "", (), (), ((Condition("Message", r"(?i)\b(idiot|moron)\b"),),), 2, "low")]
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.create_map(F.lit("Message"), F.coalesce("text", F.lit(""))).alias("fields"))
    f = rules.findings(rows, look, event_id=F.lit(None).cast("string"))
    return f.select("technique", "n_rows", "last_row")


def _word_rules(spark, d):
    """A table of rules, one for each word of five to nine letters in the conversations: by its length for any document, for those without a word, or for two languages alone."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(text.ascii_lower(F.col("text")), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w")).where("w rlike '^[a-z]{5,9}$'").distinct()
    kind, none = F.length("w") % 3, F.lit(None).cast("string")
    condition = F.struct(F.lit("Message").alias("field"), F.concat(F.lit(r"(?i)\b"), "w", F.lit(r"\b")).alias("must"), F.when(kind == 1, F.lit(r"(?i)\b(?:the|les)\b")).otherwise(none).alias("must_not"))
    required = F.when(kind == 2, F.array(F.lit("en"), F.lit("fr")))
    made = words.select(F.concat(F.lit("W-"), F.substring("w", 1, 1)).alias("technique"), F.col("w").alias("name"), F.lit("").alias("tactic"), required.alias("required"), F.lit(None).cast("array<string>").alias("forbidden"), F.array(F.array(condition)).alias("conditions"), F.lit(2).alias("min_events"), F.when(kind == 0, "low").otherwise("medium").alias("level"))
    return made.orderBy("name")


def rules_from_table(spark, d):
    """Some thousand rules of a table over all documents, merged by technique."""
    book = [r for part in rulebook.from_table(_word_rules(spark, d)) for r in part]
    rows = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").alias("row"), F.col("lang").alias("_lang"), F.create_map(F.lit("Message"), F.coalesce("text", F.lit(""))).alias("fields"))
    f = rules.findings(rows, book, event_id=F.col("_lang"))
    return f.select("technique", "level", "n_rows", "first_row", "last_row", "n_rules")


def polarity_classes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, " rule added").otherwise(""), F.when(F.col("doc_id") % 7 == 0, " was allowed").otherwise("")).alias("t"))
    return docs.groupBy(text.polarity(F.col("t")).alias("polarity")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def coverage_report(spark, d):
    need = [Rule("A", "a", "TA1", ("click", "download")), Rule("B", "b", "TA1", ("view",)), Rule("C", "c", "TA2", ("login", "logout")), Rule("D", "d", "TA3", ("error",))]
    c = rules.coverage(_rows(spark, d), need, F.col("event_type"))
    return c.select("tactic", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "assessable")


def log_source_range_join(spark, d):
    ids = table(spark, d, "orders").select((F.col("o_orderkey") % 8000).cast("string").alias("id"))
    return ids.groupBy(rules.log_source(F.col("id")).alias("source")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


_ASSETS = [("HKLM\\EN", "high", "a"), ("HKLM\\EN\\8", "critical", "b"), ("HKLM\\FR", "medium", "c"), ("HKLM\\EN\\825", "critical", "d"), ("HKLM\\ES", "noise", "e"), ("HKLM", "noise", "f")]


def prefix_longest_match(spark, d):
    lang, n = (F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/(\d+)", i) for i in (1, 2))
    paths = table(spark, d, "pages").select(F.col("page_id").alias("row"), F.concat(F.lit("HKEY_LOCAL_MACHINE\\\\"), lang, F.lit("/"), n).alias("path"))
    return rules.criticality(paths, _ASSETS).select("row", "level", "family")


def kv_serialize(spark, d):
    o = table(spark, d, "orders")
    t = logparse.serialised(o, {"o_orderkey": "EventID", "o_custkey": "SubjectUserName", "o_totalprice": "Price", "o_orderpriority": "CommandLine"})
    return o.select("o_orderkey", t.alias("raw"))


def kv_parse_roundtrip(spark, d):
    o = table(spark, d, "orders")
    raw = logparse.serialised(o, {"o_orderkey": "EventID", "o_custkey": "SubjectUserName", "o_orderstatus": "Hostname", "o_orderpriority": "CommandLine"})
    logs = materialize(o.select(F.col("o_orderkey").alias("event_id"), raw.alias("raw")), "logs")
    return logparse.parse_fields(logs).select("event_id", "name", "value", "in_schema")


def json_field_extract(spark, d):
    f = logparse.parse_fields(table(spark, d, "events").select("event_id", F.col("props").alias("raw")))
    return f.select("event_id", "name", "value", "in_schema", "format")


def alias_first_wins(spark, d):
    n = table(spark, d, "customer")
    raw = F.concat(F.lit("{Process Name="), "c_name", F.lit(", NewProcessName=late, Account Name=N/A, Odd Key="), "c_mktsegment", F.lit("}"))
    f = logparse.parse_fields(n.select(F.col("c_custkey").alias("event_id"), raw.alias("raw")))
    return f.select("event_id", "name", "value", "informative", "format")


def repeated_and_long(spark, d):
    """Logs of four formats with a repeated key or a value of tens of thousands of characters and words: what is left of each, as length and digest."""
    c = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), "c_name", "c_mktsegment"))
    many = F.repeat(F.concat("c_name", F.lit(" ")), 1500)
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"Image": "'), "c_name", F.lit('", "odd": "'), F.repeat("c_name", 1000), F.lit('", "Image": "'), "c_mktsegment", F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('EventID=1 CommandLine="'), many, F.lit('" Image='), "c_name"))
        .when(kind == 2, F.concat(F.lit("EventID=1 CommandLine="), many, F.lit("x=y Image="), "c_name"))
        .when(kind == 3, F.concat(F.lit("{Process Name="), many, F.lit(", Account Name="), "c_name", F.lit("}")))
        .otherwise(F.concat(F.lit("Process Name:  "), many, F.lit("\n\tAccount Name:  "), "c_name"))
    )
    f = logparse.parse_fields(c.select("event_id", raw.alias("raw")))
    return f.select("event_id", "name", F.length("value").cast("bigint").alias("size"), F.md5(F.col("value").cast("binary")).alias("digest"), "format")


def own_format(spark, d):
    """A format of the user's own, key|value|key|value, tried before all others: it also takes what would be key=value text."""
    cells = lambda raw: F.split(raw, r"\|")
    own = logparse.Format("bars", lambda raw: F.startswith(raw, F.lit("|")), lambda raw: text.let(cells(raw), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 2, F.lit(2)), lambda i: F.struct(F.get(c, i).alias("key"), F.get(c, i + 1).alias("value")))))
    p = table(spark, d, "part")
    bars = F.concat(F.lit("|Image|"), "p_name", F.lit("|size|"), F.col("p_size").cast("string"), F.lit("|x=y|"), "p_brand")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Image="), "p_name")).otherwise(bars)
    f = logparse.parse_fields(p.select(F.col("p_partkey").alias("event_id"), raw.alias("raw")), logparse.with_format(own, "json"))
    return f.select("event_id", "name", "value", "format")


def derived_basename(spark, d):
    raw = F.concat(F.lit("{Parent Process Path=C:\\Tools\\"), F.col("page_id").cast("string"), F.lit(".exe, Process Name=a.exe}"))
    f = logparse.parse_fields(table(spark, d, "pages").select(F.col("page_id").alias("event_id"), raw.alias("raw")))
    return f.where("name in ('parent.process.name', 'parent.process.path')").select("event_id", "name", "value")


def event_split(spark, d):
    s = logparse.split(table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("raw")))
    return s.groupBy("event_id", "rule").agg(F.count("*").alias("parts"), F.sum(F.length("text")).alias("chars"), F.max("under_split").alias("under_split"))


def access_mask_decode(spark, d):
    bits = text.mask_bits(text.mask_value(F.col("m")), "registry")
    l = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("0x"), F.hex(F.col("l_quantity").cast("bigint")))).otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("m"))
    return l.select("m", F.array_join(F.transform(bits, lambda b: b["name"]), "|").alias("names"), text.access_class(bits).alias("kind")).groupBy("m", "names", "kind").agg(F.count("*").alias("n"))


def discriminating_fields(spark, d):
    """Field values worth searching for: not ids, not plain numbers, four letters or more or with a blank, once each in any case."""
    p = table(spark, d, "part")
    long = p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(i).alias("ord"), F.substring(F.col(c).cast("string"), 1, 200).alias("value")) for i, (k, c) in enumerate([("part.id", "p_partkey"), ("part.name", "p_name"), ("part.type", "p_type"), ("part.size", "p_size"), ("part.brand", "p_brand")])])).alias("f")).select("p_partkey", "f.*")
    told = normalise.discriminating(long.select(F.col("p_partkey").alias("event_id"), "ord", "name", "value", F.lit(True).alias("in_schema"), F.lit(True).alias("informative")))
    return told.groupBy(F.col("event_id").alias("p_partkey")).agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])).alias("fields_"))


_SQL_BITS = catalog.MASKS["registry"] + catalog.MASKS["standard"]
QUERIES = {f.__name__: f for f in (rules_findings, rules_from_table, review_findings, polarity_classes, coverage_report, log_source_range_join, prefix_longest_match, kv_serialize, kv_parse_roundtrip, json_field_extract, alias_first_wins, repeated_and_long, own_format, derived_basename, event_split, access_mask_decode, discriminating_fields)}
ORACLE_SQL = {
    "rules_findings": """WITH r AS (
  SELECT 0 AS rule, 'T1' AS technique, 0 AS rank, 3 AS least, user_id, event_id FROM events WHERE event_type = 'purchase' AND regexp_matches(CAST(value AS VARCHAR), '^[2-4]\\d\\d')
  UNION ALL SELECT 1, 'T1', 1, 1, user_id, event_id FROM events WHERE event_type IN ('purchase', 'signup') AND (regexp_matches(props, '"k": 9\\d') OR regexp_matches(CAST(value AS VARCHAR), '^4\\d\\d\\.'))
  UNION ALL SELECT 2, 'T2', 1, 5, user_id, event_id FROM events WHERE event_type = 'error'
  UNION ALL SELECT 3, 'T3', 2, 1, user_id, event_id FROM events WHERE event_type NOT IN ('error', 'purchase') AND regexp_matches(CAST(value AS VARCHAR), '^\\d\\.') AND NOT regexp_matches(CAST(value AS VARCHAR), '5$')
  UNION ALL SELECT 4, 'T1685', 0, 1, user_id, event_id FROM events WHERE event_type = 'view' AND regexp_matches(CAST(value AS VARCHAR), '^1') AND event_id % 3 = 0),
k AS (SELECT user_id, rule FROM r GROUP BY user_id, rule HAVING count(*) >= max(least))
SELECT user_id, technique, ['high', 'medium', 'low'][min(rank) + 1] AS level, CAST(count(DISTINCT event_id) AS INTEGER) AS n_rows, min(event_id) AS first_row, max(event_id) AS last_row, count(DISTINCT rule) AS n_rules FROM r JOIN k USING (user_id, rule) GROUP BY user_id, technique""",
    "rules_from_table": r"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS w FROM conversations) WHERE regexp_matches(w, '^[a-z]{5,9}$')),
d AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS ws FROM documents),
t AS (SELECT doc_id, lang, list_contains(ws, 'the') OR list_contains(ws, 'les') AS barred, unnest(ws) AS w FROM d),
h AS (SELECT w, doc_id FROM t JOIN w USING (w) WHERE CASE length(w) % 3 WHEN 1 THEN NOT barred WHEN 2 THEN coalesce(lang IN ('en', 'fr'), false) ELSE true END),
k AS (SELECT w FROM h GROUP BY w HAVING count(DISTINCT doc_id) >= 2)
SELECT 'W-' || w[1] AS technique, CASE WHEN bool_or(length(w) % 3 > 0) THEN 'medium' ELSE 'low' END AS level, count(DISTINCT doc_id) AS n_rows, min(doc_id) AS first_row, max(doc_id) AS last_row, count(DISTINCT w) AS n_rules FROM h JOIN k USING (w) GROUP BY 1""",
    "review_findings": """SELECT 'licensed' AS technique, CAST(count(*) AS INTEGER) AS n_rows, max(doc_id) AS last_row FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e') AND regexp_matches(text, '(?i)version\\s+[23]') HAVING count(*) >= 1
UNION ALL SELECT 'insult', CAST(count(*) AS INTEGER), max(doc_id) FROM documents WHERE regexp_matches(text, '(?i)\\b(idiot|moron)\\b') HAVING count(*) >= 2""",
    "polarity_classes": f"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' rule added' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' was allowed' ELSE '' END AS t FROM documents),
p AS (SELECT doc_id, regexp_matches(t, '(?i){"|".join(catalog.ENFORCING)}') AS o, regexp_matches(t, '(?i){"|".join(catalog.BREAKING)}') AS b FROM d)
SELECT CASE WHEN o AND b THEN 'ambiguous' WHEN o THEN 'enforcing' WHEN b THEN 'breaking' ELSE 'neutral' END AS polarity, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM p GROUP BY 1""",
    "coverage_report": """WITH n AS (SELECT * FROM (VALUES ('TA1', 'click'), ('TA1', 'download'), ('TA1', 'view'), ('TA2', 'login'), ('TA2', 'logout'), ('TA3', 'error')) v(tactic, id)), s AS (SELECT DISTINCT event_type AS id, true AS seen FROM events)
SELECT tactic, coalesce(string_agg(n.id, ',' ORDER BY n.id) FILTER (seen), '') AS present, coalesce(string_agg(n.id, ',' ORDER BY n.id) FILTER (seen IS NULL), '') AS missing, count(seen) > 0 AS assessable FROM n LEFT JOIN s ON n.id = s.id GROUP BY tactic""",
    "log_source_range_join": "SELECT CASE WHEN id IN (4104) THEN 'PowerShell operational' WHEN id IN (400, 403, 104) THEN 'PowerShell classic' WHEN id = 1102 THEN 'Windows Security' WHEN id BETWEEN 1 AND 30 THEN 'Sysmon' WHEN id BETWEEN 4000 AND 5999 THEN 'Windows Security' WHEN id BETWEEN 7000 AND 7999 THEN 'Windows System' ELSE 'unknown' END AS source, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT o_orderkey % 8000 AS id FROM orders) GROUP BY 1",
    "prefix_longest_match": r"""WITH p AS (SELECT page_id AS row, 'HKLM\' || upper(regexp_extract(url, '^https?://[^/]+/([a-z]+)/(\d+)', 1)) || '\' || regexp_extract(url, '^https?://[^/]+/([a-z]+)/(\d+)', 2) AS path FROM pages),
a AS (SELECT * FROM (VALUES ('HKLM\EN', 'high', 'a'), ('HKLM\EN\8', 'critical', 'b'), ('HKLM\FR', 'medium', 'c'), ('HKLM\EN\825', 'critical', 'd'), ('HKLM\ES', 'noise', 'e')) v(pattern, level, family)),
j AS (SELECT p.row, level, family, row_number() OVER (PARTITION BY p.row ORDER BY length(pattern) DESC) AS r FROM p LEFT JOIN a ON path = pattern OR starts_with(path, pattern || '\'))
SELECT row, coalesce(level, 'unknown') AS level, family FROM j WHERE r = 1""",
    "kv_serialize": """SELECT o_orderkey, 'EventID=' || o_orderkey || ' SubjectUserName=' || o_custkey || ' Price=' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') || ' CommandLine=' || CASE WHEN regexp_matches(o_orderpriority, '\\s') THEN '"' || o_orderpriority || '"' ELSE o_orderpriority END AS raw FROM orders""",
    "kv_parse_roundtrip": """SELECT o_orderkey AS event_id, 'event.id' AS name, CAST(o_orderkey AS VARCHAR) AS value, true AS in_schema FROM orders UNION ALL SELECT o_orderkey, 'account.name', CAST(o_custkey AS VARCHAR), true FROM orders UNION ALL SELECT o_orderkey, 'process.command_line', o_orderpriority, true FROM orders UNION ALL SELECT o_orderkey, 'host.name', o_orderstatus, true FROM orders""",
    "json_field_extract": "SELECT event_id, 'unknown.k' AS name, json_extract_string(props, '$.k') AS value, false AS in_schema, 'json' AS format FROM events",
    "alias_first_wins": "SELECT c_custkey AS event_id, 'process.name' AS name, c_name AS value, true AS informative, 'brace_kv' AS format FROM customer UNION ALL SELECT c_custkey, 'account.name', 'N/A', false, 'brace_kv' FROM customer UNION ALL SELECT c_custkey, 'unknown.Odd Key', c_mktsegment, false, 'brace_kv' FROM customer",
    "repeated_and_long": """WITH c AS (SELECT c_custkey AS event_id, c_custkey % 5 AS k, c_name, c_mktsegment, trim(repeat(c_name || ' ', 1500)) AS many FROM customer),
f AS (SELECT event_id, 'json' AS format, unnest(['process.name', 'unknown.odd']) AS name, unnest([c_mktsegment, repeat(c_name, 1000)]) AS value FROM c WHERE k = 0
UNION ALL SELECT event_id, 'space_kv', unnest(['event.id', 'process.command_line', 'process.name']), unnest(['1', many, c_name]) FROM c WHERE k = 1
UNION ALL SELECT event_id, 'space_kv', unnest(['event.id', 'process.command_line', 'process.name']), unnest(['1', many || ' x=y', c_name]) FROM c WHERE k = 2
UNION ALL SELECT event_id, 'brace_kv', unnest(['process.name', 'account.name']), unnest([many, c_name]) FROM c WHERE k = 3
UNION ALL SELECT event_id, 'windows_message', unnest(['process.name', 'account.name']), unnest([many, c_name]) FROM c WHERE k = 4)
SELECT event_id, name, length(value) AS size, md5(value) AS digest, format FROM f""",
    "own_format": """SELECT p_partkey AS event_id, 'process.name' AS name, p_name AS value, CASE WHEN p_partkey % 3 = 0 THEN 'space_kv' ELSE 'bars' END AS format FROM part
UNION ALL SELECT p_partkey, 'unknown.size', CAST(p_size AS VARCHAR), 'bars' FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'unknown.x=y', p_brand, 'bars' FROM part WHERE p_partkey % 3 > 0""",
    "derived_basename": r"SELECT page_id AS event_id, 'parent.process.path' AS name, 'C:\Tools\' || page_id || '.exe' AS value FROM pages UNION ALL SELECT page_id, 'parent.process.name', page_id || '.exe' FROM pages",
    "access_mask_decode": f"""WITH m AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN '0x' || upper(printf('%x', CAST(l_quantity AS BIGINT))) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS m, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
SELECT m, concat_ws('|', {", ".join(f"CASE WHEN v & {b} = {b} THEN '{n}' END" for b, n, _ in _SQL_BITS)}) AS names, CASE WHEN {" OR ".join(f"v & {b} = {b}" for b, _, k in _SQL_BITS if k == "write")} THEN 'write' WHEN {" OR ".join(f"v & {b} = {b}" for b, _, k in _SQL_BITS)} THEN 'read' ELSE 'unknown' END AS kind, count(*) AS n FROM m GROUP BY ALL""",
    "discriminating_fields": """WITH l AS (SELECT p_partkey, unnest([1, 2, 4]) AS ord, unnest([p_name, p_type, p_brand]) AS value FROM part),
g AS (SELECT * FROM l WHERE NOT regexp_matches(value, '^(0[xX])?[0-9A-Fa-f]+$') AND (length(value) >= 4 OR regexp_matches(value, '[\\s/\\\\]'))),
f AS (SELECT p_partkey, min(ord) AS ord, arg_min(value, ord) AS value FROM g GROUP BY p_partkey, lower(value))
SELECT p_partkey, string_agg(value, '|' ORDER BY ord) AS fields_ FROM f GROUP BY p_partkey""",
}
