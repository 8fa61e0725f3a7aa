"""Queries of the way from an event's text to its verdict and report, over general tables turned into events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.functions import logparse, text
from tracewright.operators import assess, batch, incident, normalise, report, retrieve, rules, triage
from tracewright.plans.incidents import _ISLANDS, _techniques
from tracewright.plans.retrieval import _COS, ORACLE_SQL as _RETRIEVAL_SQL
from tracewright.sources import catalog, readers
from tracewright.workspace import materialize, shared_dir, spread, table

_map = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("__", ".")), v)]), lambda k, v: v.isNotNull())


def _parts(spark, d):
    """Paths as fields, in command lines and in prose."""
    k = F.col("p_partkey")
    key = F.when(k % 4 == 0, F.concat(F.lit("HKLM\\SAM\\K"), k)).when(k % 4 == 1, F.concat(F.lit("HKLM\\SAMPLE\\K"), k)).when(k % 4 == 2, F.lit("-"))
    command = F.when(k % 8 == 2, F.concat(F.lit("reg.exe save HKLM\\SAM C:\\t"), k, F.lit(".hiv"))).when(k % 8 == 6, "echo HKLM")
    return table(spark, d, "part").select(k.alias("row"), _map(object__name=key, process__command_line=command, Message=F.concat(F.lit("HKLM\\SAM was read by "), "p_name")).alias("fields"))


def event_assets(spark, d):
    return triage.event_assets(_parts(spark, d))


def event_verdicts(spark, d):
    e = table(spark, d, "events")
    path = F.when(F.col("event_id") % 3 == 0, "HKLM\\SAM").when(F.col("event_id") % 3 == 1, "HKLM\\SYSTEM\\CurrentControlSet\\Services\\x")
    kind = F.when(F.col("event_type") == "error", "4657").otherwise("4663")
    who = F.when(F.col("user_id") % 2 == 0, "SYSTEM").otherwise("bob")
    rows = e.select(F.col("event_id").alias("row"), _map(event__id=kind, object__name=path, account__name=who, process__name=F.lit("C:\\Windows\\System32\\msiexec.exe")).alias("fields"))
    accepted = e.where("event_type = 'click'").select(F.col("event_id").alias("row"), F.lit("T1").alias("technique"))
    decisions = e.where("event_type in ('click', 'view')").select(F.col("event_id").alias("row"), F.lit("T1").alias("technique"), F.when(F.col("value") > 250, "confirm").otherwise("abstain").alias("verdict"))
    return triage.verdicts(rows, accepted, decisions).select("row", "verdict", "path", "suppressed", "techniques", "confirmed", "access")


def facts_extract(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat(F.lit("EventID=46"), F.col("o_orderkey") % 90 + 10, F.lit(" CommandLine=\"run "), "o_custkey", F.lit(" now\" User=u"), "o_custkey", F.lit(" User=other"))
    f = normalise.facts(raw)
    return o.select("o_orderkey", f["EventID"].alias("id"), f["CommandLine"].alias("command"), f["User"].alias("account"))


def _logs(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("EventID=4663 ObjectName=HKEY_LOCAL_MACHINE\\SAM\\K"), k, F.lit(" ProcessName=tool.exe AccountName="), F.when(k % 2 == 0, "tool.exe").otherwise("bob"), F.lit(" HandleId=0x10"))
    return spread(table(spark, d, "part").select(k.alias("event_id"), raw.alias("raw")))


def search_layers(spark, d):
    events = _logs(spark, d)
    fields = materialize(logparse.parse_fields(events), "fields")  # two layers read them
    return normalise.search_text(fields, events, logparse.rule_rows(events, fields))


def distinct_values(spark, d):
    fields = materialize(logparse.parse_fields(_logs(spark, d)), "fields")
    one = lambda mode: normalise.discriminating(fields, mode).groupBy("event_id").agg(F.count("*").alias(mode))
    return one("none").join(one("identical"), "event_id").join(one("contained"), "event_id")


def enriched_query(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", normalise.enriched(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "Windows"), F.col("user_id") % 2 == 0).alias("query"))


def nested_fill_gap(spark, d):
    """A message within a log gives what the outer log doesn't have, unless it says nothing."""
    o = table(spark, d, "orders")
    inner = F.concat(F.lit("Hostname=in"), "o_custkey", F.lit(" AccountName="), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("eve"))
    outer = F.concat(F.lit('{"EventID": "4624", '), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"Hostname": "out'), "o_custkey", F.lit('", '))).otherwise(""), F.lit('"Message": "'), inner, F.lit('"}'))
    f = logparse.parse_fields(o.select(F.col("o_orderkey").alias("event_id"), outer.alias("raw")))
    return f.where("name in ('host.name', 'account.name')").select("event_id", "name", "value", "format")


def message_fields(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat(F.lit("An event.\n\nSubject:\n  Account Name:  u"), "o_custkey", F.lit("  Logon ID:  0x"), F.hex("o_orderkey"), F.lit("\nProcess Information: \n  Process Name:  C:\\a b\\"), "o_orderpriority")
    f = logparse.parse_fields(o.select(F.col("o_orderkey").alias("event_id"), raw.alias("raw")))
    return f.select("event_id", "name", "value", "format")


def _payloads(spark, d):
    o = table(spark, d, "orders")
    tags = F.concat(F.lit("AgentDevice=x\tComputer=h"), F.col("o_custkey") % 50, F.lit("\tComputer=H"), F.col("o_custkey") % 7, F.lit("\tEventID=4624\tTimeGenerated="), (F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).cast("string"))
    return o.select("o_orderkey", F.concat(tags, F.lit("\tMessage=Logged on.  Account Name:  old  Source Address:  10.0.0."), F.col("o_custkey") % 9, F.lit("  New Account Name:  n"), "o_custkey", F.lit("  Account Name:  u"), "o_custkey").alias("payload"))


def payload_column_discovery(spark, d):
    df = _payloads(spark, d).select(F.col("o_orderkey").cast("string").alias("a"), F.lit("EventID=1").alias("b"), "payload", F.col("payload").alias("same"))
    return spark.createDataFrame([(readers.payload_column(df),)], "found string")


def export_payloads(spark, d):
    return readers.export_rows(_payloads(spark, d).select("payload")).groupBy("Timestamp", "EventID", "Hostname", "SubjectUserName", "SourceIp").agg(F.count("*").alias("n"))


def event_split_lines(spark, d):
    """Lines of key=value text, one of which goes on in the next because of a bracket."""
    o = table(spark, d, "orders")
    raw = F.concat(F.lit("EventID=1 a="), "o_orderkey", F.lit("\n\nEventID=2 b={\nx="), "o_custkey", F.lit("}\nEventID=3 c=1"))
    s = logparse.split(o.select(F.col("o_orderkey").alias("event_id"), raw.alias("raw")))
    return s.select("event_id", "part", "text", "rule", "markers", "under_split")


def indicator_categories(spark, d):
    e = table(spark, d, "events")
    is_ = lambda t, v: F.when(F.col("event_type") == t, v)
    rows = e.select(
        F.col("event_id").alias("row"), is_("click", "4688").alias("event_id"), is_("click", "C:\\x\\lsass.exe").alias("process"), is_("view", "certutil -urlcache http://x").alias("command_line"), is_("error", "10.0.0.1").alias("source_ip"), is_("error", "10.0.0.2").alias("destination_ip"),
        is_("signup", "svc").alias("service"), is_("view", "C:\\f").alias("file_path"), F.lit(None).cast("string").alias("target_image"), F.when(F.col("event_id") % 5 == 0, "HKLM\\x").alias("target_object"), F.lit(None).cast("string").alias("target_user"),
    )
    return incident.indicator_rows(rows).groupBy("category", "detail").agg(F.count("*").alias("n"), F.sum("row").alias("rows"))


def risk_sentences(spark, d):
    strong = _techniques(spark, d).where(incident.is_strong(F.col("level"), F.col("max_score")))
    return report.risk_breakdown(incident.risk_parts(strong, ["user_id", "island"])).select("user_id", "island", F.size("tactics").alias("n_tactics"), "coverage", "bonus", "volume", "sentences")


def rebuilt_incidents(spark, d):
    """Saved as lines of JSON, read back and made anew."""
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    readers.write_results(_techniques(spark, d).select("user_id", "island", "technique", "tactics", "level", "max_score"), path)
    saved = readers.read_results(spark, path, "user_id bigint, island bigint, technique string, tactics array<string>, level string, max_score double")
    return incident.rebuilt(saved, ["user_id", "island"])


def incident_summary(spark, d):
    t = _techniques(spark, d).withColumn("strong", incident.is_strong(F.col("level"), F.col("max_score")))
    spans = t.groupBy("user_id", "island").agg(F.sum("occurrences").alias("n_rows"), F.min("first_seen").alias("first_ts"), F.max("first_seen").alias("last_ts"), F.lit("h1").alias("host"), F.concat(F.lit("u"), F.first("user_id")).alias("account"))
    return report.summaries(t, spans, ["user_id", "island"])


def incident_reports(spark, d):
    by = ["user_id", "island"]
    t = _techniques(spark, d).withColumn("strong", incident.is_strong(F.col("level"), F.col("max_score")))
    strong = t.where("strong")
    spans = t.groupBy(*by).agg(F.sum("occurrences").alias("n_rows"), F.min("first_seen").alias("first_ts"), F.max("first_seen").alias("last_ts"), F.lit("h1").alias("host"), F.concat(F.lit("u"), F.first("user_id")).alias("account"))
    line = t.select(*by, F.col("representative").alias("place"), F.col("first_seen").alias("ts"), F.col("technique").alias("event_id"), F.get("evidence", F.lit(0)).alias("evidence"))
    found = t.select(*by, F.lit("process").alias("category"), F.col("technique").alias("detail"), F.col("occurrences").alias("n"))
    chain = report.chain_line(incident.attack_chain(strong, by), by)
    return report.incident_reports(spans, t, line, found, incident.risk_scores(strong, by), incident.risk_parts(strong, by), chain, by)


def incident_rule_drafts(spark, d):
    o = table(spark, d, "orders")
    hits = o.select("o_custkey", F.col("o_orderkey").alias("row"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("id"), F.concat(F.lit("C:\\Dir\\"), F.substring("o_orderpriority", 1, 1), F.lit(".EXE")).alias("process"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("h"), "o_custkey")).otherwise(F.col("o_orderkey").cast("string")).alias("host"), F.lit("bob").alias("user"))
    p = incident.rule_parameters(hits, ["o_custkey"]).withColumn("name", F.concat(F.lit("inc-"), "o_custkey"))
    return report.rule_draft(p).select("o_custkey", "draft")


def event_rule_drafts(spark, d):
    e = table(spark, d, "events")
    some = lambda n, v: F.when(F.col("event_id") % n == 0, v)
    rows = e.select("event_id", F.lit("T1").alias("technique"), F.col("event_type").alias("name"), some(2, F.lit("Windows")).alias("platform"), some(3, F.lit("C:\\a\\b.exe")).alias("process"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("net.exe"), F.lit("cmd.exe"))).otherwise(F.array().cast("array<string>")).alias("tools"), some(7, F.repeat(F.lit("x"), 100)).alias("command_line"), some(11, F.lit("10.1.1.1")).alias("remote_ip"), (F.col("event_id") % 13 == 0).alias("remote"), some(4, F.lit("bob")).alias("account"), F.col("event_id").alias("_k"), F.when(F.col("event_id") % 2 == 1, "low").otherwise("high").alias("level"))
    return report.event_rule_draft(rows.withColumn("event_id", some(6, F.lit("4688")))).select(F.col("_k").alias("event_id"), "draft")


def reviewer_meetings(spark, d):
    f = table(spark, d, "events").select("event_id", F.concat(F.lit("T"), F.col("user_id") % 5).alias("technique"))
    return triage.assigned(f, [("general", None), ("three", "T3"), ("four", "T4"), ("three-b", "T3")], ["event_id"]).groupBy("technique", "reviewer").agg(F.count("*").alias("n"))


def model_decisions(spark, d):
    c = table(spark, d, "customer")
    view = F.get(F.array(*map(F.lit, ["supports", " Weak", "absent", "odd", ""])), (F.col("c_custkey") % 5).cast("int"))
    x = triage.model_decision(view, F.when(F.col("c_custkey") % 7 != 0, "because"), F.get(F.array(*map(F.lit, rules.LEVELS)), (F.col("c_custkey") % 4).cast("int")))
    return c.select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


def added_techniques(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("technique"), "value")
    return triage.added_techniques(e.where("technique <> 'error' or value < 200 and user_id % 3 > 0"), e, ["user_id"])


def rule_diagnosis(spark, d):
    c = rules.Condition("CommandLine", "(?i)green", "(?i)red")
    return table(spark, d, "part").select("p_partkey", triage.diagnosis(c, F.create_map(F.lit("CommandLine"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")))).alias("why"))


def evidence_kept_and_missing(spark, d):
    p = table(spark, d, "part")
    facts = p.select(F.col("p_partkey").alias("row"), F.lit("CommandLine").alias("key"), F.concat(F.lit("winrs "), "p_brand").alias("value")).unionByName(p.where("p_size > 25").select(F.col("p_partkey").alias("row"), F.lit("Odd").alias("key"), F.col("p_type").alias("value")))
    m = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("row"), F.lit("T1021.006").alias("technique"), F.when(F.col("p_partkey") % 4 == 0, "used WINRM on port-5985").otherwise("winrs only").alias("text"))
    return triage.evidence_summary(facts, m).select("row", F.array_join("detected", "|").alias("detected"), F.array_join("missing", "|").alias("missing"))


def component_sets(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_regionkey").alias("event_id"), F.array("n_name", F.lit("Both")).alias("components"))
    b = n.where("n_nationkey > 10").select(F.col("n_regionkey").alias("event_id"), F.array(F.lit("Both"), F.upper(F.substring("n_name", 1, 2))).alias("components"))
    return triage.component_sets([a, b]).select("event_id", F.array_join("components", ",").alias("components"))


def _addresses(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(".", F.get(F.array(*map(F.lit, ["10", "8", "192", "172", "127", "9"])), (k % 6).cast("int")), F.when(k % 6 == 2, "168").when(k % 6 == 3, (k % 40).cast("string")).otherwise("1"), (k % 250).cast("string"), F.lit("7")).alias("value"))


def public_addresses(spark, d):
    return _addresses(spark, d).select("o_orderkey", "value", text.is_public_ip(F.col("value")).alias("public"))


def reputation_queue(spark, d):
    seen = _addresses(spark, d).withColumnRenamed("o_orderkey", "ord")
    return triage.lookup_queue(seen, seen.where("value like '8.1.1%'").select("value")).select("value", "first", "place")


def reputation_words(spark, d):
    s = F.get(F.array(*map(F.lit, ["ok", "rate_limited", "not_found", "disabled", "error"])), (F.col("s_suppkey") % 5).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", triage.reputation(F.when(F.col("s_suppkey") % 11 != 0, s), F.col("s_suppkey") % 3, F.col("s_suppkey") % 2).alias("words"))


def scope_reasons(spark, d):
    return table(spark, d, "part").select("p_partkey", triage.out_of_scope(F.col("p_type"), [("STEEL", "metal"), ("small", "size"), ("brass", "metal too")]).alias("reason"))


def asks_for_indicators(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", triage.names_any(F.col("text"), ["indicator", "Hash", "please"]).alias("asks"))


def required_terms(spark, d):
    t = F.when(F.col("p_partkey") % 3 == 0, "WMIC.exe /node").when(F.col("p_partkey") % 3 == 1, "Win32-Process made").otherwise("nothing")
    return table(spark, d, "part").select("p_partkey", assess.required_evidence(F.when(F.col("p_partkey") % 2 == 0, "T1047").otherwise("T9"), t).alias("enough"))


def refine_and_merge(spark, d):
    """Users whose first pass kept nothing or rejected something get a second; of one technique the first pass counts."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("technique"), "value")
    first = e.where("value < 100").groupBy("user_id", "technique").agg(F.max("value").alias("value"))
    n = e.groupBy("user_id").agg(F.count_if(F.col("value") < 100).alias("kept"), F.count_if(F.col("value") > 490).alias("rejected"))
    again = n.where(assess.should_refine(F.col("kept"), F.col("rejected"), F.lit(0))).select("user_id")
    second = e.join(again, "user_id").where("value between 200 and 300").groupBy("user_id", "technique").agg(F.max("value").alias("value"))
    return assess.second_pass(first, second, ["user_id", "technique"])


def bm25_saved_index(spark, d):
    """The postings written as an index, opened by their stamp, and asked."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    path, n = f"{shared_dir(spark)}/keyword-{uuid.uuid4().hex}", docs.count()
    readers.write_index(retrieve.postings(docs), path, {"chunks": n})
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25_of(queries, readers.open_index(spark, path, {"chunks": n}), n, 10)


def chat_history(spark, d):
    return retrieve.trimmed_history(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", 300).select("conv_id", "turn", "tokens")


def chat_budget(spark, d):
    return retrieve.budget_status(table(spark, d, "conversations").select("conv_id", "text"), ["conv_id"], 300)


def living_vectors(spark, d):
    """The nearest of those that are neither revoked nor deprecated."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") == 3).alias("revoked"), F.when(F.col("label") > 0, F.col("label") == 5).alias("deprecated"))
    return retrieve.nearest(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), retrieve.living(e).select("id", "v"), 5)


QUERIES = {f.__name__: f for f in (chat_history, chat_budget, living_vectors, event_assets, event_verdicts, facts_extract, search_layers, distinct_values, enriched_query, nested_fill_gap, message_fields, payload_column_discovery, export_payloads, event_split_lines, indicator_categories, risk_sentences, rebuilt_incidents, incident_summary, incident_reports, incident_rule_drafts, event_rule_drafts, reviewer_meetings, model_decisions, added_techniques, rule_diagnosis, evidence_kept_and_missing, component_sets, public_addresses, reputation_queue, reputation_words, scope_reasons, asks_for_indicators, required_terms, refine_and_merge, bm25_saved_index)}

_ADDRESS = "(['10', '8', '192', '172', '127', '9'])[o_custkey % 6 + 1] || '.' || CASE o_custkey % 6 WHEN 2 THEN '168' WHEN 3 THEN CAST(o_custkey % 40 AS VARCHAR) ELSE '1' END || '.' || o_custkey % 250 || '.7'"
_PUBLIC = "(o_custkey % 6 IN (1, 5) OR (o_custkey % 6 = 3 AND o_custkey % 40 NOT BETWEEN 16 AND 31))"
_HIGH = ", ".join(f"'{x}'" for x in incident.HIGH_RISK)
_PRIMARY = "(VALUES ('click', 'Execution', 4), ('error', 'Credential Access', 9), ('purchase', 'Exfiltration', 14), ('signup', 'Initial Access', 3), ('view', 'Discovery', 10)) m(event_type, tactic, phase)"
_T = f"{_ISLANDS}, t AS (SELECT user_id, island, event_type, count(*) AS occurrences, min(ts) AS first_seen, max(round(value / 500, 4)) AS score FROM i GROUP BY ALL), c AS (SELECT t.*, tactic, phase FROM t JOIN {_PRIMARY} USING (event_type))"
_NUM = "regexp_replace(printf('%.2f', CAST({0} AS DOUBLE)), '\\.?0+$', '')"
_TOKENS = "(CAST(floor(length(coalesce(text, '')) / 1.9::DOUBLE) AS BIGINT) + 1)"
ORACLE_SQL = {
    "chat_history": f"SELECT conv_id, turn, {_TOKENS} AS tokens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) QUALIFY sum({_TOKENS}) OVER w <= 300 OR row_number() OVER w = 1",
    "chat_budget": f"WITH t AS (SELECT conv_id, CAST(sum({_TOKENS}) AS BIGINT) AS total FROM conversations GROUP BY 1) SELECT conv_id, total, total <= 300 AS fits, greatest(total - 300, 0) AS overflow FROM t",
    "living_vectors": f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND coalesce(e.label, -1) NOT IN (3, 5)) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5",
    "event_assets": """SELECT p_partkey AS row, CASE p_partkey % 4 WHEN 0 THEN 'HKLM\\SAM\\K' || p_partkey WHEN 1 THEN 'HKLM\\SAMPLE\\K' || p_partkey WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN 'HKLM\\SAM' END END AS path,
CASE WHEN p_partkey % 4 = 0 OR p_partkey % 8 = 2 THEN 'critical' WHEN p_partkey % 4 = 1 THEN 'unknown' ELSE 'none' END AS level, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 8 = 2 THEN 'credential-hive' END AS family FROM part""",
    "event_verdicts": """WITH e AS (SELECT *, event_type = 'click' AS t, event_type = 'click' AND value > 250 AS c, event_id % 3 AS k, event_type = 'error' AS w FROM events)
SELECT event_id AS row, CASE WHEN c THEN 'SUFFICIENT_SUSPICIOUS' WHEN w AND k = 0 THEN 'SUFFICIENT_SUSPICIOUS' WHEN w AND k = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'SUFFICIENT_BENIGN' ELSE 'SUFFICIENT_SUSPICIOUS' END ELSE 'INSUFFICIENT_DATA' END AS verdict,
CASE WHEN c THEN 'A' WHEN w AND k IN (0, 1) THEN 'B' ELSE 'none' END AS path, (NOT c AND w AND k = 1 AND user_id % 2 = 0) AS suppressed, CAST(t AS BIGINT) AS techniques, CAST(c AS BIGINT) AS confirmed, CASE WHEN w THEN 'write' ELSE 'read' END AS access FROM e""",
    "facts_extract": "SELECT o_orderkey, '46' || (o_orderkey % 90 + 10) AS id, 'run ' || o_custkey || ' now' AS command, 'u' || o_custkey AS account FROM orders",
    "search_layers": """SELECT p_partkey AS event_id, 'HKEY_LOCAL_MACHINE\\SAM\\K' || p_partkey || ' HKLM\\SAM\\K' || p_partkey || ' tool.exe' || chr(10) || chr(10) || 'object accessed read File Access Windows Registry Key Access' || chr(10) || chr(10) || 'EventID=4663 ObjectName=HKEY_LOCAL_MACHINE\\SAM\\K' || p_partkey || ' ProcessName=tool.exe AccountName=' || CASE WHEN p_partkey % 2 = 0 THEN 'tool.exe' ELSE 'bob' END || ' HandleId=0x10' AS query FROM part""",
    "distinct_values": "SELECT p_partkey AS event_id, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS \"none\", 2::BIGINT AS identical, 2::BIGINT AS contained FROM part",
    "enriched_query": "SELECT event_id, event_type || CASE WHEN user_id % 2 = 0 OR event_id % 3 = 0 THEN chr(10) || chr(10) || 'Related terms: ' || concat_ws(', ', CASE WHEN user_id % 2 = 0 THEN 'remote execution, lateral movement' END, CASE WHEN event_id % 3 = 0 THEN 'Windows' END) ELSE '' END AS query FROM events",
    "nested_fill_gap": "SELECT o_orderkey AS event_id, 'host.name' AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'out' ELSE 'in' END || o_custkey AS value, 'json' AS format FROM orders UNION ALL SELECT o_orderkey, 'account.name', 'eve', 'json' FROM orders WHERE o_orderkey % 2 = 1",
    "message_fields": """SELECT o_orderkey AS event_id, unnest(['account.name', 'logon.id', 'process.name']) AS name, unnest(['u' || o_custkey, '0x' || hex(o_orderkey), 'C:\\a b\\' || o_orderpriority]) AS value, 'windows_message' AS format FROM orders""",
    "payload_column_discovery": "SELECT 'payload' AS found",
    "export_payloads": "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS \"Timestamp\", '4624' AS \"EventID\", 'H' || (o_custkey % 7) AS \"Hostname\", 'u' || o_custkey AS \"SubjectUserName\", '10.0.0.' || (o_custkey % 9) AS \"SourceIp\", count(*) AS n FROM orders GROUP BY ALL",
    "event_split_lines": """SELECT o_orderkey AS event_id, unnest([0, 1, 2])::INTEGER AS part, unnest(['EventID=1 a=' || o_orderkey, 'EventID=2 b={' || chr(10) || 'x=' || o_custkey || '}', 'EventID=3 c=1']) AS text, 'lines' AS rule, 3::INTEGER AS markers, false AS under_split FROM orders""",
    "indicator_categories": """WITH x AS (SELECT event_id AS row, 'process' AS category, 'C:\\x\\lsass.exe' AS detail FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'credential', 'C:\\x\\lsass.exe' FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'network', '10.0.0.1 -> 10.0.0.2' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'download', 'C:\\f' FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'service', 'svc' FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, 'registry', 'HKLM\\x' FROM events WHERE event_id % 5 = 0) SELECT category, detail, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows FROM x GROUP BY ALL""",
    "risk_sentences": f"""WITH {_T}, g AS (SELECT user_id, island, CAST(count(DISTINCT tactic) AS INTEGER) AS n_tactics, string_agg(tactic, ', ' ORDER BY phase) AS names, count(DISTINCT tactic) FILTER (tactic IN ({_HIGH})) AS h, string_agg(tactic, ', ' ORDER BY phase) FILTER (tactic IN ({_HIGH})) AS high, count(*) AS n, avg(score) AS mean
FROM c WHERE score >= 0.5 GROUP BY ALL), p AS (SELECT *, round(30.0::DOUBLE * n_tactics / 15, 2) AS coverage, CAST(least(15 * h, 30) AS INTEGER) AS bonus, CAST(least(3 * n, 20) AS INTEGER) AS volume, round(20 * mean, 2) AS confidence FROM g)
SELECT user_id, island, n_tactics, coverage, bonus, volume, 'tactics: ' || n_tactics || ' of 15 (' || names || '), +' || {_NUM.format("coverage")} || chr(10) || 'high-risk tactics: ' || coalesce(high, 'none') || ', +' || {_NUM.format("bonus")} || chr(10) || 'techniques: ' || n || ', +' || {_NUM.format("volume")} || chr(10) || 'confidence: mean ' || {_NUM.format("confidence / 20")} || ' x 20, +' || {_NUM.format("confidence")} AS sentences FROM p""",
    "rebuilt_incidents": f"""WITH {_T}, n AS (SELECT user_id, island, count(*) FILTER (score >= 0.5) AS strong, count(*) FILTER (score < 0.5) AS weak, count(DISTINCT tactic) FILTER (score >= 0.5) AS phases, count(DISTINCT tactic) FILTER (score >= 0.5 AND tactic IN ({_HIGH})) AS high, avg(score) FILTER (score >= 0.5) AS mean FROM c GROUP BY ALL),
s AS (SELECT user_id, island, strong, weak, phases, CAST(CASE WHEN strong = 0 THEN 0 ELSE greatest(0, least(100, round_even(round(30.0::DOUBLE * phases / 15 + least(15 * high, 30) + least(3 * strong, 20) + 20 * mean, 6), 0))) END AS INTEGER) AS score FROM n)
SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS severity FROM s""",
    "incident_summary": f"""WITH {_T}, s AS (SELECT user_id, island, sum(occurrences)::BIGINT AS n_rows, min(first_seen) AS f, max(first_seen) AS l, count(*) FILTER (score < 0.5) AS weak, count(*) FILTER (score >= 0.5) AS n FROM c GROUP BY ALL),
p AS (SELECT user_id, island, string_agg(tactic || ': ' || event_type || ' (' || occurrences || ' rows)', chr(10) || '- ' ORDER BY phase) AS flow, string_agg(tactic, ', ' ORDER BY phase) FILTER (tactic IN ({_HIGH})) AS risky FROM c WHERE score >= 0.5 GROUP BY ALL)
SELECT user_id, island, CASE WHEN n = 0 THEN 'No technique has enough evidence.' ELSE concat_ws(chr(10) || chr(10), 'On h1, by u' || user_id || ', ' || strftime(f, '%Y-%m-%d %H:%M:%S') || CASE WHEN f = l THEN '' WHEN CAST(f AS DATE) = CAST(l AS DATE) THEN ' to ' || strftime(l, '%H:%M:%S') ELSE ' to ' || strftime(l, '%Y-%m-%d %H:%M:%S') END || ': ' || n_rows || ' rows in one incident, ' || n || ' techniques in ' || n || ' phases.',
'- ' || flow, 'High risk: ' || risky || '.', CASE WHEN weak > 0 THEN weak || ' weak signals are left out.' END) END AS summary FROM s LEFT JOIN p USING (user_id, island)""",
    "incident_rule_drafts": """WITH h AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS ids, count(DISTINCT o_orderstatus) AS k, string_agg(DISTINCT lower(substr(o_orderpriority, 1, 1)) || '.exe', ', ' ORDER BY lower(substr(o_orderpriority, 1, 1)) || '.exe') AS programs, count(*) AS n, epoch(date_trunc('second', max(o_orderdate))) - epoch(date_trunc('second', min(o_orderdate))) AS span FROM orders GROUP BY 1)
SELECT o_custkey, 'Rule inc-' || o_custkey || chr(10) || 'when at least ' || least(n, 3) || ' events with id in (' || ids || ')' || chr(10) || 'of programs (' || programs || ')' || CASE WHEN o_custkey % 2 = 0 THEN ' with the same host (h' || o_custkey || ')' ELSE ' with the same user (bob)' END || chr(10) || 'are seen within ' || CAST(greatest(15, least(1440, floor(span / 60 * 1.5) + 1)) AS INTEGER) || ' minutes' AS draft FROM h WHERE k >= 2""",
    "event_rule_drafts": """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 6 = 0 THEN 'Rule [T1] ' || event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'and the platform is Windows' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN chr(10) || 'and the program is b.exe' WHEN event_id % 5 = 0 THEN chr(10) || 'and the program is one of net.exe or cmd.exe' ELSE '' END
|| CASE WHEN event_id % 7 = 0 THEN chr(10) || 'and the command line contains ' || repeat('x', 80) ELSE '' END || CASE WHEN event_id % 11 = 0 THEN chr(10) || 'and the destination is 10.1.1.1' WHEN event_id % 13 = 0 THEN chr(10) || 'and the destination is the remote machine (not named in the event)' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN chr(10) || 'and the account is bob' ELSE '' END
|| CASE WHEN event_id % 6 = 0 THEN chr(10) || 'and the event id is 4688' ELSE '' END || CASE WHEN event_id % 2 = 1 THEN chr(10) || 'note: the technique is not sure, have it checked first' ELSE '' END END AS draft FROM events""",
    "reviewer_meetings": "WITH f AS (SELECT 'T' || user_id % 5 AS technique FROM events) SELECT technique, reviewer, count(*) AS n FROM f JOIN (VALUES ('general', NULL), ('three', 'T3'), ('four', 'T4'), ('three-b', 'T3')) r(reviewer, own) ON own IS NULL OR own = technique GROUP BY ALL",
    "model_decisions": """WITH c AS (SELECT c_custkey, c_custkey % 5 AS v, c_custkey % 7 = 0 AS silent, c_custkey % 4 AS l FROM customer)
SELECT c_custkey, CASE WHEN silent OR v NOT IN (1, 2) OR l >= 2 THEN 'abstain' ELSE 'downgrade' END AS verdict, CASE WHEN NOT silent AND v IN (1, 2) AND l < 2 THEN 'low' END AS downgrade_to, CASE WHEN silent THEN 'no reason' WHEN v = 0 THEN 'model' WHEN v IN (3, 4) THEN 'unknown view' WHEN l >= 2 THEN 'no lower level' ELSE 'model' END AS note FROM c""",
    "added_techniques": "SELECT DISTINCT user_id, event_type AS technique FROM events EXCEPT SELECT user_id, event_type FROM events WHERE event_type <> 'error' OR value < 200 AND user_id % 3 > 0",
    "rule_diagnosis": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'CommandLine is missing' WHEN NOT regexp_matches(p_name, '(?i)green') THEN 'CommandLine does not match /(?i)green/: ' || p_name WHEN regexp_matches(p_name, '(?i)red') THEN 'CommandLine matches the forbidden /(?i)red/: ' || p_name END AS why FROM part",
    "evidence_kept_and_missing": """SELECT p_partkey AS row, concat_ws('|', CASE WHEN p_size > 25 AND lower('Odd') < 'a' THEN NULL END, CASE WHEN p_size > 25 THEN 'Odd: ' || p_type END, 'command line: winrs ' || p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'T1021.006 needs WinRM|T1021.006 needs port 5985' WHEN p_partkey % 2 = 0 THEN 'T1021.006 needs winrs' END) AS detected,
CASE WHEN p_partkey % 4 = 0 THEN 'T1021.006 needs WSMAN|T1021.006 needs port 5986|T1021.006 needs winrs' WHEN p_partkey % 2 = 0 THEN 'T1021.006 needs WSMAN|T1021.006 needs WinRM|T1021.006 needs port 5985|T1021.006 needs port 5986' ELSE '' END AS missing FROM part""",
    "component_sets": "WITH a AS (SELECT n_regionkey AS event_id, unnest([n_name, 'Both']) AS c FROM nation UNION SELECT n_regionkey, unnest(['Both', upper(substr(n_name, 1, 2))]) FROM nation WHERE n_nationkey > 10) SELECT event_id, string_agg(c, ',' ORDER BY c) AS components FROM a GROUP BY 1",
    "public_addresses": f"SELECT o_orderkey, {_ADDRESS} AS value, {_PUBLIC} AS public FROM orders",
    "reputation_queue": f"WITH a AS (SELECT {_ADDRESS} AS value, min(o_orderkey) AS first FROM orders WHERE {_PUBLIC} GROUP BY 1), r AS (SELECT value, first, CAST(row_number() OVER (ORDER BY first, value) AS INTEGER) AS place FROM a WHERE value NOT LIKE '8.1.1%') SELECT * FROM r WHERE place <= 10 UNION ALL SELECT value, first, NULL FROM a WHERE value LIKE '8.1.1%'",
    "reputation_words": """SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'not looked up' WHEN s_suppkey % 5 = 1 THEN 'not looked up: quota used' WHEN s_suppkey % 5 = 2 THEN 'no record' WHEN s_suppkey % 5 = 3 THEN 'look-ups are off' WHEN s_suppkey % 5 = 4 THEN 'not looked up' WHEN s_suppkey % 3 > 0 THEN 'malicious (' || s_suppkey % 3 || ' engines)' WHEN s_suppkey % 2 > 0 THEN 'suspicious (1 engines)' ELSE 'clean' END AS words FROM supplier""",
    "scope_reasons": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'small') THEN 'size' WHEN contains(lower(p_type), 'brass') THEN 'metal too' END AS reason FROM part",
    "asks_for_indicators": "SELECT conv_id, turn, contains(lower(text), 'indicator') OR contains(lower(text), 'hash') OR contains(lower(text), 'please') AS asks FROM conversations",
    "required_terms": "SELECT p_partkey, p_partkey % 2 = 1 OR p_partkey % 3 <> 2 AS enough FROM part",
    "refine_and_merge": """WITH f AS (SELECT user_id, event_type AS technique, max(value) AS value FROM events WHERE value < 100 GROUP BY ALL), n AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (value < 100) = 0 OR count(*) FILTER (value > 490) > 0),
s AS (SELECT user_id, event_type AS technique, max(value) AS value FROM events JOIN n USING (user_id) WHERE value BETWEEN 200 AND 300 GROUP BY ALL) SELECT * FROM f UNION ALL SELECT s.* FROM s ANTI JOIN f USING (user_id, technique)""",
    "bm25_saved_index": _RETRIEVAL_SQL["bm25_topk"],
}
