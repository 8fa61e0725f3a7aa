"""Validation, verdict, knowledge and evaluation queries over the general tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import assess, evaluate, normalise
from tracewright.operators.rules import LEVELS
from tracewright.sources import catalog
from tracewright.workspace import table

def quote_check(spark, d):
    """Benchmark items that a document bears out by half of their longer words."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return assess.quoted_matches(quotes, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def _kb(spark, d):
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    after = F.when(key == 3, "K4").when(key == 4, "K5").when(key == 8, "K9").when(key == 9, "K8").when(key == 12, "K99")
    return n.select(F.concat(F.lit("K"), key).alias("id"), F.col("n_name").alias("name"), after.alias("revoked_by"))


def mapping_redirects(spark, d):
    return assess.redirects(_kb(spark, d))


def redirect_chains(spark, d):
    """Chains of up to 39 hops, circles and unknown ends."""
    k = F.col("o_orderkey")
    after = F.when(k % 1000 == 7, k - 6).when(k % 1000 == 50, F.lit(-5)).when(k % 40 != 0, F.when(k % 1000 == 1, k + 6).otherwise(k - 1))
    return assess.redirects(table(spark, d, "orders").select(k.alias("id"), after.alias("revoked_by")))


_NAMES = ["ReadData (or ListDirectory)", "DELETE", "Query key value", "Set key value", "Notify about changes to keys", "Child", "data", "Execute/Traverse", "DeleteChild", "read", "no such right", "-", "WRITE_DAC"]


def access_name_bits(spark, d):
    """Names of rights to bits: the same words, the only bit that has them all, several, none."""
    e = table(spark, d, "events")
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES)).cast("int"))
    family = F.get(F.array(*map(F.lit, ["file", "registry", "process"])), (F.col("user_id") % 3).cast("int"))
    n = normalise.access_names(e.select(F.col("event_id").alias("row"), F.lit(0).alias("ord"), name.alias("name"), family.alias("family")))
    return n.groupBy("name", "family", "bit", "kind", "how").agg(F.count("*").alias("n"))


def mapping_validation(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("mapping_id"), F.concat(F.lit("K"), F.col("c_custkey") % 28).alias("technique"), F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("name"), F.get(F.array(*map(F.lit, LEVELS)), (F.col("c_custkey") % 4).cast("int")).alias("level"), F.concat(F.lit("customer segment "), F.lower("c_mktsegment")).alias("text"), F.array(F.concat(F.lit("segment "), F.lower("c_mktsegment")), F.lit("nowhere present")).alias("evidence"))
    grounded = c.where("mapping_id % 3 <> 0").select("mapping_id", F.when(F.col("technique").isin("K3", "K4"), "K5").otherwise(F.col("technique")).alias("technique"))
    v = assess.validated(c, _kb(spark, d), grounded)
    return v.select("mapping_id", "technique", "status", "name", "level", F.size("evidence").alias("quotes"), F.array_join("notes", ",").alias("notes"))


def mapping_corrections(spark, d):
    """Claims about techniques put right: each note has rows."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    of = k % 10
    technique = F.when(of == 9, F.lit("T1021.006")).otherwise(F.concat(F.lit("K"), of.cast("string")))
    m = c.select(
        k.alias("mapping_id"), technique.alias("technique"), F.concat(F.lit("NATION_"), of.cast("string")).alias("name"), F.get(F.array(*map(F.lit, [*LEVELS, "sure"])), (k % 5).cast("int")).alias("level"), F.concat(F.lit("segment "), F.lower("c_mktsegment"), F.when(k % 20 == 9, " by winrs").otherwise("")).alias("text"),
        F.array(F.concat(F.lit("segment "), F.lower("c_mktsegment"))).alias("evidence"), F.when(k % 3 > 0, "technique").alias("object_type"), F.when(k % 4 == 0, F.array(F.lit("R9"))).when(k % 4 == 1, F.array(F.lit("R1"), F.lit("R2"))).alias("tactics"), F.when(k % 2 == 0, F.concat(F.lit("u/"), of.cast("string"), F.lit("/"))).otherwise("other").alias("source_url"), F.repeat(F.lit("word "), (k % 7 * 30).cast("int")).alias("summary"),
    )
    n = F.col("n_nationkey")
    kb = table(spark, d, "nation").where("n_nationkey < 10").select(F.when(n == 9, "T1021.006").otherwise(F.concat(F.lit("K"), n.cast("string"))).alias("id"), F.concat(F.lit("NATION_"), n.cast("string")).alias("name"), F.lit(None).cast("string").alias("revoked_by"), (n % 2 == 1).alias("is_subtechnique"), F.array(F.lit("R1"), F.lit("R2")).alias("tactics"), F.concat(F.lit("u/"), n.cast("string")).alias("source_url"), (n == 4).alias("deprecated"))
    v = assess.corrected(m, kb, m.select("mapping_id", "technique"))
    return v.select("mapping_id", "status", "object_type", F.array_join("tactics", ",").alias("tactics"), "source_url", "level", F.length("summary").alias("summary"), F.array_join("notes", ",").alias("notes"))


def evidence_gate(spark, d):
    e = table(spark, d, "events")
    m = e.select(F.concat(F.lit("T"), F.col("user_id") % 4).alias("technique"), F.col("event_id").alias("row"))
    hits = e.where("event_type = 'error'").select(F.lit("T0").alias("technique"), F.col("event_id").alias("row")).unionByName(e.where("value > 300").select(F.lit("T1").alias("technique"), F.col("event_id").alias("row")))
    rules = spark.createDataFrame([("T0", True), ("T1", True), ("T1", False), ("T2", True)], "technique string, needs_id boolean")
    ids = e.select(F.col("event_id").alias("row"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_id"))
    return assess.evidence_gate(m, hits, rules, ids)


def apply_decisions(spark, d):
    f = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("g"), F.col("o_orderpriority").alias("technique"), F.get(F.array(*map(F.lit, LEVELS)), (F.col("o_orderkey") % 3).cast("int")).alias("level")).groupBy("g", "technique").agg(F.min("level").alias("level"))
    v = F.when(F.col("o_orderstatus") == "P", "reject").when(F.col("o_orderkey") % 2 == 0, "downgrade").otherwise("confirm")
    dec = table(spark, d, "orders").where("o_orderkey % 7 = 0").select((F.col("o_orderkey") % 500).alias("g"), F.col("o_orderpriority").alias("technique"), v.alias("verdict"), F.when(F.col("o_orderkey") % 4 == 0, "low").otherwise("medium").alias("downgrade_to"))
    return assess.apply_decisions(f, dec, ["g"])


def confidence_composite(spark, d):
    l = table(spark, d, "lineitem")
    parts = {"retrieval": F.col("l_quantity") / 50, "evidence": F.when(F.col("l_discount") > 0, F.col("l_discount") * 10), "fields": F.when(F.col("l_tax") > 0, F.col("l_tax") * 12), "event_id": F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0), "platform": F.when(F.col("l_linestatus") == "O", 1.0)}
    s = F.round(assess.confidence(parts), 6)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", s.alias("score"), assess.level_of(s).alias("level"))


def _decisions(spark, d):
    l = table(spark, d, "lineitem")
    crit = F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_quantity") > 35, "high").when(F.col("l_quantity") > 20, "medium").when(F.col("l_quantity") > 8, "noise")
    access = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read").otherwise("unknown")
    v = assess.event_decision(F.when(F.col("l_partkey") % 10 == 0, 2).otherwise(0), F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0), crit, access, F.col("l_suppkey") % 5 == 0)
    return l.select("l_orderkey", F.col("l_linenumber").alias("idx"), "l_partkey", "l_suppkey", v.alias("v")).select("l_orderkey", "idx", "l_partkey", "l_suppkey", "v.*")


def event_decision(spark, d):
    return _decisions(spark, d)


def alarm_combine(spark, d):
    return assess.combine_alarm(_decisions(spark, d), ["l_orderkey"])


def suppression_semijoin(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "service").otherwise("driver").alias("family"), F.when(F.col("s_suppkey") % 3 == 0, "msiexec.exe").otherwise("cmd.exe").alias("process"), F.when(F.col("s_suppkey") % 5 != 0, "system").otherwise("bob").alias("account"), (F.col("s_acctbal") > 0).alias("trusted"))
    return assess.suppressed(s, assess.expected_actors(spark)).select("s_suppkey")


def _expected(spark, d):
    o = table(spark, d, "orders")
    ids = F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("N"), (F.col("o_orderkey") % 25).cast("string"))))
    return o.select(F.col("o_orderkey").alias("key"), ids.alias("ids"), F.array(F.concat(F.lit("N"), ((F.col("o_orderkey") + 1) % 25).cast("string"))).alias("alternatives"), F.array(F.concat(F.lit("R"), (F.col("o_orderkey") % 5).cast("string"))).alias("tactics"))


def _predicted(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("N"), (F.col("l_partkey") % 30).cast("string")).alias("id"))


def _nations(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("N"), ((F.col("n_nationkey") + 3) % 25).cast("string"))).alias("parent"), F.array(F.concat(F.lit("R"), "n_regionkey")).alias("tactics"))


def metric_hierarchical(spark, d):
    return evaluate.hierarchical(_predicted(spark, d), _expected(spark, d), _nations(spark, d), "key")


def metric_recall_at_k(spark, d):
    e = _expected(spark, d).select("key", F.when(F.size("ids") == 0, F.array().cast("array<string>")).otherwise(F.array_union("ids", "alternatives")).alias("wanted"))
    return evaluate.recall_at_k(_predicted(spark, d), e, "key", 2)


def metric_hallucination(spark, d):
    return evaluate.unknown_rate(_predicted(spark, d), _nations(spark, d), "key").withColumn("rate", F.round("rate", 6))


def metric_abstention(spark, d):
    l = table(spark, d, "labels")
    a = evaluate.abstained(F.col("toxic") == 1, F.when(F.col("quality") == 0, "insufficient").otherwise("high"), F.col("doc_id") % 3, F.col("doc_id") % 2)
    return l.select("doc_id", a.alias("abstained"))


def run_summary(spark, d):
    l = table(spark, d, "labels").select("quality", F.when(F.col("doc_id") % 17 == 0, "timeout").alias("error"), ((F.col("doc_id") % 10) / 10).alias("score"), F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 2).cast("double")).alias("recall"), F.when(F.col("toxic") == 1, F.col("doc_id") % 3 == 0).alias("abstained"))
    return evaluate.run_summary(l, ["quality"])


def run_compare(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 11 <> 0").select("o_orderkey", (F.col("o_orderkey") % 5).alias("v"))
    b = o.where("o_orderkey % 13 <> 0").select("o_orderkey", ((F.col("o_orderkey") + F.col("o_custkey") % 2) % 5).alias("v"))
    return evaluate.run_compare(a, b, "o_orderkey", "v")


def _given(spark, d):
    """Techniques that a run gave each order, and those it was to give."""
    l = table(spark, d, "lineitem")
    given = l.select(F.col("l_orderkey").alias("key"), F.concat(F.lit("T"), F.col("l_partkey") % 97).alias("technique"))
    return given, l.where("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("T"), F.col("l_partkey") % 97).alias("technique"))


def frequent_false_positives(spark, d):
    return evaluate.false_positives(*_given(spark, d), 10)


def majority_baseline(spark, d):
    o = table(spark, d, "orders")
    say = lambda c: F.get(F.array(*map(F.lit, ["INSUFFICIENT_DATA", "SUFFICIENT_BENIGN", "SUFFICIENT_SUSPICIOUS"])), c.cast("int"))
    made = o.select(F.col("o_orderkey").alias("key"), say(F.col("o_orderkey") % 7 % 3).alias("decision"), say(F.col("o_custkey") % 5 % 3).alias("expected"), (F.col("o_custkey") % 4 == 0).alias("negative"))
    return evaluate.decision_scores(made, "SUFFICIENT_SUSPICIOUS")


_ARMS, _METRICS = ["none", "agents", "loop"], ["score", "abstained"]


def arm_means(spark, d):
    k = F.col("o_orderkey")
    wide = table(spark, d, "orders").select(k.alias("key"), *[((k * (i + 2)) % 10 / 10).alias(f"{a}_score") for i, a in enumerate(_ARMS)], *[F.when(k % 3 == 0, (k % (i + 2) == 0).cast("int")).alias(f"{a}_abstained") for i, a in enumerate(_ARMS)])
    return evaluate.arm_summary(evaluate.arm_rows(wide, _ARMS, _METRICS), _METRICS)


def _runs(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("place"), F.concat(F.lit("T"), F.col("l_partkey") % 97).alias("technique"), "l_suppkey", "l_partkey")
    return l.where("l_suppkey % 11 > 0").select("key", "place", "technique"), l.withColumn("technique", F.when(F.col("l_partkey") % 13 == 0, "T-new").otherwise(F.col("technique"))).where("l_suppkey % 7 > 0").select("key", "place", "technique")


def run_technique_changes(spark, d):
    return evaluate.technique_changes(*_runs(spark, d))


def arm_differences(spark, d):
    k = F.col("o_orderkey")
    return evaluate.arm_compare(*_runs(spark, d), table(spark, d, "orders").select(k.alias("key"), (k % 10 / 10).alias("a"), ((k * 3) % 10 / 10).alias("b")))


def loss_layers(spark, d):
    k = F.col("o_orderkey")
    layer = evaluate.loss_layer(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 11 == 0)
    return table(spark, d, "orders").groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


_RUNS = """l AS (SELECT l_orderkey AS key, l_linenumber AS place, 'T' || l_partkey % 97 AS technique, l_suppkey, l_partkey FROM lineitem),
a AS (SELECT key, place, technique FROM l WHERE l_suppkey % 11 > 0), b AS (SELECT key, place, CASE WHEN l_partkey % 13 = 0 THEN 'T-new' ELSE technique END AS technique FROM l WHERE l_suppkey % 7 > 0)"""
_DEC = """d AS (SELECT l_orderkey, l_linenumber AS idx, l_partkey, l_suppkey, l_partkey % 10 = 0 AND l_suppkey % 3 = 0 AS a, l_quantity > 35 AND l_returnflag = 'R' AS b, l_suppkey % 5 = 0 AS x, l_quantity > 8 AND l_quantity <= 20 AND l_returnflag = 'A' AND l_suppkey % 3 <> 0 AS z FROM lineitem),
v AS (SELECT l_orderkey, idx, l_partkey, l_suppkey, CASE WHEN a THEN 'SUFFICIENT_SUSPICIOUS' WHEN b AND x THEN 'SUFFICIENT_BENIGN' WHEN b THEN 'SUFFICIENT_SUSPICIOUS' WHEN z THEN 'SUFFICIENT_BENIGN' ELSE 'INSUFFICIENT_DATA' END AS verdict, CASE WHEN a THEN 'A' WHEN b THEN 'B' WHEN z THEN 'noise' ELSE 'none' END AS path, NOT a AND b AND x AS suppressed FROM d)"""
_EXP = """e AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'N' || o_orderkey % 25 END AS id, 'N' || (o_orderkey + 1) % 25 AS alt, 'R' || o_orderkey % 5 AS tactic FROM orders),
p AS (SELECT l_orderkey AS key, l_linenumber AS rank, 'N' || l_partkey % 30 AS id FROM lineitem),
k AS (SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'N' || (n_nationkey + 3) % 25 END AS parent, 'R' || n_regionkey AS tactic FROM nation)"""
QUERIES = {f.__name__: f for f in (quote_check, mapping_redirects, redirect_chains, access_name_bits, mapping_validation, mapping_corrections, evidence_gate, apply_decisions, confidence_composite, event_decision, alarm_combine, suppression_semijoin, metric_hierarchical, metric_recall_at_k, metric_hallucination, metric_abstention, run_summary, run_compare, frequent_false_positives, majority_baseline, arm_means, run_technique_changes, arm_differences, loss_layers)}
ORACLE_SQL = {
    "redirect_chains": """WITH RECURSIVE k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1000 = 7 THEN o_orderkey - 6 WHEN o_orderkey % 1000 = 50 THEN -5 WHEN o_orderkey % 40 <> 0 THEN CASE WHEN o_orderkey % 1000 = 1 THEN o_orderkey + 6 ELSE o_orderkey - 1 END END AS nxt FROM orders),
w AS (SELECT id, id AS at, 0 AS hops FROM k UNION ALL SELECT w.id, nxt, hops + 1 FROM w JOIN k ON k.id = w.at WHERE nxt IS NOT NULL AND hops < 60),
t AS (SELECT w.id, w.at, w.hops FROM w JOIN k ON k.id = w.at WHERE k.nxt IS NULL)
SELECT k.id, t.at AS target, t.hops FROM k LEFT JOIN t ON t.id = k.id""",
    "access_name_bits": f"""WITH b AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{n}', '{k}')" for f in ("file", "registry", "process") for _, n, k in catalog.MASKS[f] + catalog.MASKS["standard"])}) v(family, bit, kind)),
n AS (SELECT * FROM (VALUES ('ReadData (or ListDirectory)', ['read', 'data']), ('DELETE', ['delete']), ('Query key value', ['query', 'key', 'value']), ('Set key value', ['set', 'key', 'value']), ('Notify about changes to keys', ['notify', 'about', 'changes', 'to', 'keys']), ('Child', ['child']), ('data', ['data']), ('Execute/Traverse', ['execute']), ('DeleteChild', ['delete', 'child']), ('read', ['read']), ('no such right', ['no', 'such', 'right']), ('-', []), ('WRITE_DAC', ['write', 'dac'])) v(name, ws)),
f AS (SELECT * FROM (VALUES ('file'), ('registry'), ('process')) v(family)),
m AS (SELECT name, f.family, bit, kind, len(string_split(lower(bit), '_')) = len(ws) AS same FROM n, f JOIN b USING (family) WHERE len(ws) > 0 AND list_has_all(string_split(lower(bit), '_'), ws)),
g AS (SELECT name, family, count(*) FILTER (same) AS e, count(*) FILTER (NOT same) AS l, min({{'bit': bit, 'kind': kind}}) FILTER (same) AS s, min({{'bit': bit, 'kind': kind}}) FILTER (NOT same) AS o FROM m GROUP BY name, family),
r AS (SELECT name, family, CASE WHEN name LIKE 'Notify%' AND family = 'registry' THEN {{'bit': 'KEY_NOTIFY', 'kind': 'read'}} WHEN e = 1 THEN s WHEN l = 1 THEN o END AS b, CASE WHEN name LIKE 'Notify%' AND family = 'registry' THEN 'alias' WHEN e = 1 THEN 'equal' WHEN l = 1 THEN 'contained' WHEN e + l > 0 THEN 'ambiguous' ELSE 'unknown' END AS how FROM n CROSS JOIN f LEFT JOIN g USING (name, family)),
q AS (SELECT [{", ".join(f"'{x}'" for x in _NAMES)}][event_id % {len(_NAMES)} + 1] AS name, ['file', 'registry', 'process'][user_id % 3 + 1] AS family FROM events)
SELECT name, family, b.bit AS bit, coalesce(b.kind, 'unknown') AS kind, how, count(*) AS n FROM q JOIN r USING (name, family) GROUP BY ALL""",
    "frequent_false_positives": """WITH g AS (SELECT DISTINCT l_orderkey AS key, 'T' || l_partkey % 97 AS technique FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS key, 'T' || l_partkey % 97 AS technique FROM lineitem WHERE l_suppkey % 3 = 0),
c AS (SELECT technique, count(*) AS n FROM g ANTI JOIN e USING (key, technique) GROUP BY technique)
SELECT technique, n, CAST(row_number() OVER (ORDER BY n DESC, technique) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""",
    "majority_baseline": """WITH o AS (SELECT ['INSUFFICIENT_DATA', 'SUFFICIENT_BENIGN', 'SUFFICIENT_SUSPICIOUS'][o_orderkey % 7 % 3 + 1] AS decision, ['INSUFFICIENT_DATA', 'SUFFICIENT_BENIGN', 'SUFFICIENT_SUSPICIOUS'][o_custkey % 5 % 3 + 1] AS expected, o_custkey % 4 = 0 AS negative FROM orders),
m AS (SELECT decision AS majority FROM o GROUP BY 1 ORDER BY count(*) DESC, decision LIMIT 1)
SELECT count(*) AS n, count(*) FILTER (decision = expected) AS "right", count(*) FILTER (decision = 'SUFFICIENT_SUSPICIOUS' AND negative) AS false_alarms, count(*) FILTER (negative) AS negatives, count(*) FILTER (expected = 'SUFFICIENT_SUSPICIOUS' AND decision <> expected) AS missed, max(majority) AS majority, count(*) FILTER (expected = majority) AS baseline, count(*) FILTER (decision = expected) > count(*) FILTER (expected = majority) AS beats_baseline FROM o, m""",
    "arm_means": """WITH a AS (SELECT * FROM (VALUES ('none', 2), ('agents', 3), ('loop', 4)) v(arm, f))
SELECT arm, round(avg((o_orderkey * f) % 10 / 10), 4) AS score, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % f = 0 AS INTEGER) END), 4) AS abstained FROM orders, a GROUP BY arm""",
    "run_technique_changes": f"""WITH {_RUNS}, x AS (SELECT DISTINCT key, technique FROM a), y AS (SELECT DISTINCT key, technique FROM b), k AS (SELECT key FROM x INTERSECT SELECT key FROM y),
d AS (SELECT technique, 1 AS p, 0 AS q FROM (SELECT * FROM x EXCEPT SELECT * FROM y) SEMI JOIN k USING (key) UNION ALL SELECT technique, 0, 1 FROM (SELECT * FROM y EXCEPT SELECT * FROM x) SEMI JOIN k USING (key))
SELECT technique, CAST(sum(p) AS BIGINT) AS only_a, CAST(sum(q) AS BIGINT) AS only_b FROM d GROUP BY technique""",
    "arm_differences": f"""WITH {_RUNS}, c AS (SELECT DISTINCT key FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))),
s AS (SELECT o_orderkey % 10 / 10 AS x, (o_orderkey * 3) % 10 / 10 AS y, c.key IS NOT NULL AS changed FROM orders LEFT JOIN c ON c.key = o_orderkey)
SELECT count(*) AS n, round(round(avg(y), 4) - round(avg(x), 4), 4) AS delta, count(*) FILTER (changed) AS changed, count(*) FILTER (changed AND y > x) AS improved, count(*) FILTER (changed AND y < x) AS worsened FROM s""",
    "mapping_corrections": """WITH m AS (SELECT c_custkey AS mapping_id, c_custkey % 10 AS t, ['high', 'medium', 'low', 'insufficient', 'sure'][c_custkey % 5 + 1] AS level, CASE WHEN c_custkey % 3 > 0 THEN 'technique' END AS said, CASE c_custkey % 4 WHEN 0 THEN ['R9'] WHEN 1 THEN ['R1', 'R2'] ELSE [] END AS ta, CASE WHEN c_custkey % 2 = 0 THEN 'u/' || c_custkey % 10 || '/' ELSE 'other' END AS url, c_custkey % 7 * 30 AS words FROM customer),
r AS (SELECT *, t = 9 AND mapping_id % 20 <> 9 AS lacks, CASE WHEN t % 2 = 1 THEN 'sub-technique' ELSE 'technique' END AS ty FROM m)
SELECT mapping_id, CASE WHEN lacks THEN 'rejected' ELSE 'accepted' END AS status, ty AS object_type, CASE WHEN mapping_id % 4 = 0 THEN 'R1,R2' ELSE array_to_string(ta, ',') END AS tactics, CASE WHEN rtrim(url, '/') <> 'u/' || t THEN 'u/' || t ELSE url END AS source_url, CASE WHEN level = 'sure' THEN 'low' ELSE level END AS level, CAST(CASE WHEN words * 5 > 600 THEN 602 ELSE words * 5 END AS INTEGER) AS summary,
concat_ws(',', CASE WHEN lacks THEN 'no_required_evidence' END, CASE WHEN said IS DISTINCT FROM ty THEN 'type' END, CASE WHEN mapping_id % 4 = 0 THEN 'tactics' END, CASE WHEN rtrim(url, '/') <> 'u/' || t THEN 'url' END, CASE WHEN level = 'sure' THEN 'level' END, CASE WHEN t = 4 THEN 'deprecated' END, CASE WHEN words * 5 > 600 THEN 'summary' END) AS notes FROM r""",
    "mapping_redirects": "SELECT 'K' || n_nationkey AS id, CASE WHEN n_nationkey IN (8, 9, 12) THEN NULL WHEN n_nationkey IN (3, 4) THEN 'K5' ELSE 'K' || n_nationkey END AS target, CASE WHEN n_nationkey IN (8, 9, 12) THEN NULL WHEN n_nationkey = 3 THEN 2 WHEN n_nationkey = 4 THEN 1 ELSE 0 END AS hops FROM nation",
    "evidence_gate": """WITH m AS (SELECT 'T' || user_id % 4 AS technique, event_id AS row, event_type, value, event_id % 5 <> 0 AS has FROM events)
SELECT technique, row, CASE technique WHEN 'T3' THEN 'silent' WHEN 'T0' THEN CASE WHEN event_type = 'error' THEN 'confirm' WHEN NOT has THEN 'abstain' ELSE 'reject' END WHEN 'T1' THEN CASE WHEN value > 300 THEN 'confirm' ELSE 'reject' END ELSE CASE WHEN NOT has THEN 'abstain' ELSE 'reject' END END AS verdict FROM m""",
    "apply_decisions": """WITH f AS (SELECT o_orderkey % 500 AS g, o_orderpriority AS technique, min(['high', 'medium', 'low'][o_orderkey % 3 + 1]) AS level FROM orders GROUP BY ALL),
d AS (SELECT o_orderkey % 500 AS g, o_orderpriority AS technique, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS no, max(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END END) AS cap FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL)
SELECT g, technique, CASE WHEN no = 1 THEN 'rejected' ELSE 'kept' END AS status, ['high', 'medium', 'low', 'insufficient'][greatest(list_position(['high', 'medium', 'low', 'insufficient'], level) - 1, coalesce(cap, 0)) + 1] AS level FROM f LEFT JOIN d USING (g, technique)""",
    "confidence_composite": """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, round((0.3::DOUBLE * (l_quantity / 50) + CASE WHEN l_discount > 0 THEN l_discount * 10 * 0.3::DOUBLE ELSE 0 END + CASE WHEN l_tax > 0 THEN l_tax * 12 * 0.15::DOUBLE ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 0 END) /
(0.3::DOUBLE + CASE WHEN l_discount > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN l_tax > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN l_returnflag IN ('R', 'A') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM lineitem)
SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'insufficient' END AS level FROM s""",
    "event_decision": f"WITH {_DEC} SELECT * FROM v",
    "alarm_combine": f"""WITH {_DEC}, r AS (SELECT *, CASE verdict WHEN 'SUFFICIENT_SUSPICIOUS' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 1 ELSE 0 END AS h FROM v)
SELECT l_orderkey, arg_max(verdict, h * 1000 - idx) AS verdict, arg_max(idx, h * 1000 - idx) AS by_event, count(*) FILTER (h = 1) AS insufficient_data, count(*) FILTER (h = 0) AS sufficient_benign, count(*) FILTER (h = 2) AS sufficient_suspicious, count(*) FILTER (suppressed) AS n_suppressed FROM r GROUP BY 1""",
    "suppression_semijoin": "SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 AND s_acctbal > 0",
    "metric_hierarchical": f"""WITH {_EXP}, s AS (SELECT e.key, e.id AS want, max(CASE WHEN p.id IS NULL THEN NULL WHEN p.id = e.id THEN 1.0 WHEN p.id = e.alt THEN 0.7 WHEN p.id = w.parent THEN 0.5 WHEN k.tactic = e.tactic THEN 0.1 ELSE 0.0 END) AS best FROM e LEFT JOIN p USING (key) LEFT JOIN k ON p.id = k.id LEFT JOIN k w ON w.id = e.id GROUP BY ALL)
SELECT key, CAST(CASE WHEN want IS NULL THEN CASE WHEN best IS NULL THEN 1 ELSE 0 END ELSE coalesce(best, 0) END AS DOUBLE) AS score FROM s""",
    "metric_recall_at_k": f"""WITH {_EXP}, f AS (SELECT key, id, min(rank) AS r FROM p GROUP BY ALL), t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r, id) <= 2)
SELECT e.key, CASE WHEN e.id IS NULL THEN NULL ELSE CAST(coalesce(bool_or(t.id = e.id OR t.id = e.alt), false) AS INTEGER)::DOUBLE END AS hit FROM e LEFT JOIN t USING (key) GROUP BY e.key, e.id""",
    "metric_hallucination": f"WITH {_EXP} SELECT key, round(avg(CASE WHEN k.id IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM p LEFT JOIN k USING (id) GROUP BY key",
    "metric_abstention": "SELECT doc_id, CASE WHEN toxic = 1 THEN doc_id % 3 = 0 WHEN quality = 0 THEN doc_id % 2 = 0 END AS abstained FROM labels",
    "run_summary": """SELECT quality, count(*) AS n, count(*) FILTER (doc_id % 17 = 0) AS errors, round(avg((doc_id % 10) / 10) FILTER (doc_id % 17 <> 0), 6) AS score, round(avg(doc_id % 2) FILTER (doc_id % 17 <> 0 AND doc_id % 4 <> 0), 6) AS recall, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) FILTER (doc_id % 17 <> 0 AND toxic = 1), 6) AS abstention FROM labels GROUP BY 1""",
    "run_compare": """WITH a AS (SELECT o_orderkey, o_orderkey % 5 AS x FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, (o_orderkey + o_custkey % 2) % 5 AS y FROM orders WHERE o_orderkey % 13 <> 0)
SELECT count(*) FILTER (x <> y) AS changed, count(*) FILTER (y > x) AS improved, count(*) FILTER (y < x) AS worsened, count(*) FILTER (x = y) AS same, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b FROM a FULL JOIN b USING (o_orderkey)""",
    "loss_layers": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'found' WHEN o_orderkey % 3 = 0 THEN 'reviewer' WHEN o_orderkey % 5 = 0 THEN 'gate' WHEN o_orderkey % 7 = 0 THEN 'after_review' WHEN o_orderkey % 11 = 0 THEN 'not_selected' ELSE 'never_retrieved' END AS layer, count(*) AS n FROM orders GROUP BY 1",
    "mapping_validation": """WITH c AS (SELECT c_custkey AS mapping_id, c_custkey % 28 AS k, 'NATION_' || c_nationkey AS given, ['high', 'medium', 'low', 'insufficient'][c_custkey % 4 + 1] AS level FROM customer),
r AS (SELECT *, CASE WHEN k IN (3, 4) THEN 5 WHEN k IN (8, 9, 12) OR k > 24 THEN NULL ELSE k END AS t FROM c)
SELECT mapping_id, 'K' || coalesce(t, k) AS technique, CASE WHEN t IS NULL THEN 'rejected' ELSE 'accepted' END AS status, 'NATION_' || t AS name, CASE WHEN (t IS NULL OR mapping_id % 3 = 0) AND level IN ('high', 'medium') THEN 'low' ELSE level END AS level, 1 AS quotes,
concat_ws(',', CASE WHEN t IS NULL THEN 'unknown' END, CASE WHEN k IN (3, 4) THEN 'redirected' END, CASE WHEN 'NATION_' || t <> given THEN 'renamed' END, 'unquoted', CASE WHEN t IS NULL OR mapping_id % 3 = 0 THEN 'ungrounded' END) AS notes FROM r""",
    "quote_check": """WITH q AS (SELECT item_id AS quote_id, [w FOR w IN list_distinct(regexp_extract_all(lower(text), '[^\\s!-/:-@\\[-`{-~]+')) IF length(w) > 3] AS w FROM benchmark), t AS (SELECT doc_id AS text_id, unnest([w FOR w IN list_distinct(regexp_extract_all(lower(text), '[^\\s!-/:-@\\[-`{-~]+')) IF length(w) > 3]) AS word FROM documents)
SELECT quote_id, text_id, round(count(*)::DOUBLE / any_value(len(w)), 6) AS share FROM (SELECT quote_id, w, unnest(w) AS word FROM q) JOIN t USING (word) GROUP BY 1, 2 HAVING round(count(*)::DOUBLE / any_value(len(w)), 6) >= 0.5""",
}
