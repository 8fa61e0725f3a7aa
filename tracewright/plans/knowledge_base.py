"""Knowledge-base queries over a bundle made of the general tables: nations as techniques, regions as tactics, suppliers as mitigations, customers as users, part types as data components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import knowledge, normalise, retrieve
from tracewright.workspace import materialize, table


def _bundle(spark, d):
    """Objects and relationships. Detection goes from a strategy of each nation over two analytics to the components that they name; every seventh analytic names one that isn't there."""
    spec = spark.createDataFrame([], knowledge.OBJECT).schema
    ref = lambda c: F.array(F.struct(F.lit("mitre-attack").alias("source_name"), c.cast("string").alias("external_id"), F.lit("u").alias("url")))

    def made(df, **kv):
        cols = [(kv[f.name] if f.name in kv else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec]
        return df.select(*cols)

    n, r, s, c, p = (table(spark, d, t) for t in ("nation", "region", "supplier", "customer", "part"))
    types = p.select("p_type").where("p_type is not null").distinct()
    say = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    phase = F.array(F.struct(F.lit("k").alias("kill_chain_name"), say("r", "n_regionkey").alias("phase_name")))
    wanted = F.when(F.col("n_nationkey") % 7 == 6, "gone").otherwise(say("dc--", "type"))
    source = F.array(F.struct(wanted.alias("x_mitre_data_component_ref"), say("fallback ", "n_nationkey").alias("name")))
    key = F.col("n_nationkey")
    # nations take part types in turn
    placed = types.select(F.col("p_type").alias("type"), F.row_number().over(knowledge.Window.orderBy("p_type")).alias("place"))
    many = placed.count()
    analytic = n.join(placed, F.pmod(key, F.lit(many)) + 1 == F.col("place"))
    both = F.array(say("an--", "n_nationkey"), F.concat(F.lit("an--"), ((key + 1) % 25).cast("string")))
    parts = [
        made(n, id=say("ap--", "n_nationkey"), type=F.lit("attack-pattern"), name=F.col("n_name"), external_references=ref(say("T", "n_nationkey")), kill_chain_phases=phase, x_mitre_is_subtechnique=key % 5 == 4, description=F.when(key % 3 > 0, say("about ", "n_name"))),
        made(r, id=say("ta--", "r_regionkey"), type=F.lit("x-mitre-tactic"), name=F.col("r_name"), external_references=ref(say("TA", "r_regionkey")), x_mitre_shortname=say("r", "r_regionkey")),
        made(s, id=say("co--", "s_suppkey"), type=F.lit("course-of-action"), name=F.col("s_name"), external_references=ref(say("M", "s_suppkey"))),
        made(c, id=say("in--", "c_custkey"), type=F.when(F.col("c_custkey") % 2 == 0, "intrusion-set").otherwise("malware"), name=F.col("c_name"), external_references=ref(say("G", "c_custkey"))),
        made(types, id=say("dc--", "p_type"), type=F.lit("x-mitre-data-component"), name=F.col("p_type")),
        made(analytic, id=say("an--", "n_nationkey"), type=F.lit("x-mitre-analytic"), description=F.when(key % 2 == 0, say("look at ", "n_nationkey")), x_mitre_log_source_references=source),
        made(n, id=say("ds--", "n_nationkey"), type=F.lit("x-mitre-detection-strategy"), x_mitre_analytic_refs=both),
        made(n, id=say("r0--", "n_nationkey"), type=F.lit("relationship"), relationship_type=F.lit("detects"), source_ref=say("ds--", "n_nationkey"), target_ref=say("ap--", "n_nationkey")),
        made(n.where("n_nationkey % 5 = 4"), id=say("r1--", "n_nationkey"), type=F.lit("relationship"), relationship_type=F.lit("subtechnique-of"), source_ref=say("ap--", "n_nationkey"), target_ref=F.concat(F.lit("ap--"), (key - 4).cast("string"))),
        made(s, id=say("r2--", "s_suppkey"), type=F.lit("relationship"), relationship_type=F.lit("mitigates"), source_ref=say("co--", "s_suppkey"), target_ref=say("ap--", "s_nationkey")),
        made(c, id=say("r3--", "c_custkey"), type=F.lit("relationship"), relationship_type=F.lit("uses"), source_ref=say("in--", "c_custkey"), target_ref=say("ap--", "c_nationkey"), description=F.when(F.col("c_custkey") % 4 > 0, F.lower("c_mktsegment"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out, "bundle")


def kb_techniques(spark, d):
    t = knowledge.techniques(_bundle(spark, d))
    return t.select("attack_id", "name", "is_subtechnique", "parent", F.array_join("tactics", ",").alias("tactics"), F.size("mitigations").alias("n_mitigations"), F.array_join("users", ",").alias("users"))


def kb_parent_child(spark, d):
    """Techniques with the ones below them."""
    t = knowledge.techniques(_bundle(spark, d))
    return t.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def kb_three_hop(spark, d):
    """What detects each technique: components over strategies and analytics, and the analytics' texts."""
    t = knowledge.techniques(_bundle(spark, d))
    return t.select("attack_id", F.array_join("components", ",").alias("components"), "detection")


def kb_users(spark, d):
    t = knowledge.techniques(_bundle(spark, d))
    return t.select("attack_id", F.size("groups").alias("n_groups"), F.size("software").alias("n_software"), F.size("procedures").alias("n_procedures"), F.get("procedures", F.lit(0))["description"].alias("first"))


def kb_tactics(spark, d):
    return knowledge.tactics(_bundle(spark, d))


def kb_mitigations(spark, d):
    return knowledge.mitigations(_bundle(spark, d)).select("attack_id", "name", F.array_join("techniques", ",").alias("techniques"), "source_url")


def kb_mitigation_chunks(spark, d):
    return knowledge.mitigation_chunks(_bundle(spark, d)).select("chunk_id", "text")


def kb_naive_chunks(spark, d):
    return knowledge.naive_chunks(knowledge.techniques(_bundle(spark, d))).select("chunk_id", "text")


def kb_chunks(spark, d):
    return knowledge.chunks(knowledge.techniques(_bundle(spark, d))).select("chunk_id", "text")


def kb_procedure_chunks(spark, d):
    return knowledge.procedure_chunks(knowledge.techniques(_bundle(spark, d)), 300).select("chunk_id", F.size(F.split("text", "\n")).alias("lines"), F.md5(F.col("text").cast("binary")).alias("digest"))


def context_of_candidates(spark, d):
    """Each benchmark item's documents by source, as blocks within a budget."""
    docs = table(spark, d, "documents")
    c = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("rank"), F.coalesce("source", F.lit("none")).alias("attack_id"), F.coalesce("lang", F.lit("-")).alias("content_type"), F.coalesce("text", F.lit("")).alias("text"), F.lit("n").alias("name"), F.lit("technique").alias("object_type"), F.lit("u").alias("url"), (F.col("doc_id") % 5 == 0).alias("revoked"), F.lit(None).cast("boolean").alias("deprecated"))
    b = retrieve.context_blocks(c, 3_000, 400)
    return b.select("query_id", "place", "attack_id", F.length("block").alias("size"), F.md5(F.col("block").cast("binary")).alias("digest"))


def authority_order(spark, d):
    """Logs whose fields, pairs and running text say different things: which one counts."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    c = F.col("o_custkey").cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit('EventID=4688 CommandLine="a b '), c, F.lit('" SubjectUserName=field'), c, F.lit(" NewProcessName=N/A Message=x  New Process Name:  label.exe  Account Name:  other")))
        .when(k % 5 == 1, F.concat(F.lit('{"Message": "Process Name: text.exe, user=t'), c, F.lit('", "User": "json'), c, F.lit('"}')))
        .when(k % 5 == 2, F.concat(F.lit("the user: bob"), c, F.lit(" ran command line: x -y\nevent id: 4104 then stopped")))
        .when(k % 5 == 3, F.concat(F.lit("{Process Name=brace.exe, Event ID=4663, Odd=user: no"), c, F.lit("}")))
    )
    n = normalise.by_authority(o.select(k.alias("event_id"), raw.alias("raw")))
    return n.select("event_id", "format", "id", "process", "process_from", "command_line", "command_line_from", "account", "account_from")


def timeline_places(spark, d):
    """Every row of every entry of a user's timeline, numbered."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("sentence"), F.col("event_id").alias("row"), "ts")
    return normalise.timeline_rows(e, ["user_id"]).select("user_id", "sentence", "place", "row")


QUERIES = {f.__name__: f for f in (kb_techniques, kb_parent_child, kb_three_hop, kb_users, kb_tactics, kb_mitigations, kb_mitigation_chunks, kb_naive_chunks, kb_chunks, kb_procedure_chunks, context_of_candidates, authority_order, timeline_places)}

_U = """u AS (SELECT c_nationkey AS k, c_name, c_custkey % 2 = 0 AS g, CASE WHEN c_custkey % 4 > 0 THEN lower(c_mktsegment) END AS what, CASE WHEN c_custkey % 2 = 0 THEN 'intrusion-set' ELSE 'malware' END AS kind FROM customer),
m AS (SELECT s_nationkey AS k, count(*) AS n, string_agg('M' || s_suppkey, ', ' ORDER BY 'M' || s_suppkey) AS ids FROM supplier GROUP BY 1),
pr AS (SELECT k, c_name, kind, what, row_number() OVER (PARTITION BY k ORDER BY c_name, kind, what) AS i FROM u WHERE what IS NOT NULL),
tech AS (SELECT n_nationkey AS k, 'T' || n_nationkey AS id, n_name, n_nationkey % 5 = 4 AS sub, r_name, '[T' || n_nationkey || '] ' || n_name || CASE WHEN n_nationkey % 5 = 4 THEN ' (sub-technique)' ELSE ' (technique)' END || chr(10) || 'Tactics: ' || r_name || chr(10) || 'Platforms: -' AS head, CASE WHEN n_nationkey % 3 > 0 THEN 'about ' || n_name END AS told FROM nation JOIN region ON n_regionkey = r_regionkey),
ty AS (SELECT p_type AS type, row_number() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)),
an AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 6 THEN 'fallback ' || n_nationkey ELSE type END AS component, CASE WHEN n_nationkey % 2 = 0 THEN 'look at ' || n_nationkey END AS text FROM nation JOIN ty ON n_nationkey % (SELECT count(*) FROM ty) + 1 = place),
det AS (SELECT t.k, string_agg(DISTINCT component, ',' ORDER BY component) AS components, string_agg(DISTINCT text, chr(10) ORDER BY text) AS detection FROM tech t JOIN an ON an.k IN (t.k, (t.k + 1) % 25) GROUP BY t.k)"""
_LINES = "pr.*, '- ' || c_name || ' (' || kind || '): ' || what AS line"
ORACLE_SQL = {
    "kb_techniques": f"WITH {_U}, g AS (SELECT k, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS users FROM u GROUP BY 1) SELECT id AS attack_id, n_name AS name, sub AS is_subtechnique, CASE WHEN sub THEN 'T' || (tech.k - 4) END AS parent, r_name AS tactics, CAST(coalesce(n, 0) AS INTEGER) AS n_mitigations, coalesce(users, '') AS users FROM tech LEFT JOIN m USING (k) LEFT JOIN g USING (k)",
    "kb_parent_child": "SELECT 'T' || (n_nationkey - 4) AS parent, count(*) AS children, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation WHERE n_nationkey % 5 = 4 GROUP BY 1",
    "kb_three_hop": f"WITH {_U} SELECT 'T' || k AS attack_id, components, detection FROM det",
    "kb_users": f"WITH {_U}, a AS (SELECT k, count(DISTINCT c_name) FILTER (g) AS x, count(DISTINCT c_name) FILTER (NOT g) AS y FROM u GROUP BY 1), b AS (SELECT k, count(*) AS n, max(what) FILTER (i = 1) AS f FROM pr GROUP BY 1) SELECT id AS attack_id, CAST(coalesce(x, 0) AS INTEGER) AS n_groups, CAST(coalesce(y, 0) AS INTEGER) AS n_software, CAST(coalesce(n, 0) AS INTEGER) AS n_procedures, f AS \"first\" FROM tech LEFT JOIN a USING (k) LEFT JOIN b USING (k)",
    "kb_tactics": "SELECT 'TA' || r_regionkey AS attack_id, r_name AS name, 'r' || r_regionkey AS shortname, '' AS description, 'u' AS source_url, false AS deprecated FROM region",
    "kb_mitigations": "SELECT 'M' || s_suppkey AS attack_id, s_name AS name, 'T' || s_nationkey AS techniques, 'u' AS source_url FROM supplier",
    "kb_mitigation_chunks": "SELECT 'M' || s_suppkey || '::mitigation::0' AS chunk_id, '[M' || s_suppkey || '] ' || s_name || ' (mitigation)' || chr(10) || chr(10) || chr(10) || chr(10) || 'Techniques: T' || s_nationkey AS text FROM supplier",
    "kb_naive_chunks": f"""WITH {_U}, three AS (SELECT k, string_agg('- ' || c_name || ': ' || what, chr(10) ORDER BY i) AS t FROM pr WHERE i <= 3 GROUP BY 1)
SELECT id || '::naive::0' AS chunk_id, head || chr(10) || chr(10) || coalesce(told, '') || coalesce(chr(10) || chr(10) || 'Mitigations: ' || ids, '') || coalesce(chr(10) || chr(10) || 'Procedures:' || chr(10) || t, '') || coalesce(chr(10) || chr(10) || 'Detection: ' || detection, '') AS text FROM tech LEFT JOIN m USING (k) LEFT JOIN three USING (k) LEFT JOIN det USING (k)""",
    "kb_chunks": f"""WITH {_U}, t AS (SELECT * FROM tech LEFT JOIN det USING (k))
SELECT id || '::description::0' AS chunk_id, id || ' ' || n_name || ' [' || r_name || ']' || chr(10) || told AS text FROM t WHERE told IS NOT NULL UNION ALL SELECT id || '::detection::0', id || ' ' || n_name || ' [' || r_name || ']' || chr(10) || detection FROM t WHERE detection IS NOT NULL""",
    "kb_procedure_chunks": f"""WITH {_U}, l AS (SELECT {_LINES} FROM pr), c AS (SELECT l.k, i, line, head, greatest(1, round_even(round(len(string_split_regex(trim(line), '\\s+')) * 1.3, 6), 0)) AS cost, greatest(1, round_even(round(len(string_split_regex(trim(head), '\\s+')) * 1.3, 6), 0)) AS start FROM l JOIN tech ON tech.k = l.k),
b AS (SELECT *, (i - 1) // CAST(floor((300 - start) / cost) AS BIGINT) AS bucket FROM c)
SELECT 'T' || k || '::procedure_example::' || bucket AS chunk_id, CAST(count(*) + 5 - 1 AS INTEGER) AS lines, md5(max(head) || chr(10) || 'Procedures:' || chr(10) || string_agg(line, chr(10) ORDER BY i)) AS digest FROM b GROUP BY k, bucket""",
    "context_of_candidates": """WITH c AS (SELECT doc_id % 40 AS query_id, doc_id AS rank, coalesce(source, 'none') AS attack_id, '(' || coalesce(lang, '-') || ') ' || CASE WHEN length(coalesce(text, '')) > 400 THEN rtrim(left(text, 400), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) || ' [...]' ELSE coalesce(text, '') END AS t, doc_id % 5 = 0 AS revoked FROM documents),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8),
g AS (SELECT query_id, attack_id, min(rank) AS r, string_agg(t, chr(10) ORDER BY rank) AS body, arg_min(revoked, rank) AS revoked FROM f GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM g),
b AS (SELECT query_id, place, attack_id, '[' || place || '] ' || attack_id || ' | n | technique' || CASE WHEN revoked THEN ' | revoked' ELSE '' END || chr(10) || body || chr(10) || 'Source: u' AS block FROM p),
s AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY place) - 2 AS upto FROM b)
SELECT query_id, CAST(place AS INTEGER) AS place, attack_id, CAST(length(block) AS INTEGER) AS size, md5(block) AS digest FROM s WHERE upto <= 3000 OR place = 1""",
    "authority_order": """SELECT o_orderkey AS event_id, CASE o_orderkey % 5 WHEN 0 THEN 'space_kv' WHEN 1 THEN 'json' WHEN 3 THEN 'brace_kv' END AS format, CASE o_orderkey % 5 WHEN 0 THEN '4688' WHEN 2 THEN '4104' WHEN 3 THEN '4663' END AS id,
CASE o_orderkey % 5 WHEN 0 THEN 'label.exe' WHEN 1 THEN 'text.exe' WHEN 3 THEN 'brace.exe' END AS process, CASE o_orderkey % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'text' WHEN 3 THEN 'fields' END AS process_from,
CASE o_orderkey % 5 WHEN 0 THEN 'a b ' || o_custkey WHEN 2 THEN 'x -y' END AS command_line, CASE o_orderkey % 5 WHEN 0 THEN 'fields' WHEN 2 THEN 'text' END AS command_line_from,
CASE o_orderkey % 5 WHEN 0 THEN 'field' || o_custkey WHEN 1 THEN 'json' || o_custkey WHEN 2 THEN 'bob' || o_custkey WHEN 3 THEN 'no' || o_custkey END AS account, CASE o_orderkey % 5 WHEN 0 THEN 'fields' WHEN 1 THEN 'fields' WHEN 2 THEN 'text' WHEN 3 THEN 'text' END AS account_from FROM orders""",
    "timeline_places": "SELECT user_id, event_type AS sentence, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS place, event_id AS row FROM events",
}
