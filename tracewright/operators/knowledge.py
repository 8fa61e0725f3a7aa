"""Knowledge base from a graph of objects and relationships: techniques with parents, mitigations, users and detection components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.text import estimated_tokens
from tracewright.operators.retrieve import greedy_chunks

OBJECT = "id string, type string, name string, description string, external_references array<struct<source_name:string,external_id:string,url:string>>, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, x_mitre_is_subtechnique boolean, x_mitre_platforms array<string>, x_mitre_shortname string, x_mitre_deprecated boolean, revoked boolean, created string, modified string, relationship_type string, source_ref string, target_ref string, x_mitre_analytic_refs array<string>, x_mitre_log_source_references array<struct<x_mitre_data_component_ref:string,name:string>>"


def load_bundle(spark, path: str) -> DataFrame:
    """The objects of a bundle file, a row each."""
    return spark.read.schema(f"objects array<struct<{OBJECT.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array<', ':array<')}>>").json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")


def external_id(objects: DataFrame) -> DataFrame:
    ref = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))
    return objects.withColumn("attack_id", ref["external_id"]).withColumn("url", ref["url"])


def related(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where(F.col("type") == "relationship").where(F.col("relationship_type") == kind).select("source_ref", "target_ref", "description")


def first_edge(edges: DataFrame, src: str, dst: str, order: str) -> DataFrame:
    """One edge of each src, the first in order."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy(src).orderBy(order))).where("_n = 1").select(src, dst)


def techniques(objects: DataFrame) -> DataFrame:
    """A row each technique, by equal joins over the edges: attack_id, name, is_subtechnique, parent, tactics, platforms, mitigations, users, components, revoked, revoked_by, then object_type,
    description, groups, software, procedures (actor, actor_type, description), detection, created, modified, deprecated and source_url.

    Relations of one technique fit a cell: they number some hundreds.
    """
    o = external_id(objects.where(F.col("type") != "relationship"))
    t = o.where(F.col("type") == "attack-pattern")
    name = o.select(F.col("id").alias("_id"), F.col("attack_id").alias("_aid"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    tactic = o.where(F.col("type") == "x-mitre-tactic").select(F.col("x_mitre_shortname").alias("phase_name"), F.col("name").alias("tactic"))
    phases = t.select("id", F.posexplode("kill_chain_phases").alias("n", "p")).select("id", "n", F.col("p.phase_name").alias("phase_name")).join(tactic, "phase_name")
    tactics = phases.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "tactic"))), lambda x: x["tactic"]).alias("tactics"))
    parents = first_edge(related(objects, "subtechnique-of"), "source_ref", "target_ref", "target_ref").join(name, F.col("target_ref") == F.col("_id")).select(F.col("source_ref").alias("id"), F.col("_aid").alias("parent"))
    successors = first_edge(related(objects, "revoked-by"), "source_ref", "target_ref", "target_ref").join(name, F.col("target_ref") == F.col("_id")).select(F.col("source_ref").alias("id"), F.col("_aid").alias("revoked_by"))
    mitigations = related(objects, "mitigates").join(name.where("_type = 'course-of-action'"), F.col("source_ref") == F.col("_id")).groupBy(F.col("target_ref").alias("id")).agg(F.array_sort(F.collect_set("_aid")).alias("mitigations"))
    users = related(objects, "uses").join(name.where("_type in ('intrusion-set', 'malware', 'tool')"), F.col("source_ref") == F.col("_id")).groupBy(F.col("target_ref").alias("id")).agg(F.array_sort(F.collect_set("_name")).alias("users"))
    analytics = objects.where(F.col("type") == "x-mitre-analytic").select(F.col("id").alias("analytic"), F.explode_outer("x_mitre_log_source_references").alias("l")).select("analytic", F.col("l.x_mitre_data_component_ref").alias("component"), F.col("l.name").alias("fallback"))
    strategies = objects.where(F.col("type") == "x-mitre-detection-strategy").select(F.col("id").alias("strategy"), F.explode("x_mitre_analytic_refs").alias("analytic"))
    found = related(objects, "detects").select(F.col("source_ref").alias("strategy"), F.col("target_ref").alias("id")).join(strategies, "strategy").join(analytics, "analytic").join(name, F.col("component") == F.col("_id"), "left")
    components = found.groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("_name", "fallback"))).alias("components"))
    by_whom = related(objects, "uses").withColumnRenamed("description", "_what").join(name.where("_type in ('intrusion-set', 'malware', 'tool')"), F.col("source_ref") == F.col("_id"))
    pick = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("_type").isin(*kinds), F.col("_name"))))
    example = F.when(F.coalesce(F.trim("_what"), F.lit("")) != "", F.struct(F.col("_name").alias("actor"), F.col("_type").alias("actor_type"), F.trim("_what").alias("description")))
    procedures = by_whom.groupBy(F.col("target_ref").alias("id")).agg(pick("intrusion-set").alias("groups"), pick("malware", "tool").alias("software"), F.array_sort(F.collect_list(example)).alias("procedures"))
    texts = objects.where(F.col("type") == "x-mitre-analytic").select(F.col("id").alias("analytic"), F.nullif(F.trim("description"), F.lit("")).alias("_text"))
    detection = related(objects, "detects").select(F.col("source_ref").alias("strategy"), F.col("target_ref").alias("id")).join(strategies, "strategy").join(texts, "analytic").where("_text is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("_text")), "\n").alias("detection"))
    out = t
    for extra in (tactics, parents, successors, mitigations, users, components, procedures, detection):
        out = out.join(extra, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("attack_id", "name", F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"), "parent", F.coalesce("tactics", none).alias("tactics"), F.coalesce("x_mitre_platforms", none).alias("platforms"), F.coalesce("mitigations", none).alias("mitigations"), F.coalesce("users", none).alias("users"), F.coalesce("components", none).alias("components"), F.coalesce("revoked", F.lit(False)).alias("revoked"), "revoked_by",
        F.when(F.col("x_mitre_is_subtechnique"), "sub-technique").otherwise("technique").alias("object_type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("groups", none).alias("groups"), F.coalesce("software", none).alias("software"),
        F.coalesce("procedures", F.array().cast("array<struct<actor:string,actor_type:string,description:string>>")).alias("procedures"), "detection", "created", "modified", F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"), F.col("url").alias("source_url"))


def tactics(objects: DataFrame) -> DataFrame:
    """(attack_id, name, shortname, description, source_url, deprecated) of each tactic."""
    o = external_id(objects.where(F.col("type") == "x-mitre-tactic"))
    return o.select("attack_id", "name", F.col("x_mitre_shortname").alias("shortname"), F.coalesce("description", F.lit("")).alias("description"), F.col("url").alias("source_url"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"))


def mitigations(objects: DataFrame) -> DataFrame:
    """(attack_id, name, description, techniques, source_url, deprecated) of each mitigation; techniques are the ids that it counters, in order."""
    o = external_id(objects.where(F.col("type") != "relationship"))
    ids = related(objects, "mitigates").join(o.where(F.col("type") == "attack-pattern").select(F.col("id").alias("target_ref"), F.col("attack_id").alias("_aid")), "target_ref").groupBy(F.col("source_ref").alias("id")).agg(F.array_sort(F.collect_set("_aid")).alias("techniques"))
    m = o.where(F.col("type") == "course-of-action").join(ids, "id", "left")
    return m.select("attack_id", "name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"), F.col("url").alias("source_url"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"))


def chunks(kb: DataFrame) -> DataFrame:
    """(chunk_id, attack_id, content_type, text): description and detection of each technique of kb(attack_id, name, tactics, description, detection); blank ones have none."""
    head = F.concat(F.col("attack_id"), F.lit(" "), F.col("name"), F.lit(" ["), F.array_join("tactics", ", "), F.lit("]\n"))
    parts = F.array(*[F.struct(F.lit(k).alias("content_type"), F.concat(head, F.col(k)).alias("text")) for k in ("description", "detection")])
    full = kb.withColumns({"description": F.nullif(F.trim("description"), F.lit("")), "detection": F.nullif(F.trim("detection"), F.lit(""))})
    return full.select("attack_id", F.explode(F.filter(parts, lambda p: p["text"].isNotNull())).alias("p")).select(F.concat_ws("::", "attack_id", "p.content_type", F.lit("0")).alias("chunk_id"), "attack_id", "p.content_type", "p.text")


def _head(kb: DataFrame) -> Column:
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("-")
    return F.concat(F.lit("["), F.col("attack_id"), F.lit("] "), F.col("name"), F.lit(" ("), F.col("object_type"), F.lit(")\nTactics: "), listed("tactics"), F.lit("\nPlatforms: "), listed("platforms"))


def procedure_chunks(kb: DataFrame, limit: int = 600) -> DataFrame:
    """(chunk_id, attack_id, content_type, text): the procedures of each technique, packed in order into chunks of about limit tokens, each under the technique's head."""
    head = _head(kb)
    lines = kb.select("attack_id", head.alias("head"), F.posexplode("procedures").alias("n", "p")).withColumn("line", F.concat(F.lit("- "), "p.actor", F.lit(" ("), "p.actor_type", F.lit("): "), "p.description"))
    start = lines.withColumn("cost", estimated_tokens(F.col("line"))).withColumn("start", estimated_tokens(F.col("head")))
    bucket = greedy_chunks(start, "attack_id", "n", "cost", limit, "start").select("attack_id", "n", "bucket")
    dealt = start.join(bucket, ["attack_id", "n"])
    packed = dealt.groupBy("attack_id", "head", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return packed.select(F.concat_ws("::", "attack_id", F.lit("procedure_example"), "bucket").alias("chunk_id"), "attack_id", F.lit("procedure_example").alias("content_type"), F.concat("head", F.lit("\nProcedures:\n"), "body").alias("text"))


def naive_chunks(kb: DataFrame) -> DataFrame:
    """(chunk_id, attack_id, content_type, text): one large chunk each technique, to compare with: description, mitigations, the first three procedures, detection."""
    three = F.array_join(F.transform(F.slice("procedures", 1, 3), lambda p: F.concat(F.lit("- "), p["actor"], F.lit(": "), p["description"])), "\n")
    parts = [_head(kb), F.lit(""), F.col("description"), F.when(F.size("mitigations") > 0, F.concat(F.lit("\nMitigations: "), F.array_join("mitigations", ", "))), F.when(F.size("procedures") > 0, F.concat(F.lit("\nProcedures:\n"), three)), F.concat(F.lit("\nDetection: "), "detection")]
    return kb.select(F.concat(F.col("attack_id"), F.lit("::naive::0")).alias("chunk_id"), "attack_id", F.lit("naive_full").alias("content_type"), F.concat_ws("\n", *parts).alias("text"))


def mitigation_chunks(objects: DataFrame) -> DataFrame:
    """(chunk_id, attack_id, content_type, text): each mitigation with the techniques that it counters, in order."""
    o = external_id(objects.where(F.col("type") != "relationship"))
    counters = related(objects, "mitigates").join(o.select(F.col("id").alias("target_ref"), F.col("attack_id").alias("_aid")), "target_ref").groupBy(F.col("source_ref").alias("id")).agg(F.array_sort(F.collect_set("_aid")).alias("ids"))
    m = o.where(F.col("type") == "course-of-action").join(counters, "id", "left")
    text = F.concat(F.lit("["), "attack_id", F.lit("] "), "name", F.lit(" (mitigation)\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\nTechniques: "), F.coalesce(F.array_join("ids", ", "), F.lit("-")))
    return m.select(F.concat(F.col("attack_id"), F.lit("::mitigation::0")).alias("chunk_id"), "attack_id", F.lit("mitigation").alias("content_type"), text.alias("text"))
