"""From one event to a verdict: the asset it touches, who acts, reviewers and their decisions, evidence kept and missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.text import basename, command_registry_paths, evidence_norm, first_present, trusted_folder
from tracewright.operators import assess, normalise
from tracewright.operators.rules import Condition, criticality, event_number

# Fields that name the object of an event, the actor's account and its program, in the order that they count.
OBJECT_FIELDS = ["object.name", "registry.path", "file.path"]
ACCOUNT_FIELDS = ["account.name", "user.name", "subject.user"]
COMMAND_FIELDS = ["process.command_line", "command_line", "process.args"]
# What a model's view of the evidence leads to.
ACTIONS = {"supports": ("abstain", None), "weak": ("downgrade", "low"), "absent": ("downgrade", "low")}
# How facts are called in a report.
FACT_NAMES = {"EventID": "event id", "NewProcessName": "program run", "ParentProcessName": "parent program", "CommandLine": "command line", "SubjectUserName": "acting account", "TargetUserName": "target account", "SourceIp": "source address", "DestinationIp": "destination address", "ServiceName": "service", "ImagePath": "program file", "ObjectName": "object", "ShareName": "share", "AccessMask": "access mask"}


def event_path(fields: Column) -> Column:
    """The path that an event is about: a field that names it, else the first registry path of the command line. What prose says is no evidence and isn't read."""
    named = first_present(*[fields[f] for f in OBJECT_FIELDS])
    return F.coalesce(named, F.get(command_registry_paths(first_present(*[fields[f] for f in COMMAND_FIELDS])), F.lit(0)))


def event_assets(rows: DataFrame, assets: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(row, path, level, family) of rows(row, fields MAP): the asset that an event touches; level is none for an event without a path and unknown for one that no asset covers."""
    paths = rows.select("row", event_path(F.col("fields")).alias("path"))
    found = criticality(paths.where("path is not null"), assets)
    return paths.join(found.select("row", "level", "family"), "row", "left").select("row", "path", F.coalesce("level", F.lit("none")).alias("level"), "family")


def actor(fields: Column) -> Column:
    """Struct of account, process (the program's name in lower case) and trusted, whether it lies in a trusted folder."""
    path = first_present(fields["process.path"], fields["process.name"])
    return F.struct(F.lower(first_present(*[fields[f] for f in ACCOUNT_FIELDS])).alias("account"), F.lower(basename(path)).alias("process"), trusted_folder(path).alias("trusted"))


def confirmed_evidence(decisions: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """(by, confirmed): how many decisions(by, technique, verdict) confirm one of accepted(by, technique). An abstention confirms nothing."""
    kept = decisions.where("verdict = 'confirm'").join(accepted.select(*by, "technique").distinct(), [*by, "technique"], "left_semi")
    return kept.groupBy(*by).agg(F.count("*").alias("confirmed"))


def verdicts(rows: DataFrame, accepted: DataFrame, decisions: DataFrame, assets: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(row, verdict, path, suppressed, level, family, access, techniques, confirmed): the whole way from an event's fields to its verdict.

    rows: row, fields MAP; accepted: row, technique; decisions: row, technique, verdict. A row without accepted techniques has none, and one without path no asset.
    """
    f = F.col("fields")
    told = rows.select("row", normalise.access(event_number(f), f)["access"].alias("access"), actor(f).alias("who"))
    n = accepted.groupBy("row").agg(F.count_distinct("technique").alias("techniques"))
    all_ = told.join(event_assets(rows, assets).drop("path"), "row").join(n, "row", "left").join(confirmed_evidence(decisions, accepted, ["row"]), "row", "left")
    expected = assess.expected_actors(rows.sparkSession).withColumn("_expected", F.lit(True))
    j = all_.join(F.broadcast(expected.select(F.col("family").alias("_f"), F.col("process").alias("_p"), F.col("account").alias("_a"), "_expected")), (F.col("family") == F.col("_f")) & (F.col("who.process") == F.col("_p")) & (F.col("who.account") == F.col("_a")), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    d = assess.event_decision(count("techniques"), count("confirmed"), F.col("level"), F.col("access"), F.coalesce("_expected", F.lit(False)) & F.col("who.trusted"))
    return j.withColumn("d", d).select("row", "d.verdict", "d.path", "d.suppressed", "level", "family", "access", count("techniques").alias("techniques"), count("confirmed").alias("confirmed"))


def assigned(findings: DataFrame, reviewers: list[tuple[str, str | None]], by: list[str]) -> DataFrame:
    """(by, technique, reviewer): which reviewer(name, technique) sees which of findings(by, technique): one without technique sees all, another only its own."""
    seen = F.array_compact(F.array(*[F.when(F.lit(t is None) | (F.col("technique") == F.lit(t)), F.lit(name)) for name, t in reviewers]))
    return findings.select(*by, "technique", F.explode(seen).alias("reviewer"))


def model_decision(evidence: Column, reason: Column, level: Column) -> Column:
    """Struct of verdict, downgrade_to and note for a model's view: unknown views and views without a reason abstain, and so does one that could not weaken the level."""
    view = F.lower(F.trim(evidence))
    say = lambda v, to, note: F.struct(F.lit(v).alias("verdict"), F.lit(to).cast("string").alias("downgrade_to"), F.lit(note).alias("note"))
    chain = F.when(F.coalesce(F.trim(reason), F.lit("")) == "", say("abstain", None, "no reason"))
    for name, (verdict, to) in ACTIONS.items():
        if to is not None:
            chain = chain.when((view == name) & (assess.level_rank(level) >= assess.level_rank(F.lit(to))), say("abstain", None, "no lower level"))
        chain = chain.when(view == name, say(verdict, to, "model"))
    return chain.otherwise(say("abstain", None, "unknown view"))


def added_techniques(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by, technique) that a review added, which it must not: empty for a review that keeps its contract."""
    return after.select(*by, "technique").distinct().join(before.select(*by, "technique").distinct(), [*by, "technique"], "left_anti")


def diagnosis(condition: Condition, fields: Column) -> Column:
    """Why a condition fails on a row: the field isn't there, its pattern doesn't match, or a forbidden one does; null if it holds."""
    v = F.nullif(fields[condition.field], F.lit(""))
    says = F.when(v.isNull(), f"{condition.field} is missing") if condition.must else F.when(F.lit(False), "")
    if condition.must:
        says = says.when(~v.rlike(condition.must), F.concat(F.lit(f"{condition.field} does not match /{condition.must}/: "), v))
    return says.when(v.rlike(condition.must_not), F.concat(F.lit(f"{condition.field} matches the forbidden /{condition.must_not}/: "), v)) if condition.must_not else says


def out_of_scope(path: Column, traces: list[tuple[str, str]]) -> Column:
    """Why a path was left out of the assets on purpose: the reason of the first of traces(trace, reason) that it contains, letter case aside; null if none."""
    low = F.lower(path)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(r)) for t, r in traces]) if traces else F.lit(None).cast("string")


def evidence_summary(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    """(row, detected, missing): facts(row, key, value) under their names, and of the terms that mappings(row, technique, text) need, those found and those not; each once, facts first."""
    name = F.create_map(*[F.lit(x) for kv in FACT_NAMES.items() for x in kv])
    told = facts.where("value is not null").select("row", F.lit(0).alias("k"), F.concat(F.coalesce(name[F.col("key")], F.col("key")), F.lit(": "), "value").alias("item"), F.lit(True).alias("found"))
    terms = [(t, x) for t, xs in assess.REQUIRED_TERMS.items() for x in xs]
    each = F.array_compact(F.array(*[F.when(F.col("technique") == t, F.struct(F.lit(f"{t} needs {x}").alias("item"), F.contains(evidence_norm(F.col("text")), F.lit(" ".join("".join(c if c.isalnum() and c.isascii() else " " for c in x.lower()).split()))).alias("found"))) for t, x in terms]))
    needs = mappings.select("row", F.explode(each).alias("e")).select("row", F.lit(1).alias("k"), "e.item", "e.found")
    once = told.unionByName(needs).groupBy("row", "item").agg(F.min("k").alias("k"), F.max("found").alias("found"))
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("k", "item")))), lambda x: x["item"])
    return once.groupBy("row").agg(part(F.col("found")).alias("detected"), part(~F.col("found")).alias("missing"))


def component_sets(tables: list[DataFrame]) -> DataFrame:
    """(event_id, components): the data components of an id in all of tables(event_id, components ARRAY), each once, in order."""
    every = reduce(lambda a, b: a.unionByName(b), tables)
    return every.select("event_id", F.explode("components").alias("c")).groupBy("event_id").agg(F.array_sort(F.collect_set("c")).alias("components"))


def names_any(text: Column, words: list[str]) -> Column:
    """Whether a question names any of the words, letter case aside."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(False))


def reputation(status: Column, malicious: Column, suspicious: Column) -> Column:
    """An address's reputation in words."""
    return (
        F.when(status == "rate_limited", "not looked up: quota used")
        .when(status == "not_found", "no record")
        .when(status == "disabled", "look-ups are off")
        .when(F.coalesce(status != "ok", F.lit(True)), "not looked up")
        .when(malicious > 0, F.concat(F.lit("malicious ("), malicious.cast("string"), F.lit(" engines)")))
        .when(suspicious > 0, F.concat(F.lit("suspicious ("), suspicious.cast("string"), F.lit(" engines)")))
        .otherwise("clean")
    )


def lookup_queue(seen: DataFrame, cached: DataFrame, quota: int = 10) -> DataFrame:
    """(value, first, place, looked_up) of seen(value, ord): public addresses in order of first sight; those cached cost nothing, and of the others the first `quota` are looked up."""
    from pyspark.sql import Window

    from tracewright.functions.text import is_public_ip

    first = seen.where(is_public_ip(F.col("value"))).groupBy("value").agg(F.min("ord").alias("first"))
    fresh = first.join(cached.select("value").distinct(), "value", "left_anti")
    place = F.row_number().over(Window.orderBy("first", "value"))
    few = fresh.orderBy("first", "value").limit(quota).withColumn("place", place)
    known = first.join(cached.select("value").distinct(), "value", "left_semi").withColumn("place", F.lit(None).cast("int"))
    return few.unionByName(known)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with place, a shuffle that a seed fixes: the order of a hash of key and seed."""
    return rows.withColumn("place", F.xxhash64(F.col(key), F.lit(seed)))
