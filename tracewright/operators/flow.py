"""From rows of a log table to incidents: the whole way, each step one of the other operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions import logparse
from tracewright.functions.text import basename, norm_key, present
from tracewright.operators import correlate, incident, report, rules
from tracewright.operators.batch import numbered
from tracewright.sources import catalog
from tracewright.sources.readers import canonical_columns, positions, timestamp
from tracewright.workspace import materialize

# Fields that relate rows; and the tactic names of the rules' ids.
SHARED = ["Hostname", "SubjectUserName", "SourceIp", "DestinationIp", "LogonId", "SessionId", "ServiceName", "FilePath"]
TACTIC_NAMES = {"TA0001": "Initial Access", "TA0002": "Execution", "TA0003": "Persistence", "TA0004": "Privilege Escalation", "TA0005": "Stealth", "TA0006": "Credential Access", "TA0007": "Discovery", "TA0008": "Lateral Movement", "TA0009": "Collection", "TA0010": "Exfiltration", "TA0011": "Command And Control", "TA0040": "Impact", "TA0112": "Defense Impairment"}
#: Indicators that an incident lists, the first seen; indicators() has them all.
INDICATORS = 500
#: A rule has no score of its own; its level stands for one.
LEVEL_SCORES = {"high": 0.9, "medium": 0.6, "low": 0.3, "insufficient": 0.1}


def items(table: DataFrame) -> DataFrame:
    """(row, ts, raw, fields, the fields that relate rows): rows under their fields' names, as key=value text and as a map.

    Rows are numbered as they stand in the table's files, whatever the splits; those of other tables by time and then by text, where rows of equal text are interchangeable.
    """
    place = positions(table)
    named = canonical_columns(table, *place)
    columns = [c for c in named.columns if c not in ("CommandLine", "_file", "_block", "_place")] + (["CommandLine"] if "CommandLine" in named.columns else [])
    field = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    ts = timestamp(field("Timestamp")).cast("timestamp_ntz")
    order = numbered(named.withColumns({"_ts": ts, "_raw": logparse.serialised(named, {c: c for c in columns})}), ["_file", "_block", "_place"] if place else ["_ts", "_raw"])
    lineage = {"process_guid": "ProcessGuid", "parent_process_guid": "ParentProcessGuid", "process_id": "ProcessId", "parent_process_id": "ParentProcessId"}
    return order.select(F.col("index").cast("bigint").alias("row"), F.col("_ts").alias("ts"), F.col("_raw").alias("raw"), column_fields(columns).alias("fields"), *[field(c).alias(c) for c in SHARED], *[field(c).alias(new) for new, c in lineage.items()])


def column_fields(columns: list[str]) -> Column:
    """The field map of a row whose columns are fields already, as parsing its key=value text (_raw) would give it: canonical and older names, names from paths, and Message with the text."""
    of = {re.sub(r"[\s_]+", "", a).lower(): k for k, names in catalog.FIELDS.items() for a in [k, *names]}
    value = {}
    for c in columns:
        value.setdefault(of.get(re.sub(r"[\s_]+", "", c).lower(), f"unknown.{c}"), F.nullif(F.trim(F.col(c)), F.lit("")))
    for name, path in catalog.DERIVED.items():
        if path in value:
            value[name] = F.coalesce(value[name], basename(present(value[path]))) if name in value else basename(present(value[path]))
    named = {**value, **{catalog.LEGACY[k]: v for k, v in value.items() if k in catalog.LEGACY}}
    nested = [logparse.pairs(v, logparse.log_format(v)) for k, v in value.items() if k in catalog.NESTED]
    named.pop("Message", None)
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named.items()]), lambda e: e["value"].isNotNull())
    if nested:  # a log within the log fills what the columns leave open
        known = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
        inner = F.transform(nested[0], lambda p: F.struct(F.coalesce(known[norm_key(p["key"])], F.concat(F.lit("unknown."), p["key"])).alias("key"), p["value"].alias("value")))
        older = F.create_map(*[F.lit(x) for kv in catalog.LEGACY.items() for x in kv])
        both = F.concat(inner, F.filter(F.transform(inner, lambda p: F.struct(older[p["key"]].alias("key"), p["value"].alias("value"))), lambda p: p["key"].isNotNull()))
        fresh = F.filter(both, lambda p, i: (p["key"] != "Message") & ~F.exists(F.slice(both, F.lit(1), i), lambda q: q["key"] == p["key"]) & ~F.exists(entries, lambda e: e["key"] == p["key"]))
        entries = F.concat(entries, fresh)
    return F.map_from_entries(F.concat(entries, F.array(F.struct(F.lit("Message").alias("key"), F.coalesce("_raw", F.lit("")).alias("value")))))


def rule_hits(rows: DataFrame, catalogue: list[rules.Rule]) -> DataFrame:
    """(row, rule) for each of rows(row, fields) and rule that matches it, on evidence that its technique allows; rules that need several rows need them among all."""
    table = F.broadcast(rules.rule_table(rows.sparkSession, catalogue))
    found = materialize(rules.allowed_hits(rows.select("row", "fields"), catalogue), "hits")
    few = found.join(F.broadcast(table.where("min_events > 1")), "rule").groupBy("rule", "min_events").agg(F.count_distinct("row").alias("n")).where("n < min_events")
    return found.join(F.broadcast(few.select("rule")), "rule", "left_anti")


def techniques_of(hits: DataFrame, member: DataFrame, catalogue: list[rules.Rule]) -> DataFrame:
    """(incident, technique, level, max_score, tactics) of hits(row, rule) and member(row, incident): the strongest level of the rules that an incident's rows match, and their tactics."""
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    each = hits.join(member, "row").select("incident", "rule").distinct().join(F.broadcast(rules.rule_table(hits.sparkSession, catalogue)), "rule")
    best = each.groupBy("incident", "technique").agg(F.min(F.struct("rank", "level")).alias("b"), F.array_sort(F.collect_set(F.coalesce(of(TACTIC_NAMES)[F.col("tactic")], F.col("tactic")))).alias("tactics"))
    return best.select("incident", "technique", F.col("b.level").alias("level"), of(LEVEL_SCORES)[F.col("b.level")].alias("max_score"), "tactics")


def incidents(table: DataFrame, catalogue: list[rules.Rule] | None = None, hours: float = correlate.HOURS) -> DataFrame:
    """A row each incident: its rows, time, strong and weak techniques, attack chain, risk, host and account, indicators and a report.

    Rows are related within hours; a row that is related to none is in no incident, whatever its techniques.
    """
    catalogue, by = catalogue or rules.catalogue(), ["incident"]
    rows = items(table)
    member = materialize(correlate.incident_groups(rows, SHARED, hours), "members")
    techniques = techniques_of(rule_hits(rows, catalogue), member, catalogue)
    techniques = materialize(techniques.withColumn("strong", incident.is_strong(F.col("level"), F.col("max_score"))), "techniques")
    strong = techniques.where("strong").withColumn("score", F.col("max_score"))
    chain = report.chain_line(incident.attack_chain(strong, by), by)
    risk = incident.risk_scores(strong, by)
    names = techniques.groupBy("incident").agg(F.array_sort(F.collect_list(F.when(F.col("strong"), F.col("technique")))).alias("techniques"), F.array_sort(F.collect_list(F.when(~F.col("strong"), F.col("technique")))).alias("weak"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in [("host", "Hostname"), ("account", "SubjectUserName"), ("ip", "SourceIp"), ("ip", "DestinationIp"), ("file", "FilePath"), ("service", "ServiceName")]])
    # one count of values serves the indicators and the most common host and account, and the value of no kind that every row has the rows and times
    told = F.concat(F.filter(kinds, lambda x: F.trim(x["value"]) != ""), F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))))
    inside = rows.select("row", "ts", *SHARED).join(member, "row").select("incident", "row", "ts", F.explode(told).alias("x"))
    every = materialize(inside.groupBy("incident", "x.kind", "x.value").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "values")
    values = every.where("kind is not null")
    seen = values.groupBy("incident", "kind", F.lower("value")).agg(F.min(F.struct("first", "value")).alias("f"))
    place = F.row_number().over(Window.partitionBy("incident").orderBy("f", "kind"))
    listed = seen.withColumn("_n", place).where(F.col("_n") <= INDICATORS).groupBy("incident").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "f.value"))).alias("indicators"))
    most = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("n", (-F.col("first")).alias("o"), "value")))["value"]
    common = values.groupBy("incident").agg(most("host").alias("host"), most("account").alias("account"), F.count("*").alias("n_values"))
    span = every.where("kind is null").select("incident", F.col("n").alias("n_rows"), "first_ts", "last_ts")
    out = span
    for part in (risk, chain, names, listed, common.drop("n_values")):
        out = out.join(part, "incident", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"score": F.coalesce("score", F.lit(0)), "severity": F.coalesce("severity", F.lit("Low")), "phases": F.coalesce("phases", F.lit(0).cast("bigint")), "techniques": F.coalesce("techniques", none), "weak": F.coalesce("weak", none), "indicators": F.coalesce("indicators", none)}).drop("n_techniques")
    return out.withColumn("report", report.markdown_text())
