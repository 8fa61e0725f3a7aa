"""Bulk runs: numbered items, sources to collect, several events of an alarm as one, quotes for the reader, counts of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.text import stripped
from tracewright.operators.rules import log_source
from tracewright.workspace import materialize

#: Events that a merged technique lists.
LISTED = 1_000
#: Rows that one task numbers.
RUN = 100_000


def numbered(rows: DataFrame, order: str | list[str]) -> DataFrame:
    """rows with index from 0 in the order of a column of whole numbers, or of several columns of any kind, nulls first, without gaps. Runs of the order are counted first, so no task numbers more than a run."""
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda runs: runs.groupBy("_run").agg(F.count("*").alias("_n")).select(F.col("_run").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if isinstance(order, str):
        runs = rows.withColumn("_run", F.floor(F.col(order) / RUN))
        offsets, place = count(runs), F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1
    else:  # ranges of the order, sorted, with each row's place in its range; written down, since the ranges of another run could differ
        ascending = [F.col(c).asc_nulls_first() for c in order]
        placed = {"_run": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
        runs = materialize(rows.repartitionByRange(*ascending).sortWithinPartitions(*ascending).withColumns(placed), "runs")
        offsets, place = F.broadcast(materialize(count(runs), "offsets")), F.col("_in")
    return runs.join(offsets, F.col("_run").eqNullSafe(F.col("_of"))).withColumn("index", F.col("_offset") + place).drop("_run", "_of", "_offset", "_in")


def incident_ids(incidents: DataFrame, key: str = "incident") -> DataFrame:
    """incidents with id: INC-1, INC-2 and so on in the order of key, the incident's smallest row; equal keys are numbered in any order."""
    return numbered(incidents, [key]).withColumn("id", F.concat(F.lit("INC-"), (F.col("index") + 1).cast("string"))).drop("index")


def platform_override(c: Column) -> Column:
    """The platform that a column names; null if it is none of the known."""
    v = F.lower(stripped(c))
    return F.when(F.startswith(v, F.lit("win")), "Windows").when(F.startswith(v, F.lit("lin")) | v.isin("ubuntu", "debian", "rhel"), "Linux").when(v.isin("macos", "mac", "osx", "mac os", "darwin"), "macOS")


def required_sources(ids: DataFrame) -> DataFrame:
    """(source, ids) of ids(id, ord): which logs to collect, ids in their order, once each."""
    first = ids.where("id is not null").groupBy("id").agg(F.min("ord").alias("ord")).withColumn("source", log_source(F.col("id")))
    return first.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))


def merged_alarm(mappings: DataFrame, by: list[str]) -> DataFrame:
    """(by, technique, level, events) of mappings(by, event, technique, level): each technique once, as its first event has it, with the first LISTED of the events it was seen in; alarm_events has them all."""
    key = [*by, "technique"]
    first = F.min(F.struct("event", "level")).alias("f")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("event"))
    listed = alarm_events(mappings, by).withColumn("_n", place).where(F.col("_n") <= LISTED).groupBy(*key).agg(F.array_sort(F.collect_list("event")).alias("events"))
    right = listed.select(*[F.col(c).alias(f"_{c}") for c in key], "events")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return mappings.groupBy(*key).agg(first).join(right, same, "left").select(*key, F.col("f.level").alias("level"), F.coalesce("events", F.array().cast(listed.schema["events"].dataType)).alias("events"))


def alarm_events(mappings: DataFrame, by: list[str]) -> DataFrame:
    """(by, technique, event) once each: every event of every technique of merged_alarm, a row each."""
    return mappings.where("event is not null").select(*by, "technique", "event").distinct()


def evidence_text(quotes: Column, reasoning: Column, technique: Column) -> Column:
    """The first quote that is no raw log (key=value pairs, or over 240 letters), else the reasoning, else the first quote, else the technique."""
    plain = F.filter(quotes, lambda q: ~(q.rlike(r"\w+=\S+.*\w+=\S+") | (F.length(q) > 240)))
    return F.coalesce(F.get(plain, F.lit(0)), F.nullif(F.trim(reasoning), F.lit("")), F.get(quotes, F.lit(0)), technique)


def without_rejected(candidates: DataFrame, rejected: DataFrame, by: list[str]) -> DataFrame:
    """Candidates of a second pass: techniques that the first rejected don't come again."""
    return candidates.join(rejected.select(*by, "technique").distinct(), [*by, "technique"], "left_anti")


def noise_counts(rows: DataFrame, families: dict[str, str], text: str) -> DataFrame:
    """(family, before, after) of rows(kept BOOLEAN, text): how many rows each pattern takes, before and after review."""
    kind = F.lit("other")
    for name, pattern in reversed(families.items()):
        kind = F.when(F.col(text).rlike(pattern), name).otherwise(kind)
    return rows.groupBy(kind.alias("family")).agg(F.count("*").alias("before"), F.count_if("kept").alias("after"))


def usage_deltas(counters: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Counters that only grow, as what each reading adds: (by, order, added, total)."""
    w = Window.partitionBy(by).orderBy(order)
    added = F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))
    return counters.select(by, order, added.alias("added"), F.col(value).alias("total"))


def two_tries(rows: DataFrame, key: str, attempt) -> DataFrame:
    """attempt(rows) gives a row for each with error null or told; those that failed are tried once more, and the second answer counts."""
    first = materialize(attempt(rows), "try")
    failed = rows.join(first.where("error is not null").select(key), key, "left_semi")
    return first.where("error is null").unionByName(attempt(failed))
