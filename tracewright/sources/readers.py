"""Readers of logs, exports and bundles, and writers of results."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tracewright.functions.text import last_of_each, present, runs_after

# Column names of log tables and the field each stands for, blanks, case and underscores aside.
COLUMNS = {
    "NewProcessName": ["processname", "process", "newprocessname", "image"],
    "SubjectUserName": ["user", "username", "subjectusername", "useraccount"],
    "EventID": ["eventid"],
    "CommandLine": ["commandline", "command"],
    "Hostname": ["hostname", "computer", "computername"],
    "SourceIp": ["sourceip", "srcip", "sourceaddress", "src"],
    "DestinationIp": ["destinationip", "dstip", "destip", "destinationaddress", "dst"],
    "ProcessGuid": ["processguid"],
    "ParentProcessGuid": ["parentprocessguid"],
    "ProcessId": ["processid", "newprocessid", "pid"],
    "ParentProcessId": ["parentprocessid", "ppid"],
    "LogonId": ["logonid", "targetlogonid"],
    "SessionId": ["sessionid"],
    "ServiceName": ["servicename"],
    "FilePath": ["filepath", "targetfilename"],
    "Timestamp": ["timestamp", "eventtime", "utctime", "@timestamp"],
}
# Endings of the labels in an export's message, the first that has a value counts.
LABELS = {
    "SubjectUserName": ["Account Name"],
    "LogonId": ["Logon ID"],
    "ProcessId": ["Process ID", "New Process ID"],
    "NewProcessName": ["New Process Name", "Process Name", "Application Name"],
    "ServiceName": ["Service Name"],
    "SourceIp": ["Source Address"],
    "DestinationIp": ["Destination Address"],
    "SourcePort": ["Source Port"],
    "DestinationPort": ["Destination Port"],
    "FilePath": ["Object Name"],
}
#: Tags that a payload has, each at the beginning of a tab-separated part or of the text.
TAGS = ("AgentDevice", "EventID", "Message")
#: Shortest and longest label of an export's message.
LABEL_LENGTHS = (2, 41)
#: Rows that the payload column is chosen by, and the share of them that must look like one.
SAMPLE, LEAST = 20, 0.6
FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd")


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as text, so that a number with blanks in its column keeps its digits; empty cells are null."""
    return spark.read.csv(path, header=header, inferSchema=False, multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, scalars as text. Anything else is an error."""
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    if df.columns == ["_corrupt_record"]:
        raise ValueError(f"{path}: not a list of objects")
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """By the file's name: a header-less export or a table from .csv, else JSON."""
    if path.lower().endswith(".csv"):
        export = read_export(spark, path)
        return export if export is not None else read_csv(spark, path)
    return read_json(spark, path)


def looks_like_payload(c: Column) -> Column:
    """Whether the text has all of TAGS in their order, the second with a number."""
    at = [F.instr(c, f"{t}=") for t in TAGS]
    return (at[0] > 0) & (at[0] < at[1]) & (at[1] < at[2]) & F.substring(c, at[1] + len(TAGS[1]) + 1, F.lit(1)).between("0", "9")


def payload_column(df: DataFrame) -> str | None:
    """Of the first SAMPLE rows, the column that most often looks like a payload, LEAST of them at least; of equal ones the leftmost."""
    if not df.columns:
        return None
    share = df.limit(SAMPLE).agg(*[F.avg(F.coalesce(looks_like_payload(F.col(f"`{c}`")).cast("int"), F.lit(0))).alias(c) for c in df.columns]).first()
    best = max(df.columns, key=lambda c: share[c] or 0.0)
    return best if (share[best] or 0.0) >= LEAST else None


def tagged(payload: Column) -> Column:
    """A map of the parts Key=value between tabs; Message takes the rest of the text. Of a repeated key the last value counts."""
    at = F.instr(payload, "\tMessage=")
    head = F.when(at > 0, F.substring(payload, F.lit(1), at - 1)).otherwise(payload)
    message = F.when(at > 0, F.substring(payload, at + len("\tMessage="), F.length(payload))).otherwise("")
    parts = F.transform(F.split(head, "\t"), lambda p: F.struct(F.regexp_extract(p, r"([A-Za-z_]\w*+)=", 1).alias("k"), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)).alias("v")))
    return F.map_from_entries(F.concat(last_of_each(F.filter(parts, lambda p: ~p["k"].isin("", "Message")), "k", "v"), F.array(F.struct(F.lit("Message").alias("k"), message.alias("v")))))


def message_labels(message: Column) -> Column:
    """(k, v) of a message's labelled values: pieces between double blanks or line ends; one that begins with a label opens a pair, and any other goes on with the value
    before it. A label has 2 to 41 letters, digits, blanks and slashes before its colon, the first a capital. Of a repeated label the last value counts, at its first place."""
    name = lambda piece: F.substring_index(piece, ":", 1)

    def opens(piece: Column) -> Column:
        label = name(piece)
        plain = F.translate(F.upper(label), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 /", "") == ""
        return F.contains(piece, F.lit(":")) & F.length(label).between(*LABEL_LENGTHS) & plain & F.substring(label, 1, 1).between("A", "Z")

    def pair(x: Column) -> Column:
        head = x["head"]
        first = F.trim(F.substring(head, F.length(name(head)) + 2, F.length(head)))
        return F.struct(F.trim(name(head)).alias("k"), F.trim(F.concat_ws("  ", first, F.nullif(x["rest"], F.lit("")))).alias("v"))

    found = runs_after(F.split(F.trim(message), r"\s\s\s*+"), opens, "  ")
    return F.coalesce(last_of_each(F.transform(found, pair), "k", "v"), F.array().cast("array<struct<k:string,v:string>>"))


def read_export(spark: SparkSession, path: str) -> DataFrame | None:
    """A header-less export, a row each, with Timestamp (UTC), EventID, Hostname, Message and the message's labelled values; None if no column looks like a payload."""
    df = read_csv(spark, path, header=False)
    column = payload_column(df)
    return None if column is None else export_rows(df.select(F.col(f"`{column}`").alias("payload")))


def export_rows(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("t", tagged(F.col("payload"))).withColumn("m", F.col("t")["Message"])
    p = p.withColumn("labels", F.filter(message_labels(F.col("m")), lambda x: present(x["v"]).isNotNull()))
    pick = lambda ends: F.get(F.filter("labels", lambda x: reduce(lambda a, b: a | b, [F.endswith(x["k"], F.lit(e)) for e in ends])), F.lit(0))["v"]
    seconds = F.regexp_extract(F.col("t")["TimeGenerated"], r"^(\d+)$", 1).try_cast("bigint")
    return p.select(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("t")["EventID"].alias("EventID"), F.col("t")["Computer"].alias("Hostname"), F.nullif(F.col("m"), F.lit("")).alias("Message"), *[pick(ends).alias(name) for name, ends in LABELS.items()])


def positions(df: DataFrame) -> list[Column]:
    """Columns that order rows as they stand in the files df reads, however those are split; none if df isn't read from files as it is."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return []
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")]


def canonical_columns(df: DataFrame, *more: Column) -> DataFrame:
    """Columns under their fields' names; others keep letters, digits and _; of several of one name the last with a value counts."""
    of = {a: k for k, names in COLUMNS.items() for a in names}
    named: dict[str, list[str]] = {}
    for c in df.columns:
        plain = c.lower().replace(" ", "").replace("_", "")
        new = of.get(plain) or "".join(x for x in c if x.isascii() and (x.isalnum() or x == "_"))
        named.setdefault(new if new[:1].isalpha() or new[:1] == "_" else f"_{new}", []).append(c)
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    return df.select(*[F.coalesce(*[F.when(F.lower(blank(c)) != "nan", blank(c)) for c in reversed(cs)]).alias(name) for name, cs in named.items()], *more)


def timestamp(c: Column) -> Column:
    """The first of FORMATS that parses; null if none."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in FORMATS])


def write_results(df: DataFrame, path: str) -> None:
    """Nested rows as lines of JSON."""
    df.write.mode("errorifexists").json(path)


def write_index(df: DataFrame, path: str, stamp: dict) -> None:
    """A table of its own folder, checked for its number of rows, and then a stamp that names it. Until the stamp is there open_index gives the table before it, so a build that fails harms nothing."""
    spark, rows = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.parquet(f"{path}/{rows}")  # counted as it is written, since a count of its own would make the table twice
    n = seen.get.get("n", 0)
    if spark.read.parquet(f"{path}/{rows}").count() != n:
        raise ValueError(f"{path}/{rows}: not all rows were written")
    spark.createDataFrame([(json.dumps(stamp, sort_keys=True), n, rows)], "stamp string, n bigint, rows string").select("*", F.current_timestamp().alias("written")).coalesce(1).write.mode("append").json(f"{path}/stamps")


def open_index(spark: SparkSession, path: str, stamp: dict) -> DataFrame:
    """The table stamped last, if its stamp and number of rows are as expected; else an error."""
    found = spark.read.schema("stamp string, n bigint, rows string, written timestamp").json(f"{path}/stamps").orderBy(F.col("written").desc()).first()
    if found is None or found["stamp"] != json.dumps(stamp, sort_keys=True):
        raise ValueError(f"{path}: the index isn't the one asked for")
    df = spark.read.parquet(f"{path}/{found['rows']}")
    if found["n"] != df.count():
        raise ValueError(f"{path}: rows are missing")
    return df


def done_already(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows without a result, for a run that goes on where another stopped."""
    return rows.join(results.where("error is null").select(key).distinct(), key, "left_anti") if "error" in results.columns else rows.join(results.select(key).distinct(), key, "left_anti")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results that write_results saved, with the types they had; times come back from their text."""
    return spark.read.schema(schema).json(path)


def index_version(spark: SparkSession, path: str) -> str:
    """The stamp of the table stamped last; an error if there is none."""
    found = spark.read.schema("stamp string, written timestamp").json(f"{path}/stamps").orderBy(F.col("written").desc()).first()
    if found is None:
        raise ValueError(f"{path}: no index")
    return found["stamp"]


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, lines) of files: the first 16 digits of sha256, and how many line ends. One file is one cell, so these are result files and not tables."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"), F.size(F.split(F.decode("content", "ISO-8859-1"), "\n")).alias("n")).select("path", "digest", (F.col("n") - 1).cast("bigint").alias("lines"))
