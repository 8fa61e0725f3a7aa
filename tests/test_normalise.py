"""Access classes, actions and search text of events."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import logparse
from tracewright.operators import normalise


@pytest.mark.parametrize(
    ("event", "fields", "want"),
    [
        ("4663", {"access.mask": "0x2", "object.type": "Key"}, ("write", None, "mask")),
        ("4663", {"access.mask": "0x1", "object.type": "Key", "access.list": "Set key value"}, ("read", None, "mask")),
        ("4656", {"access.mask": "0x2", "object.type": "Key"}, ("read", "write", "mask")),
        ("4663", {"access.list": "Set value", "object.type": "Key"}, ("write", None, "names")),
        ("4663", {"access.list": "Frobnicate", "object.type": "Key"}, ("unknown", None, "names")),
        ("4663", {}, ("read", None, "event")),
        ("4663", {"access.mask": "0x10", "object.type": "Process"}, ("read", None, "mask")),
    ],
)
def test_access(spark, event, fields, want):
    df = spark.createDataFrame([(event, fields or {"x": "y"})], "id string, f map<string,string>")
    assert tuple(df.select(normalise.access(F.col("id"), F.col("f")).alias("a")).first().a) == want


def test_normalised(spark):
    raw = [(1, 'EventID=4688 NewProcessName=C:\\Windows\\System32\\schtasks.exe CommandLine="schtasks /create /s host1" SubjectUserName=bob'), (2, "cron ran /usr/bin/x"), (3, "hello")]
    events = spark.createDataFrame(raw, "event_id bigint, raw string")
    rows = logparse.rule_rows(events, logparse.parse_fields(events)).withColumnRenamed("event_id", "row")
    got = {r.row: r for r in normalise.normalised(rows).collect()}
    assert got[1].platform == "Windows" and got[1].account == "bob" and got[1].tools == ["schtasks.exe"] and got[1].remote
    assert got[1].action.startswith("process created: C:\\Windows")
    assert got[2].platform == "Linux" and got[3].platform is None and got[3].action is None and not got[3].remote


def test_search_text(spark):
    raw = [(1, "{Object Name=HKEY_LOCAL_MACHINE\\Software\\Run, Process ID=0x44, Account Name=bob smith}"), (2, "words only")]
    events = spark.createDataFrame(raw, "event_id bigint, raw string")
    got = {r.event_id: r.query for r in normalise.search_text(logparse.parse_fields(events), events).collect()}
    assert got[2] == "words only"
    assert "bob smith" in got[1].split("\n\n")[0] and "0x44" not in got[1].split("\n\n")[0]
