"""A log table to incidents."""

from tracewright.operators import flow
from tracewright.sources import readers

CSV = """Timestamp,EventID,Hostname,SubjectUserName,ServiceName,CommandLine,NewProcessName,Message
2024-01-01 10:00:00,4688,web1,bob,,cmd.exe /c whoami,C:\\Windows\\System32\\cmd.exe,
2024-01-01 10:05:00,4698,web1,bob,,,,A scheduled task was created
2024-01-01 10:06:00,7045,WEB1,system,evil,,,A service was installed
2024-01-01 11:00:00,4720,web1,,,,,A user account was created
2024-01-03 12:00:00,4688,far,eve,,calc.exe,C:\\calc.exe,
,1102,far,,,,,The audit log was cleared
2024-02-01 00:00:00,4720,alone,,,,,A user account was created
"""


def test_incidents(spark, tmp_path):
    (tmp_path / "log.csv").write_text(CSV)
    got = {r.incident: r for r in flow.incidents(readers.load_rows(spark, str(tmp_path / "log.csv"))).collect()}
    assert set(got) == {0, 4}
    first = got[0]
    assert first.n_rows == 4 and first.host == "web1" and first.account == "bob"
    assert {"T1059.003", "T1053.005", "T1543.003", "T1136.001"} <= set(first.techniques)
    assert first.chain.startswith("Execution") and "Persistence" in first.chain
    assert first.score > 0 and first.severity in ("Low", "Medium", "High", "Critical")
    assert "host web1" in first.indicators and "host WEB1" not in first.indicators
    assert "# Incident 0" in first.report
    assert got[4].n_rows == 2 and "T1685.005" in got[4].techniques


def test_no_rows(spark, tmp_path):
    (tmp_path / "log.csv").write_text(CSV.splitlines()[0] + "\n")
    assert flow.incidents(readers.read_csv(spark, str(tmp_path / "log.csv"))).collect() == []


def test_weak_rules_and_rows_in_no_incident(spark):
    """A rule that needs several rows has them among all rows, and what lies in no incident gives an incident no technique."""
    from tracewright.operators.rules import Condition, Rule

    book = [Rule("T1", "one", "TA0002", ("10",)), Rule("T1", "weak", "TA0003", ("11",), level="low"), Rule("T2", "three", "TA0003", ("12",), min_events=3, level="low"), Rule("T3", "four", "TA0003", ("13",), min_events=4), Rule("T1562", "off", "Own", ("14",), conditions=((Condition("Message", "x"),),))]
    ids = ["10", "11", "12", "12", "13", "13", "14", "14"]
    rows = [("2024-01-01 00:00:00", i, "web", f"disabled x{n}" if n == 6 else f"x{n}") for n, i in enumerate(ids)] + [("2024-03-01 00:00:00", "12", "far", "x"), ("2024-05-01 00:00:00", "13", "alone", "x")]
    got = flow.incidents(spark.createDataFrame(rows, "Timestamp string, EventID string, Hostname string, Message string"), book).collect()
    assert [(r.n_rows, r.techniques, r.weak, r.host) for r in got] == [(8, ["T1", "T1562"], ["T2"], "web")]
    assert got[0].chain == "Execution: T1 -> Own: T1562"
