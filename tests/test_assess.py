"""Verdicts, redirects, knowledge, evaluation, reports, readers and streams."""

import itertools
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import assess, evaluate, incident, knowledge, report, retrieve
from tracewright.sources import readers
from tracewright.streaming import windows


def test_event_decision_table(spark):
    """All cases of the table, against its words."""
    cases = list(itertools.product([0, 2], [0, 1], ["critical", "high", "medium", "noise", None], ["write", "read", None], [True, False]))
    df = spark.createDataFrame(cases, "n int, c int, crit string, access string, exp boolean")
    for r in df.withColumn("v", assess.event_decision(*map(F.col, df.columns))).collect():
        a, b = r.n > 0 and r.c > 0, r.crit in ("critical", "high") and r.access == "write"
        if a:
            want = ("SUFFICIENT_SUSPICIOUS", "A", False)
        elif b:
            want = ("SUFFICIENT_BENIGN", "B", True) if r.exp else ("SUFFICIENT_SUSPICIOUS", "B", False)
        elif r.crit == "noise" and r.access == "read" and r.c == 0:
            want = ("SUFFICIENT_BENIGN", "noise", False)
        else:
            want = ("INSUFFICIENT_DATA", "none", False)
        assert tuple(r.v) == want


def test_added_events_never_silence(spark):
    rows = [(1, i, v, False) for i, v in enumerate(["SUFFICIENT_BENIGN", "SUFFICIENT_SUSPICIOUS", "INSUFFICIENT_DATA", "SUFFICIENT_SUSPICIOUS"])]
    r = assess.combine_alarm(spark.createDataFrame(rows, "alarm int, idx int, verdict string, suppressed boolean"), ["alarm"]).first()
    assert (r.verdict, r.by_event, r.sufficient_suspicious) == ("SUFFICIENT_SUSPICIOUS", 1, 2)


def test_redirects(spark):
    kb = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, revoked_by string")
    assert {r.id: r.target for r in assess.redirects(kb).collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "y": None, "z": None}


def test_decisions_are_ceilings(spark):
    f = spark.createDataFrame([(1, "t", "high"), (1, "u", "low"), (1, "w", "high")], "g int, technique string, level string")
    d = spark.createDataFrame([(1, "t", "downgrade", "low"), (1, "t", "downgrade", "medium"), (1, "u", "downgrade", "medium"), (1, "w", "reject", None), (1, "new", "confirm", None)], "g int, technique string, verdict string, downgrade_to string")
    assert {(r.technique, r.status, r.level) for r in assess.apply_decisions(f, d, ["g"]).collect()} == {("t", "kept", "low"), ("u", "kept", "low"), ("w", "rejected", "high")}


def test_reviewers(spark):
    rows = [("T1053.005", "high", "schtasks /create /s host1"), ("T1053.005", "high", "C:\\Windows\\System32\\defrag.exe"), ("T1003.001", "high", "mask 0x1010"), ("T1003.001", "high", "handle"), ("T1003.001", "low", "handle"), ("T1003.001", "high", "\\MsMpEng"), ("T1686.003", "high", "x"), ("T9", "high", "x")]
    df = spark.createDataFrame(rows, "t string, l string, x string")
    got = [r.v and (r.v.verdict, r.v.downgrade_to) for r in df.withColumn("v", assess.review(F.col("t"), F.col("l"), F.col("x"), F.lit("neutral"))).collect()]
    assert got == [("confirm", None), ("reject", None), ("confirm", None), ("downgrade", "medium"), ("abstain", None), ("reject", None), ("reject", None), None]


def test_confidence_leaves_unknown_parts_out(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, None), (0.5, 1.0, 0.0)], "a double, b double, c double")
    got = [round(r.s, 6) for r in df.select(assess.confidence({"retrieval": F.col("a"), "fields": F.col("b"), "platform": F.col("c")}).alias("s")).collect()]
    assert got == [1.0, 0.0, round((0.3 * 0.5 + 0.15) / 0.55, 6)]


def test_redirects_of_any_length(spark):
    """A chain of 200, a circle, a way into it, an unknown end, a repeated id, a null id, a key that many lead to."""
    rows = [(f"c{i}", f"c{i + 1}") for i in range(200)] + [("c200", None)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("u", "gone"), ("self", "self"), ("c7", None), (None, "c1")] + [(f"m{i}", "c200") for i in range(500)]
    got = {r.id: (r.target, r.hops) for r in assess.redirects(spark.createDataFrame(rows, "id string, revoked_by string")).collect()}
    assert got["c8"] == ("c200", 192) and got["c199"] == ("c200", 1) and got["c0"] == ("c7", 7) and got["c7"] == ("c7", 0)
    assert all(got[k] == (None, None) for k in ("x", "y", "z", "w", "u", "self")) and got["m3"] == ("c200", 1) and len(got) == 707


def test_redirects_write_what_moves(spark, monkeypatch):
    """Circles, and ways into them with smaller and larger ids, end the rounds early; rows that have arrived are written once."""
    written, materialize = [], assess.materialize
    monkeypatch.setattr(assess, "materialize", lambda df, name: (written.append(df.count()), materialize(df, name))[1])
    after = {i: i - 1 if i % 5 else None for i in range(2000)}
    after |= {7: 1003, 1003: 1500, 1500: 7, 3: 7, 1900: 1003, 4: 4, 1999: 1900, 50: -5}
    got = {r.id: (r.target, r.hops) for r in assess.redirects(spark.createDataFrame(list(after.items()), "id bigint, revoked_by bigint")).collect()}
    for i in after:
        at, hops = i, 0
        while at in after and after[at] is not None and hops < 20:
            at, hops = after[at], hops + 1
        assert got[i] == ((at, hops) if at in after and after[at] is None else (None, None)), i
    assert len(got) == 2000 and sum(written) <= 4 * 2000  # and 12 rounds of all rows otherwise


def test_access_names(spark):
    from tracewright.functions import text
    from tracewright.operators import normalise

    want = {"ReadData (or ListDirectory)": ("FILE_READ_DATA", "contained"), "DELETE": ("DELETE", "equal"), "Child": ("FILE_DELETE_CHILD", "contained"), "data": (None, "ambiguous"), "Execute/Traverse": ("FILE_EXECUTE", "contained"), "zzz": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown")}
    df = spark.createDataFrame([(1, i, n, "file") for i, n in enumerate(want)] + [(2, 0, "Notify about changes to keys", "registry"), (2, 1, "DELETE", None)], "row int, ord int, name string, family string")
    got = {(r.row, r.name): (r.bit, r.how) for r in normalise.access_names(df).collect()}
    assert {n: got[1, n] for n in want} == want and got[2, "Notify about changes to keys"] == ("KEY_NOTIFY", "alias") and got[2, "DELETE"] == ("DELETE", "equal")
    for r in df.where("row = 1").select("name", text.access_bit(F.col("name"), "file").alias("b")).collect():
        assert (r.b and r.b.name) == want[r.name][0], r
    two = spark.createDataFrame([("f", "A_B", "read"), ("f", "B_A", "write"), ("f", "A_B_C", "read")], "family string, bit string, kind string")
    one = normalise.access_names(spark.createDataFrame([(1, 0, "a b", "f")], "row int, ord int, name string, family string"), two).first()
    assert (one.bit, one.how) == ("A_B_C", "contained")


def test_knowledge(spark, tmp_path):
    ref = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": f"u/{i}"}]
    objects = [
        {"type": "x-mitre-tactic", "id": "ta", "name": "Execution", "x_mitre_shortname": "execution"},
        {"type": "attack-pattern", "id": "p1", "name": "Parent", "external_references": ref("T1"), "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "execution"}], "x_mitre_platforms": ["Windows"]},
        {"type": "attack-pattern", "id": "p2", "name": "Child", "external_references": ref("T1.001"), "x_mitre_is_subtechnique": True},
        {"type": "attack-pattern", "id": "p3", "name": "Old", "external_references": ref("T0"), "revoked": True},
        {"type": "course-of-action", "id": "m", "name": "Fix", "external_references": ref("M1")},
        {"type": "intrusion-set", "id": "g", "name": "Group", "external_references": ref("G1")},
        {"type": "x-mitre-data-component", "id": "c", "name": "Process Creation"},
        {"type": "x-mitre-analytic", "id": "a", "x_mitre_log_source_references": [{"x_mitre_data_component_ref": "c", "name": "n"}, {"x_mitre_data_component_ref": "gone", "name": "Fallback"}]},
        {"type": "x-mitre-detection-strategy", "id": "s", "x_mitre_analytic_refs": ["a"]},
        *[{"type": "relationship", "id": f"r{i}", "relationship_type": k, "source_ref": a, "target_ref": b} for i, (k, a, b) in enumerate([("subtechnique-of", "p2", "p1"), ("mitigates", "m", "p1"), ("uses", "g", "p1"), ("detects", "s", "p1"), ("revoked-by", "p3", "p1")])],
    ]
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps({"type": "bundle", "objects": objects}))
    got = {r.attack_id: r for r in knowledge.techniques(knowledge.load_bundle(spark, str(path))).collect()}
    assert got["T1"].tactics == ["Execution"] and got["T1"].mitigations == ["M1"] and got["T1"].users == ["Group"] and got["T1"].components == ["Fallback", "Process Creation"]
    assert got["T1.001"].parent == "T1" and got["T1.001"].is_subtechnique and got["T0"].revoked_by == "T1" and got["T0"].tactics == []


def test_metrics(spark):
    e = spark.createDataFrame([(1, ["A.1"], ["B"], ["x"]), (2, [], [], []), (3, [], [], [])], "key int, ids array<string>, alternatives array<string>, tactics array<string>")
    kb = spark.createDataFrame([("A.1", "A", ["x"]), ("A", None, ["x"]), ("C", None, ["x"]), ("D", None, ["y"])], "id string, parent string, tactics array<string>")
    for predicted, want in [("A.1", 1.0), ("B", 0.7), ("A", 0.5), ("C", 0.1), ("D", 0.0)]:
        p = spark.createDataFrame([(1, predicted), (3, "A")], "key int, id string")
        assert {r.key: r.score for r in evaluate.hierarchical(p, e, kb, "key").collect()} == {1: want, 2: 1.0, 3: 0.0}


def test_greedy_chunks(spark):
    costs = [5, 5, 5, 20, 1, 9, 9]
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate(costs)], "g string, n int, cost int")
    want, used, bucket = [], 2, 0
    for c in costs:
        if used + c > 14 and used > 2:
            bucket, used = bucket + 1, 2
        used += c
        want.append(bucket)
    assert [r.bucket for r in sorted(retrieve.greedy_chunks(df, "g", "n", "cost", 14, 2).collect(), key=lambda r: r.n)] == want


def test_most_common_ties(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 4), (1, "b", 3), (1, "", 0)], "g int, v string, o int")
    assert [(r.v, r.n) for r in incident.most_common(df, ["g"], "v", "o").collect()] == [("a", 2)]


def test_report(spark):
    now = datetime(2024, 1, 1)
    chain = spark.createDataFrame([(1, 4, "Execution", ["a", "b", "c", "d"]), (1, 3, "Initial Access", ["z"])], "incident int, phase int, tactic string, techniques array<string>")
    line = report.chain_line(chain, ["incident"]).first().chain
    assert line == "Initial Access: z -> Execution: a, b, c +1 more"
    df = spark.createDataFrame([(1, 80, "Critical", 3, now, now, line, ["a"], [])], "incident int, score int, severity string, n_rows bigint, first_ts timestamp, last_ts timestamp, chain string, techniques array<string>, indicators array<string>")
    text = report.markdown(df).first().report
    assert "# Incident 1" in text and "80 of 100 (Critical)" in text and "- a" in text and text.endswith("none")
    d = report.timeline_diagram(spark.createDataFrame([(1, 1, now, 'a"b'), (1, 2, None, "c")], "g int, place int, ts timestamp, technique string"), ["g"]).first().diagram
    assert "n1 --> n2" in d and "#quot;" in d


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Process Name,User Name,PID,when?\na.exe,bob,5,x\n,eve,,\n")
    df = readers.canonical_columns(readers.load_rows(spark, str(tmp_path / "t.csv")))
    assert df.columns == ["NewProcessName", "SubjectUserName", "ProcessId", "when"] and [r.ProcessId for r in df.collect()] == ["5", None]
    payload = "<13>AgentDevice=Win\tComputer=H1\tEventID=4688\tTimeGenerated=1704067200\tMessage=Made. Subject:      Account Name:  bob  Logon ID:  -  New Process Name:  C:\\x.exe"
    (tmp_path / "e.csv").write_text("\n".join(f'{i},"{payload}"' for i in range(3)) + "\n")
    r = readers.load_rows(spark, str(tmp_path / "e.csv")).first()
    assert (r.Timestamp, r.EventID, r.Hostname, r.SubjectUserName, r.LogonId, r.NewProcessName) == ("2024-01-01 00:00:00", "4688", "H1", "bob", None, "C:\\x.exe")
    (tmp_path / "j.json").write_text('[{"EventID": 1, "x": "y"}, {"EventID": 2}]')
    assert [r.EventID for r in readers.load_rows(spark, str(tmp_path / "j.json")).collect()] == ["1", "2"]
    rows = spark.range(5)
    readers.write_index(rows, str(tmp_path / "index"), {"v": 1})
    assert readers.open_index(spark, str(tmp_path / "index"), {"v": 1}).count() == 5
    with pytest.raises(ValueError):
        readers.open_index(spark, str(tmp_path / "index"), {"v": 2})


def test_streams_equal_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(f"u{i % 3}", t0 + timedelta(hours=h), i) for i, h in enumerate([0, 1, 2, 23, 24, 40, 70, 71, 72, 200, 201])]
    schema = "user string, ts timestamp, idx int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    windows.drain(windows.sessions(windows.read_events(spark, str(tmp_path / "in"), schema), ["user"]), "s1", str(tmp_path / "c1"), "complete")
    batch = windows.sessions(spark.read.parquet(str(tmp_path / "in")), ["user"])
    assert sorted(map(tuple, spark.table("s1").collect())) == sorted(map(tuple, batch.collect())) != []
    windows.drain(windows.rule_counts(windows.read_events(spark, str(tmp_path / "in"), schema), ["user"], 2, "1 day"), "s2", str(tmp_path / "c2"), "complete")
    assert sorted(map(tuple, spark.table("s2").collect())) == sorted(map(tuple, windows.rule_counts(spark.read.parquet(str(tmp_path / "in")), ["user"], 2, "1 day").collect()))
