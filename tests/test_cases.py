"""Repeated tags, long texts, frequent values, reports and saved things."""

import hashlib
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.functions import logparse, text
from tracewright.operators import batch, correlate, graph, incident, report, retrieve, rules, triage
from tracewright.plans import cases
from tracewright.sources import readers

T0 = datetime(2024, 1, 1)


def test_repeated_tags_and_labels(spark):
    p = "AgentDevice=x\tA=1\tA=2\tEventID=4624\tA=3\tMessage=Hello.  Account Name:  one  Logon ID:  0x1  Account Name:  two\tA=4"
    r = spark.createDataFrame([(p,), (None,), ("",)], "p string").select(readers.tagged(F.col("p")).alias("t")).collect()
    assert r[0].t == {"AgentDevice": "x", "A": "3", "EventID": "4624", "Message": p.split("Message=")[1]}
    got = spark.createDataFrame([(p,)], "p string").select(readers.message_labels(readers.tagged(F.col("p"))["Message"]).alias("x")).first().x
    assert [(x.k, x.v) for x in got] == [("Account Name", "two\tA=4"), ("Logon ID", "0x1")]


def test_long_texts_take_linear_time():
    for line in ("a {", 'a="x', "word", "{}", "k=v"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            logparse.split_events("\n".join([line] * n))
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 1


def test_open_brackets_and_quotes_go_on():
    assert logparse.split_events('a=1\nb={\nc=2}\nd="x\ny"\ne=3')[0] == ["a=1", "b={\nc=2}", 'd="x\ny"', "e=3"]
    assert logparse.split_events('{"a": "}"} {"b": 1}')[1] == "brace_blocks"
    assert logparse.split_events("{a {b} c} tail {open")[0] == ["{a {b} c} tail {open"]


def test_brace_pairs(spark):
    raw = ["{A=1, B C=x, y, D=}", "{A=x=y, B=1}", "{A}", "{}", "{ Key = v, }"]
    got = [[(p.key, p.value) for p in r.p] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(logparse.brace_pairs(F.col("r")).alias("p")).collect()]
    assert got[0] == [("A", "1"), ("B C", "x, y"), ("D", "")] and got[2] == [] and got[3] == [] and got[4] == [("Key", "v")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("reg.exe save HKLM\\SAM C:\\t.hiv", ["HKLM\\SAM"]),
        ('reg add "HKCU\\Software\\A B\\" /v x', ["HKCU\\Software\\A B"]),
        ("reg query HKLM\\Software\\Some Vendor /s", ["HKLM\\Software\\Some Vendor"]),
        ("reg copy HKLM\\A HKLM\\B", ["HKLM\\A", "HKLM\\B"]),
        ("reg export HKLM\\Soft ware out", ["HKLM\\Soft ware"]),
        ("echo HKLM", []),
        ("x.exe HKEY_LOCAL_MACHINE:\\Run, next.exe", ["HKEY_LOCAL_MACHINE\\Run"]),
        (None, []),
        ("", []),
    ],
)
def test_registry_paths(line, want):
    assert text.registry_paths_of(line) == want


def test_one_value_in_most_rows(spark):
    """Chains and lineage of a value that all rows have give few edges, and the components of the pairs."""
    n = 4_000
    rows = [(i, T0 + timedelta(minutes=37 * i) if i % 50 else None, "host", "4" if i % 2 else None, None if i % 2 else "4") for i in range(n)]
    df = spark.createDataFrame(rows, "row bigint, ts timestamp_ntz, host string, process_id string, parent_process_id string").withColumns({"process_guid": F.lit(None).cast("string"), "parent_process_guid": F.lit(None).cast("string")})
    chain = correlate.chain_edges(correlate.bucket_keys(df, ["host"]), 1.0)
    assert chain.count() <= 2 * n and graph.connected_components(chain).select("component").distinct().count() == 1
    lineage = correlate.lineage_edges(df, 1.0)
    assert lineage.count() <= 8 * n and graph.connected_components(lineage).select("component").distinct().count() == 1
    with pytest.raises(ValueError):
        correlate.chain_edges(correlate.bucket_keys(df, ["host"]), 0.0)


def test_frequent_keys_join_as_others(spark):
    left = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.min("v").alias("m"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot, total = graph.frequent(counts, "k")
    assert total == 5_000 and [k for k, _ in hot] == [0]
    a = graph.spread_join(left, right, "k", "v", hot).select("k", "v", "m")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "m").collect()))


def test_components_of_a_star_with_the_largest_centre(spark):
    edges = spark.range(3_000).select(F.col("id").alias("src"), F.lit(9_999).cast("bigint").alias("dst"))
    got = graph.connected_components(edges)
    assert got.count() == 3_001 and [r.component for r in got.select("component").distinct().collect()] == [0]


def test_incident_reports_have_all_sections(spark):
    got = cases.incident_reports(spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 10
    for r in got:
        parts = [p.split("\n")[0] for p in r.report.split("\n\n## ")][1:]
        assert parts == ["Summary", "Risk", "Time line", "Attack chain", "Matrix", "Weak signals", "Indicators"]
        assert r.report.startswith(f"# Incident {r.user_id}/{r.island}, host h1")


def test_long_sections_are_cut_and_say_so(spark):
    t = spark.createDataFrame([(1, f"T{i:04}", ["Impact"], "high", 1, True) for i in range(250)], "inc int, technique string, tactics array<string>, level string, occurrences bigint, strong boolean")
    got = report._listed(t, ["inc"], ["technique"], F.col("technique"), "x").first().x.split("\n")
    assert len(got) == report.LINES + 1 and got[-1] == "and 150 more" and got[0] == "T0000"


def test_findings_list_few_rows_and_count_all(spark):
    rows = spark.range(500).select(F.col("id").alias("row"), F.create_map(F.lit("EventID"), F.lit("1"), F.lit("Message"), F.lit("m")).alias("fields"))
    rule = rules.Rule("T1", "one", "Impact", required=("1",), min_events=3)
    got = rules.findings(rows, [rule]).first()
    assert got.evidence_rows == list(range(rules.LISTED)) and (got.n_rows, got.first_row, got.last_row) == (500, 0, 499)
    assert rules.evidence(rows, [rule]).count() == 500


def test_technique_rows(spark):
    e = spark.createDataFrame([(1, "T1", 5), (1, "T1", 5), (1, "T1", 6), (1, None, 7)], "inc int, technique string, row int")
    assert sorted(map(tuple, incident.technique_rows(e, ["inc"]).collect())) == [(1, "T1", 5), (1, "T1", 6)]


def test_a_failed_build_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    readers.write_index(spark.range(5), path, {"v": 1})
    with pytest.raises(Exception):
        readers.write_index(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), path, {"v": 2})
    assert readers.open_index(spark, path, {"v": 1}).count() == 5
    readers.write_index(spark.range(7), path, {"v": 2})
    assert readers.open_index(spark, path, {"v": 2}).count() == 7 and readers.index_version(spark, path) == '{"v": 2}'


def test_file_fingerprints(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"x\ny\n\n")
    r = readers.file_fingerprints(spark, str(tmp_path / "a.jsonl")).first()
    assert (r.digest, r.lines) == (hashlib.sha256(b"x\ny\n\n").hexdigest()[:16], 3)


def test_content_fingerprint_of_text_ids(spark):
    df = spark.range(3_000).select(F.concat(F.lit("c"), "id").alias("id"), F.col("id").cast("string").alias("text"))
    a, b = (retrieve.content_fingerprint(x).first() for x in (df, df.repartition(7)))
    assert a == b and a.n == 3_000
    other = retrieve.content_fingerprint(df.withColumn("text", F.when(F.col("id") == "c7", "x").otherwise(F.col("text")))).first()
    assert other.fingerprint != a.fingerprint


def test_shuffle_is_fixed_by_its_seed(spark):
    places = lambda seed: [r.id for r in triage.shuffled(spark.range(50), "id", seed).orderBy("place").collect()]
    assert places(1) == places(1) != places(2) and sorted(places(1)) == list(range(50))


def test_numbers_of_any_columns(spark):
    df = spark.createDataFrame([(None, "b"), (2, "a"), (1, "z"), (1, "c")], "x int, y string").repartition(3)
    assert [(r.x, r.y) for r in batch.numbered(df, ["x", "y"]).orderBy("index").collect()] == [(None, "b"), (1, "c"), (1, "z"), (2, "a")]


def test_two_places_by_the_binary_value(spark):
    import random

    from tracewright.functions.text import hundredths
    from tracewright.operators import incident, report

    rng = random.Random(8)
    xs = [0.605, 0.975, 0.125, 0.375, 0.005, 0.015, 17.005, 2.675, 0.0, 1.0, 0.5, 30.0, 0.995, 1e-9, 123456.785] + [round(rng.random() * 20, 3) for _ in range(2000)] + [i / 2000 for i in range(2001)]
    got = [r.n for r in spark.createDataFrame([(x,) for x in xs], "x double").select(hundredths(F.col("x")).alias("n")).collect()]
    assert [f"{n // 100}.{n % 100:02d}" for n in got] == [f"{x:.2f}" for x in xs]
    t = spark.createDataFrame([(1, ["Discovery"], 0.605), (2, ["Discovery"], 0.975), (3, ["Discovery"], 0.60475)], "g int, tactics array<string>, score double")
    said = {r.g: r.sentences.split("\n")[-1] for r in report.risk_breakdown(incident.risk_parts(t, ["g"])).collect()}
    assert said[1] == "confidence: mean 0.6 x 20, +12.1" and said[2] == "confidence: mean 0.97 x 20, +19.5"


def test_logs_are_parsed_once_by_all_cores(spark, monkeypatch):
    """A table of one file is dealt over the cores, and the layers of a search text read one table of fields."""
    from tracewright.plans import cases

    made, materialize, parse, events = [], cases.materialize, cases.logparse.parse_fields, []
    monkeypatch.setattr(cases, "materialize", lambda df, name: (made.append(name), materialize(df, name))[1])
    monkeypatch.setattr(cases.logparse, "parse_fields", lambda df: (events.append(df.rdd.getNumPartitions()), parse(df))[1])
    got = cases.search_layers(spark, "/root/testdata/sf0.001")
    assert made == ["fields"] and events[0] >= spark.sparkContext.defaultParallelism
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_index_is_made_once(spark, tmp_path):
    """An index is counted as it is written, an empty one too."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    readers.write_index(spark.range(50).mapInArrow(run, "id bigint"), str(tmp_path / "i"), {"v": 1})
    readers.write_index(spark.range(5).where("id > 9"), str(tmp_path / "none"), {"v": 1})
    assert made.value == 50 and readers.open_index(spark, str(tmp_path / "i"), {"v": 1}).count() == 50 and readers.open_index(spark, str(tmp_path / "none"), {"v": 1}).count() == 0
