"""The formats of spark.read against Spark's own readers."""

import json
import random

import pytest

from tracewright.operators import knowledge
from tracewright.sources import formats, readers


def _payload(i, more=""):
    return f"<13>Aug 06 x AgentDevice=WindowsLog\tComputer=h{i % 5}\tEventID={4600 + i % 90}\tTimeGenerated={1700000000 + i}\tMessage=Something{more}.  Account Name:  u{i % 7}  Logon ID:  0x{i:x}  Process Name:  C:\\p {i}.exe"


def _row(*cells):
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in cells)


@pytest.fixture
def exports(tmp_path):
    """Two files: single lines with commas and quotes, and one whose payloads have line ends."""
    rng = random.Random(3)
    one = "\n".join(_row(str(i), _payload(i, rng.choice(["", ", a \"b\"", " größe"])), "x") for i in range(700)) + "\n"
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.csv").write_text(one)
    (tmp_path / "lines" / "b.csv").write_text(one.replace("u1", "u9").rstrip("\n"))
    (tmp_path / "lines" / "_SUCCESS").write_text("")
    (tmp_path / "many.csv").write_text("\n".join(_row(str(i), _payload(i, "\nnext line"), "x") for i in range(90)))
    return tmp_path


@pytest.mark.parametrize("split", [100, 997, 64 << 20])
def test_lines_are_split_over_tasks(spark, exports, split):
    formats.register(spark)
    df = spark.read.format("tracewright_export").option("lines", "true").option("split", split).load(str(exports / "lines"))
    size = sum((exports / "lines" / f).stat().st_size for f in ("a.csv", "b.csv"))
    assert df.rdd.getNumPartitions() >= min(2, size // split + 1)
    got = sorted(map(str, readers.export_rows(df).collect()))
    assert got == sorted(map(str, readers.read_export(spark, str(exports / "lines")).collect())) and len(got) == 1400


def test_whole_files(spark, exports):
    got = sorted(map(str, formats.read_export(spark, str(exports / "many.csv")).collect()))
    assert got == sorted(map(str, readers.read_export(spark, str(exports / "many.csv")).collect())) and len(got) == 90
    got = formats.read_export(spark, str(exports / "lines"), lines=True)
    assert got.count() == 1400 and got.columns == readers.read_export(spark, str(exports / "lines")).columns


def test_no_payload(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="payload"):
        formats.read_export(spark, str(tmp_path / "x.csv")).collect()
    (tmp_path / "none").mkdir()
    assert formats.read_export(spark, str(tmp_path / "none")).collect() == []


def test_bundle(spark, tmp_path):
    ref = [{"source_name": "mitre-attack", "external_id": "T1", "url": "u"}]
    objects = [
        {"type": "attack-pattern", "id": "p", "name": "Größe", "external_references": ref, "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "e"}], "x_mitre_is_subtechnique": True, "x_mitre_platforms": ["Windows", None], "other": {"x": 1}},
        {"type": "relationship", "id": "r", "relationship_type": "uses", "source_ref": "a", "target_ref": "p"},
        {"type": "x-mitre-analytic", "id": "a", "x_mitre_log_source_references": [{"x_mitre_data_component_ref": "c", "name": "n"}, {}]},
        {},
    ]
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"type": "bundle", "objects": objects[: i + 2]}))
    formats.register(spark)
    df = spark.read.format("tracewright_bundle").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    want = [str(r) for i in range(3) for r in knowledge.load_bundle(spark, str(tmp_path / f"{i}.json")).collect()]
    assert sorted(map(str, df.collect())) == sorted(want)
