"""Formats, fields, splitting, scalar functions and rules on rows of our own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import logparse, text
from tracewright.operators import rules


def fields(spark, raw):
    out = logparse.parse_fields(spark.createDataFrame([(1, raw)], "event_id bigint, raw string")).collect()
    return {r.name: r.value for r in out}, {r.format for r in out}, {r.name for r in out if r.informative}


def test_formats(spark):
    v, f, _ = fields(spark, '{"EventID": 4688, "Image": "a.exe", "extra": {"x": [1, 2]}, "none": null}')
    assert f == {"json"} and v["event.id"] == "4688" and v["process.name"] == "a.exe" and v["unknown.extra"] == '{"x":[1,2]}' and v["unknown.none"] == ""
    v, f, ok = fields(spark, "{Event ID=4663, Process Name=C:\\a b\\c.exe, NewProcessName=late, Account Name=N/A, Odd=x,}")
    assert f == {"brace_kv"} and v["process.name"] == "C:\\a b\\c.exe" and v["unknown.Odd"] == "x" and "account.name" not in ok
    v, f, _ = fields(spark, 'EventID=4688 CommandLine="cmd /c \\"x=1\\" y" Image=C:\\a b.exe ParentProcessId=4')
    assert f == {"space_kv"} and v["process.command_line"] == 'cmd /c "x=1" y' and v["process.name"] == "C:\\a b.exe" and v["parent.process.id"] == "4"
    v, f, _ = fields(spark, "A process was made.\n\tAccount Name:  bob\n\tEmpty Label:  \n\tProcess Name:  C:\\x.exe  Process ID:  0x1")
    assert f == {"windows_message"} and v["account.name"] == "bob" and v["process.name"] == "C:\\x.exe"
    assert fields(spark, "plain words") == ({}, set(), set()) and fields(spark, None) == ({}, set(), set())


def test_nested_and_derived(spark):
    v, f, _ = fields(spark, '{"Message": "{Process Name=inner.exe, Account Name=bob}", "ProcessName": "outer.exe", "Parent Process Path": "C:\\\\p\\\\up.exe"}')
    assert f == {"json"} and v["process.name"] == "outer.exe" and v["account.name"] == "bob" and v["parent.process.name"] == "up.exe"


@pytest.mark.parametrize(
    ("raw", "parts", "rule"),
    [
        ("", 1, "empty"),
        (None, 1, "empty"),
        ("one line", 1, "single"),
        ('[{"a": 1}, {"b": 2}]', 2, "json_array"),
        ("{a=1, b={x}} \n {c=2}", 2, "brace_blocks"),
        ("{a=1} words {c=2}", 1, "single"),
        ('{a="}"} {b=2}', 2, "brace_blocks"),
        ("EventID=1 a=b\nEventID=2 a=c", 2, "lines"),
        ("some prose\nmore prose\nEventID=2 a=c", 2, "lines"),
        ("{a=1,\nb=2}\nEventID=3 c=4", 2, "lines"),
        ("Account Name:  bob\nProcess Name:  x.exe", 1, "record"),
    ],
)
def test_split(raw, parts, rule):
    got, r, _ = logparse.split_events(raw)
    assert (len(got), r) == (parts, rule)
    if parts > 1 and rule != "json_array":
        assert all(p in raw for p in got)
        assert all(logparse.split_events(p)[0] == [p] for p in got)


def test_split_warns(spark):
    df = spark.createDataFrame([(1, "EventID=1 then EventID=2"), (2, "EventID=1\nEventID=2")], "event_id bigint, raw string")
    assert {(r.event_id, r.part): r.under_split for r in logparse.split(df).collect()} == {(1, 0): True, (2, 0): False, (2, 1): False}


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


def test_scalars(spark):
    paths = {"\\REGISTRY\\MACHINE\\SAM": "HKLM\\SAM", "HKEY_LOCAL_MACHINE/Software\\\\Foo\\": "HKLM\\SOFTWARE\\FOO", "HKLM\\SYSTEM\\ControlSet001\\Services": "HKLM\\SYSTEM\\CURRENTCONTROLSET\\SERVICES", "HKLM\\SOFTWARE\\WOW6432Node\\X": "HKLM\\SOFTWARE\\X", " ": None}
    for raw, want in paths.items():
        assert one(spark, text.registry_path, raw) == want, raw
    assert one(spark, text.basename, "C:\\a\\b.exe\\") == "b.exe"
    assert [one(spark, text.polarity, t) for t in ("was blocked", "was disabled", "blocked and disabled", "hello")] == ["enforcing", "breaking", "ambiguous", "neutral"]
    assert one(spark, text.mask_value, "0x10") == 16 and one(spark, text.mask_value, "12") == 12 and one(spark, text.mask_value, "x") is None
    assert [one(spark, text.is_public_ip, a) for a in ("8.8.8.8", "10.0.0.1", "172.31.0.1", "127.0.0.1", "300.1.1.1", "x")] == [True, False, False, False, False, False]
    assert one(spark, text.estimated_tokens, "a b c d e") == 6 and one(spark, text.estimated_tokens, "") == 1
    assert one(spark, lambda c: text.shortened(c, 10), "abc defgh, ijkl") == "abc..." or one(spark, lambda c: text.shortened(c, 10), "abc defgh, ijkl") == "abc defgh..."


def test_rules(spark):
    rows = [
        (1, {"EventID": "4688", "process.name": "C:\\Windows\\System32\\cmd.exe", "Message": "m"}),
        (2, {"EventID": "4625", "Message": "failed"}),
        *[(10 + i, {"EventID": "4625", "Message": "failed"}) for i in range(4)],
        (20, {"EventID": "4698", "Message": "task"}),
        (21, {"EventID": "1", "process.name": "schtasks.exe", "process.command_line": "schtasks /create x", "Message": "m"}),
        (30, {"EventID": "4947", "Message": "rule added and allowed"}),
        (31, {"EventID": "4947", "Message": "A rule was modified"}),
    ]
    got = {r.technique: r for r in rules.findings(spark.createDataFrame(rows, "row bigint, fields map<string,string>"), rules.catalogue()).collect()}
    assert got["T1059.003"].evidence_rows == [1]
    assert got["T1110.001"].evidence_rows == [2, 10, 11, 12, 13]
    assert got["T1053.005"].evidence_rows == [20, 21] and got["T1053.005"].level == "high"
    assert 30 not in got.get("T1686.003", type("x", (), {"evidence_rows": []})).evidence_rows
    with pytest.raises(ValueError):
        rules.Rule("T", "n", "t")


def test_criticality(spark):
    rows = [(1, "HKLM\\SAM\\x"), (2, "HKLM\\SAMPLE"), (3, "HKEY_LOCAL_MACHINE\\SYSTEM\\ControlSet001\\Control\\Lsa\\Security Packages"), (4, "SECURITY\\Policy\\Secrets\\a"), (5, "HKLM"), (6, None)]
    got = {r.row: (r.level, r.family) for r in rules.criticality(spark.createDataFrame(rows, "row bigint, path string")).collect()}
    assert got[1] == ("critical", "credential-hive") and got[3] == ("critical", "lsa-provider") and got[4] == ("critical", "lsa-secrets")
    assert got[2][0] == got[5][0] == got[6][0] == "unknown"


def test_asset_paths(spark):
    """Users' hives are one, with and without a security id."""
    same = ["HKU\\S-1-5-21-1-2-3-1001\\Software\\Foo", "HKCU\\Software\\Foo", "\\REGISTRY\\USER\\S-1-5-18\\SOFTWARE\\Foo\\", "HKEY_USERS\\S-1-5-21-9_Classes\\Software\\Foo", "HKCU\\S-1-5-20\\Software\\Foo"]
    assert {one(spark, text.asset_path, p) for p in same} == {"HKCU\\SOFTWARE\\FOO"}
    assert one(spark, text.asset_path, "HKLM\\S-1-5\\x") == "HKLM\\X" and one(spark, text.asset_path, "HKUX\\a") == "HKUX\\A" and one(spark, text.asset_path, " ") is None
    got = {r.row: r.level for r in rules.criticality(spark.createDataFrame([(1, same[0]), (2, "HKU\\S-1-5-21-1\\Other")], "row bigint, path string"), [("HKCU\\Software\\Foo", "high", "f")]).collect()}
    assert got == {1: "high", 2: "unknown"}


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("reg save HKLM\\SAM C:\\out\\sam.hive", ["HKLM\\SAM"]),
        ("reg.exe save HKLM\\SECURITY copy", ["HKLM\\SECURITY"]),
        ('reg add "HKLM\\SOFTWARE\\Windows Defender" /v x', ["HKLM\\SOFTWARE\\Windows Defender"]),
        ("reg add HKLM\\SOFTWARE\\Windows Defender /v x", ["HKLM\\SOFTWARE\\Windows Defender"]),
        ("Set-ItemProperty HKLM:\\SOFTWARE\\Foo -Name x", ["HKLM\\SOFTWARE\\Foo"]),
        ("reg query HKLM\\A\\B HKCU\\C", ["HKLM\\A\\B", "HKCU\\C"]),
        ("reg query HKLM", []),
        ("notepad a.txt", []),
    ],
)
def test_command_paths(spark, command, want):
    assert one(spark, text.command_registry_paths, command) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"Image": "a", "odd": "%s", "Image": "b"}' % ("x " * 500_000), {"process.name": "b", "unknown.odd": "x " * 499_999 + "x"}),
        ('CommandLine="%s" Image=b' % ('y\\"' * 300_000), {"process.command_line": 'y"' * 300_000, "process.name": "b"}),
        ("CommandLine=%sImage=b" % ("word " * 200_000), {"process.command_line": ("word " * 200_000).strip(), "process.name": "b"}),
        ("CommandLine=%s" % ("x" * 1_000_000), {"process.command_line": "x" * 1_000_000}),
        ("{Process Name=%s, Account Name=b}" % ("z, " * 330_000), {"process.name": ("z, " * 330_000).strip().rstrip(","), "account.name": "b"}),
        ("Process Name:  %s\n\tAccount Name:  b" % ("word " * 200_000), {"process.name": ("word " * 200_000).strip(), "account.name": "b"}),
        ("plain words " * 90_000, {}),
        ("Plain" * 200_000, {}),
        (" \n" * 500_000 + "x", {}),
        ("{" * 1_000_000, {}),
        ("9.a=1 b = 2", {"unknown.a": "1 b = 2"}),
        ('{"a": 1} {"a": 2}', {}),
        ('{"a": 1, "a": 2, "b": {"c": 1, "c": 2}}', None),
        ("{'a': '1=2'}", {"unknown.'a': '1": "2'"}),
        ('{"a": 1, "a": 2,}', {}),
        ('{"a": 1, "a": 2', {}),
    ],
)
def test_megabytes_and_repeats(spark, raw, want):
    """Nothing recurses, scans twice or loses an event; values are whole."""
    got, _, _ = fields(spark, raw)
    if want is None:
        assert got["unknown.a"] == "2" and "unknown.b" in got
    else:
        assert {k: v.strip() for k, v in got.items()} == want


def test_megabytes_are_split(spark):
    for raw in ("word " * 200_000, "Account Name: " * 70_000, "x" * 1_000_000, "a=b " * 200_000):
        assert logparse.split_events(raw)[0]


def test_many_repeats(spark):
    """A hundred thousand pairs of two keys: the last value of each, at the first one's place."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i % 2).cast("string").alias("k"), i.cast("string").alias("v"))).alias("p"))
    assert [tuple(r) for r in df.select(text.last_of_each(F.col("p"), "k", "v").alias("x")).first().x] == [("0", "99998"), ("1", "99999")]


def test_a_format_wins_by_its_place(spark):
    own = logparse.Format("dots", lambda raw: F.contains(raw, F.lit("::")), lambda raw: F.array(F.struct(F.lit("Image").alias("key"), F.substring_index(raw, "::", -1).alias("value"))))
    df = spark.createDataFrame([(1, "EventID=1 Image=a::b"), (2, "only::c")], "event_id bigint, raw string")
    got = lambda formats: {(r.event_id, r.format): r.value for r in logparse.parse_fields(df, formats).where("name = 'process.name'").collect()}
    assert got(logparse.with_format(own, "json")) == {(1, "dots"): "b", (2, "dots"): "c"}
    assert got(logparse.with_format(own)) == {(1, "space_kv"): "a::b", (2, "dots"): "c"}
    with pytest.raises(ValueError):
        logparse.with_format(logparse.Format("json", None, None))


def test_words_at_once_and_one_by_one(spark):
    """Values of bare words are cut as if each word were looked at."""
    rng = random.Random(4)
    bits = ["a", "Image", "image", "ab ", "x=", "=", " ", "  ", "\n", "\t", "\r", '"', "\\", "é", "7.", "EventID", " = ", "\n="]
    df = spark.createDataFrame([("".join(rng.choices(bits, k=rng.randint(1, 25))),) for _ in range(4000)] + [("CommandLine=" + "word " * 50_000 + "x=y Image=b",), ("a=b" + " " * 100_000 + "\n=c",)], "raw string")
    single = logparse._SPACED.replace(f"{logparse._WORDS}|", "")
    assert single != logparse._SPACED
    rows = df.select("raw", *[F.regexp_extract_all("raw", F.lit(p), F.lit(0)).alias(n) for n, p in (("one", single), ("many", logparse._SPACED))]).collect()
    assert [r.raw for r in rows if r.one != r.many] == [] and sum(any(" " in x for x in r.one) for r in rows) > 500


def test_labels_as_of_pieces(spark):
    """Labels stand at the beginning of pieces that line ends and two blanks part."""

    def want(raw):
        found = []
        for piece in re.split(r"(?:(?<=\n)|(?<=\s\s))(?=\S)", raw, flags=re.ASCII):
            m = re.match(r"([A-Z][a-zA-Z]+(?: [a-zA-Z]+)*):(?=[ \t])", piece) if len(piece) else None
            if m:
                found.append([m[1], piece[m.end() :]])
            elif found:
                found[-1][1] += piece
        return len(found), [(k, v.strip(text.WHITE)) for k, v in found if v.strip(text.WHITE)]

    rng = random.Random(5)
    bits = ["Ab", "\nAb: ", "  Cd ef:\t", "Cd ef", "g", "H", ":", ": ", ":\t", ":  ", " ", "  ", "\n", "\t", "\r", " \t", "é", "9", "\x0b", "x" * 9]
    raws = ["".join(rng.choices(bits, k=rng.randint(1, 20))) for _ in range(4000)]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = df.select("raw", logparse.message_pairs(F.col("raw")).alias("p"), logparse.FORMATS[-1].matches(F.col("raw")).alias("m")).collect()
    assert [r.raw for r in got if ([tuple(x) for x in r.p], r.m) != (want(r.raw)[1], want(r.raw)[0] >= 2)] == []
    assert sum(r.m for r in got) > 200


@pytest.mark.parametrize("end", ["", " ", ",", ", ,", "\t ,\n", "\x0b\f\r \t\n", "\u00a0", "}"])
def test_trimmed_ends(spark, end):
    for v in (f" \t{end}a b{end}", end, f"é,{end}"):
        assert one(spark, text.stripped_long, v) == v.strip(text.WHITE)
        assert one(spark, lambda c: text.ends_trimmed(c, ","), v) == v.rstrip(",")


def test_a_text_is_told_once(spark):
    """The format of a log is found once, and once more for a log inside it."""
    own = logparse.Format("own", lambda raw: F.contains(raw, F.lit("told-by-this")), lambda raw: F.array().cast(logparse.PAIRS))
    df = logparse.parse_fields(spark.createDataFrame([(1, "EventID=1")], "event_id bigint, raw string"), logparse.with_format(own, "json"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("told-by-this") == 2
    assert [(r.name, r.value) for r in df.collect()] == [("event.id", "1")]


def test_one_file_of_long_logs_is_dealt_out(spark, tmp_path, monkeypatch):
    from tracewright.plans import parsing

    spark.createDataFrame([(i, f"Customer#{i:09d}", "BUILDING") for i in range(20)], "c_custkey bigint, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen, parse = [], logparse.parse_fields
    monkeypatch.setattr(logparse, "parse_fields", lambda df: (seen.append(df.rdd.getNumPartitions()), parse(df))[1])
    got = parsing.repeated_and_long(spark, str(tmp_path)).collect()
    assert seen == [spark.sparkContext.defaultParallelism] and len(got) == 48 and sum(r.size > 20_000 for r in got) == 16
