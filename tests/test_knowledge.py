"""Packing, context and the order of authority on rows of our own."""

import random

from pyspark.sql import functions as F

from tracewright.operators import normalise, retrieve


def test_greedy_with_heads_of_their_own(spark):
    """Against a plain loop, over many groups, with a header column, null costs and a group in one stretch of a million rows' kind."""
    rng = random.Random(6)
    rows = [(f"g{g}", n, rng.choice([None, *range(1, 40)]), g % 30) for g in range(40) for n in range(rng.randint(1, 60))] + [("big", n, 7, 3) for n in range(5000)] + [(None, 0, 3, 1)]
    df = spark.createDataFrame(rows, "g string, n int, cost int, head int").repartition(7)
    got = {(r.g, r.n): r.bucket for r in retrieve.greedy_chunks(df, "g", "n", "cost", 60, "head").collect()}
    groups: dict = {}
    for g, n, c, h in rows:
        groups.setdefault(g, []).append((n, c or 0, h))
    for g, items in groups.items():
        bucket, used = 0, items[0][2]
        for n, c, h in sorted(items):
            if used + c > 60 and used > h:
                bucket, used = bucket + 1, h
            used += c
            assert got[g, n] == bucket
    assert len(got) == len(rows)


def test_context_blocks(spark):
    rows = [(1, 1, "A", "d", "x" * 50 + " " * 10 + "y" * 50, "n", "t", "u", True, None), (1, 2, "B", "d", "short", None, None, None, False, True), (1, 3, "A", "p", "more", "n", "t", "u", True, None), (1, 9, "C", "d", "late", "n", "t", "u", None, None), (2, 1, "Z", "d", "z" * 500, "n", "t", "u", None, None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, attack_id string, content_type string, text string, name string, object_type string, url string, revoked boolean, deprecated boolean")
    b = {(r.query_id, r.place): r.block for r in retrieve.context_blocks(df, budget=200, clip=55, first=3).collect()}
    assert b[1, 1] == "[1] A | n | t | revoked\n(d) " + "x" * 50 + " [...]\n(p) more\nSource: u"
    assert b[1, 2] == "[2] B | - | - | deprecated\n(d) short\nSource: -"
    assert set(b) == {(1, 1), (1, 2), (2, 1)}
    size = len(b[1, 1]) + len(b[1, 2]) + 2
    keys = lambda **kw: {(r.query_id, r.place) for r in retrieve.context_blocks(df, clip=55, first=3, **kw).collect()}
    assert (1, 2) in keys(budget=size) and (1, 2) not in keys(budget=size - 1) and (2, 1) in keys(budget=1)
    assert len(retrieve.context_blocks(df, None, 55, None).collect()) == 4


def test_authority(spark):
    raw = {
        1: 'CommandLine=cmd /c set X=1 SubjectUserName=jdoe',
        2: 'Image="C:\\a b\\x.exe" Message=New Process Name: late.exe  Account Name:  label',
        3: "no format, process name: \"C:\\p q.exe\" and user: bob, event id: 4625",
        4: None,
        5: "",
    }
    got = {r.event_id: r for r in normalise.by_authority(spark.createDataFrame(list(raw.items()), "event_id int, raw string")).collect()}
    assert (got[1].command_line, got[1].command_line_from, got[1].account) == ("cmd /c set X=1", "fields", "jdoe")
    assert (got[2].process, got[2].process_from, got[2].account, got[2].account_from) == ("C:\\a b\\x.exe", "fields", "label", "fields")  # the message is a log of its own
    assert (got[3].process, got[3].account, got[3].id, got[3].format) == ("C:\\p q.exe", "bob", "4625", None)
    assert all((got[i].process, got[i].command_line, got[i].account) == (None, None, None) for i in (4, 5))


def test_timeline_rows(spark):
    df = spark.range(3000).select(F.lit(1).alias("u"), F.lit("s").alias("sentence"), F.col("id").alias("row"), F.lit(None).cast("timestamp").alias("ts"))
    (one,) = normalise.grouped_timeline(df, ["u"]).collect()
    assert one.n == 3000 and len(one.rows) == normalise.LISTED
    assert sorted(r.row for r in normalise.timeline_rows(df, ["u"]).collect()) == list(range(3000))


def test_quotes_by_their_rarest_words(spark):
    """Against every pair, with words that all texts have, words that none has, repeated ids, nulls and shares just at the bound."""
    from tracewright.operators import assess

    rng = random.Random(13)
    words = ["common", "often"] + [f"word{i}" for i in range(60)]
    texts = [(i, "common often " + " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(80)] + [(81, None), (82, ""), (3, "word1 word2"), (83, "a an the")]
    quotes = [(i, " ".join(rng.sample([*words, "gone1", "gone2", "abc"], rng.randint(1, 8)))) for i in range(60)] + [(70, None), (71, "gone1 gone2"), (72, "common"), (73, "common gone1"), (74, "a an")]
    got = {(r.quote_id, r.text_id): r.share for r in assess.quoted_matches(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "text_id int, text string")).collect()}
    of = lambda t: {w for w in (t or "").split() if len(w) > 3}
    held: dict = {}
    for i, t in texts:
        held.setdefault(i, set()).update(of(t))
    want = {(q, t): round(len(of(x) & w) / len(of(x)), 6) for q, x in quotes if of(x) for t, w in held.items() if len(of(x) & w) / len(of(x)) >= 0.5}
    assert got == want and len(got) > 100


def test_sentences_by_the_events_own_fields(spark):
    from tracewright.operators import report

    fields = {
        1: {"EventID": "5156", "process.name": "C:\\a\\b.exe", "destination.ip": "fe80::1", "destination.port": "443", "object.name": "not told"},
        2: {"EventID": "4663", "process.name": "-", "account.name": "bob", "object.name": "x" * 90},
        3: {"EventID": "4624"},
        4: {"EventID": "77", "account.name": "bob"},
        5: None,
    }
    rows = spark.createDataFrame(list(fields.items()), "row int, fields map<string,string>")
    t = spark.createDataFrame([(1, f"T{i}", i, None) for i in fields] + [(1, "T1", 9, None), (1, "late", 9, None), (1, None, 1, None), (1, "T2", 4, None)], "g int, technique string, row int, ts timestamp")
    got = {r.technique: r.sentence for r in report.technique_sentences(t, rows.union(rows.limit(1)), ["g"]).collect()}
    assert got == {"T1": "b.exe > [fe80::1]:443, network connection made (5156)", "T2": "bob > " + "x" * 67 + "..., object accessed (4663)"}


def test_sentence_stays_small_in_the_plan(spark):
    """The sentence's expression doesn't repeat itself for each use of its parts: it took the driver's memory."""
    from tracewright.operators import report

    rows = spark.createDataFrame([(1, {"EventID": "4663", "account.name": "bob"})], "row int, fields map<string,string>")
    t = spark.createDataFrame([(1, "T", 1, None)], "g int, technique string, row int, ts timestamp")
    made = report.technique_sentences(t, rows, ["g"])
    assert len(made._jdf.queryExecution().analyzed().toString()) < 200_000
