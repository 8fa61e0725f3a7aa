"""Bulk runs, ranking and packing on small rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.operators import assess, batch, retrieve


@pytest.mark.parametrize("run", [100_000, 3])
def test_numbered(spark, monkeypatch, run):
    monkeypatch.setattr(batch, "RUN", run)
    df = spark.createDataFrame([(i * i,) for i in range(20)], "o bigint").repartition(4)
    assert {r.o: r["index"] for r in batch.numbered(df, "o").collect()} == {i * i: i for i in range(20)}


def test_failed_rows_are_tried_twice(spark):
    calls = []

    def attempt(rows):
        calls.append(1)
        return rows.select("k", F.when((F.col("k") % 3 == 0) & F.lit(len(calls) == 1), "timeout").when(F.col("k") == 5, "broken").alias("error"))

    got = {r.k: r.error for r in batch.two_tries(spark.range(9).withColumnRenamed("id", "k"), "k", attempt).collect()}
    assert got == {k: "broken" if k == 5 else None for k in range(9)} and len(calls) == 2


def test_platform_override(spark):
    df = spark.createDataFrame([("windows 10",), (" Ubuntu",), ("Darwin",), ("x",), (None,)], "v string")
    assert [r.p for r in df.select(batch.platform_override(F.col("v")).alias("p")).collect()] == ["Windows", "Linux", "macOS", None, None]


def test_fusion_keeps_the_first_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    assert [(r.id, r["rank"]) for r in sorted(retrieve.fuse([a, b]).collect(), key=lambda r: r["rank"])] == [(11, 1), (10, 2)]


def test_bm25_common_terms(spark):
    """A term in most chunks gets a share of the mean weight; repeated terms of a query count again."""
    chunks = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d"), (4, "e")], "id bigint, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "b b"), (3, "zzz")], "query_id bigint, text string")
    got = {(r.query_id, r.id): r.score for r in retrieve.bm25(q, chunks, 5).collect()}
    assert got[1, 1] > got[1, 2] > 0 and {k for k in got if k[0] == 2} == {(2, 1)} and not [k for k in got if k[0] == 3]


def _plain_bm25(queries, chunks, k):
    """BM25 of every query and chunk by plain loops, as (query_id, id, score)."""
    words = {i: re.findall(r"[a-z0-9_./:\\-]+", t.lower()) for i, t in chunks}
    df = Counter(w for ws in words.values() for w in set(ws))
    n, average = len(words), sum(map(len, words.values())) / len(words)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean, out = sum(raw.values()) / len(raw), []
    for q, text in queries:
        times, scores = Counter(t for t in text.lower().split() if t in df), {}
        for i, ws in words.items():
            if shared := set(ws) & set(times):
                part = lambda t: times[t] * (0.25 * mean if raw[t] < 0 else raw[t]) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / average))  # noqa: B023, E731
                scores[i] = round(sum(map(part, shared)), 6)
        out += [(q, i, s) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_bm25_in_small_groups(spark, monkeypatch):
    """Blocks, parts and slices of a few rows give what plain loops give, ties and scores of 0 and less among it."""
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdefgh") + rnd.choice(["", "x"]) for _ in range(n))
    some = [(i, text(rnd.randint(0, 9))) for i in range(60)]
    few = [(1, "a b"), (2, "a c"), (3, "b"), (4, "a c")]  # b stands in half of them: its idf is 0; the mean is negative
    for name, value in {"CHUNKS": 7, "ASKING": 3, "AT_ONCE": 2, "CELLS": 12}.items():
        monkeypatch.setattr(retrieve, name, value)
    for chunks, queries in ((some + [(i + 60, t) for i, t in some[:20]], [(i, text(4)) for i in range(11)]), (few, [(1, "b"), (2, "a a"), (3, "c zzz")])):
        c, q = spark.createDataFrame(chunks, "id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string")
        for got in (retrieve.bm25(q, c, 4), retrieve.bm25_of(q, retrieve.postings(c), len(chunks), 4)):
            got = [(r.query_id, r.id, r.score) for r in got.orderBy("query_id", "rank").collect()]
            assert got == [(a, b, pytest.approx(s, abs=1.1e-6)) for a, b, s in _plain_bm25(queries, chunks, 4)]


def test_bm25_pairs_are_no_rows(spark, monkeypatch):
    """What is ranked are the best of each group, and not every query with every chunk that shares a term."""
    seen, ranked = [], retrieve.ranked
    monkeypatch.setattr(retrieve, "ranked", lambda scores, k: (seen.append(scores.count()), ranked(scores, k))[1])
    c = spark.range(500).select("id", F.concat(F.lit("the same words "), F.col("id")).alias("text"))
    q = spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("the same "), F.col("id")).alias("text"))
    for got in (retrieve.bm25(q, c, 3), retrieve.bm25_of(q, retrieve.postings(c), 500, 3)):
        assert {(r.query_id, r.id) for r in got.where("rank = 1").collect()} == {(i, i) for i in range(20)}
    assert max(seen) <= 20 * 2 * 3


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(retrieve.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [None, 1.0, 0.0]


def test_platforms_fall_back(spark):
    c = spark.createDataFrame([(1, 1, ["Windows"]), (1, 2, ["Linux"]), (1, 3, []), (2, 4, ["Linux"])], "query_id int, id int, platforms array<string>")
    assert {r.id for r in retrieve.platform_filter(c, F.lit("Windows")).collect()} == {1, 3, 4}


def test_pack_stops_at_the_first_that_does_not_fit(spark):
    b = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 1), (2, 1, 500)], "g int, n int, size int")
    assert {(r.g, r.n) for r in retrieve.pack(b, ["g"], "n", "size", 100).collect()} == {(1, 1), (2, 1)}


def test_required_evidence(spark):
    df = spark.createDataFrame([("T1047", "used WMIC.exe here"), ("T1047", "nothing"), ("T9", "nothing")], "t string, x string")
    assert [r.v for r in df.select(assess.required_evidence(F.col("t"), F.col("x")).alias("v")).collect()] == [True, False, True]


def test_numbered_in_one_shuffle(spark):
    """Rows sorted by ranges have their place within a range already, so numbering moves them no second time."""
    df = spark.range(1000).selectExpr("if(id % 10 = 0, null, id % 7) AS a", "cast(id AS string) AS b")
    got = batch.numbered(df, ["a", "b"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    order = sorted(((r.a is not None, r.a or 0, r.b) for r in df.collect()))
    assert [(r.a is not None, r.a or 0, r.b) for r in got.orderBy("index").collect()] == order
    assert [r["index"] for r in got.orderBy("index").collect()] == list(range(1000))
