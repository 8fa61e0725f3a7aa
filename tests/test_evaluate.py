"""Counts of the most frequent, baselines and differences of runs on rows of our own."""

import random
from collections import Counter

import pytest

from tracewright.operators import evaluate


@pytest.mark.parametrize(("capacity", "k"), [(4, 1), (8, 3), (50, 3), (10_000, 5), (2, 30)])
def test_heavy_hitters(spark, capacity, k):
    """Exact counts whatever the capacity: a bound that the k-th doesn't pass makes it count all."""
    rng = random.Random(capacity)
    words = ["hot"] * 900 + ["warm"] * 300 + [f"w{rng.randrange(400)}" for _ in range(1500)] + [None] * 50
    rng.shuffle(words)
    df = spark.createDataFrame([(w,) for w in words], "v string").repartition(5)
    want = sorted(((-n, w) for w, n in Counter(w for w in words if w).items()))[:k]
    assert [(r.v, r.n, r["rank"]) for r in evaluate.heavy_hitters(df, "v", k, capacity).orderBy("rank").collect()] == [(w, -n, i) for i, (n, w) in enumerate(want, 1)]


def test_empty_runs(spark):
    none = spark.createDataFrame([], "key int, technique string")
    assert evaluate.false_positives(none, none, 3).collect() == [] and evaluate.technique_changes(none, none).collect() == []
    r = evaluate.decision_scores(spark.createDataFrame([], "key int, decision string, expected string, negative boolean"), "S").collect()
    assert len(r) <= 1


def test_decisions(spark):
    rows = [(1, "S", "S", False), (2, "B", "S", False), (3, "B", "B", True), (4, "S", "B", True), (5, None, "B", True), (6, "B", None, None)]
    r = evaluate.decision_scores(spark.createDataFrame(rows, "key int, decision string, expected string, negative boolean"), "S").first()
    assert (r.n, r.right, r.false_alarms, r.negatives, r.missed, r.majority, r.baseline, r.beats_baseline) == (6, 2, 1, 3, 1, "B", 3, False)


def test_changes(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (3, 1, "x"), (4, 1, None), (5, 1, "q")], "key int, place int, technique string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "x"), (2, 1, "z"), (3, 1, "x"), (4, 1, "n")], "key int, place int, technique string")
    assert {tuple(r) for r in evaluate.technique_changes(a, b).collect()} == {("x", 1, 0), ("z", 0, 1), ("n", 0, 1)}
    s = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.5), (3, 0.1, 0.2), (4, 0.0, 0.0)], "key int, a double, b double")
    assert tuple(evaluate.arm_compare(a, b, s).first()) == (4, 0.025, 3, 1, 1)


def test_arms(spark):
    wide = spark.createDataFrame([(1, 0.5, None, 1.0, 2), (2, 1.0, None, None, 3)], "key int, a_b_score double, a_b_n int, c_score double, c_n int")
    long = evaluate.arm_rows(wide, ["a_b", "c"], ["score", "n"])
    assert {(r.key, r.arm, r.score, r.n) for r in long.collect()} == {(1, "a_b", 0.5, None), (2, "a_b", 1.0, None), (1, "c", 1.0, 2.0), (2, "c", None, 3.0)}
    assert {tuple(r) for r in evaluate.arm_summary(long, ["score", "n"]).collect()} == {("a_b", 0.75, 0.0), ("c", 1.0, 2.5)}
