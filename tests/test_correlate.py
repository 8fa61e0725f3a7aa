"""Chains of neighbours give the components of the pairwise definition."""

import random
from datetime import datetime, timedelta

import pytest

from tracewright.operators.correlate import incident_groups, islands
from tracewright.operators.graph import connected_components

T0 = datetime(2024, 1, 1)
SCHEMA = "row bigint, ts timestamp_ntz, user string, host string, process_guid string, parent_process_guid string, process_id string, parent_process_id string, skipped boolean"


def related(a, b):
    if a[1] is not None and b[1] is not None and abs(a[1] - b[1]) > timedelta(hours=24):
        return False
    same = lambda x, y: bool(x and y and x.lower() == y.lower())
    if same(a[2], b[2]) or same(a[3], b[3]) or same(a[4], b[5]) or same(b[4], a[5]):
        return True
    return not a[4] and not b[4] and (same(a[6], b[7]) or same(b[6], a[7]))


def brute(rows):
    rows = [r for r in rows if not r[8]]
    label = {r[0]: r[0] for r in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in rows:
        for b in rows:
            if a[0] < b[0] and related(a, b):
                x, y = sorted((find(a[0]), find(b[0])))
                label[y] = x
    groups = {}
    for i in label:
        groups.setdefault(find(i), set()).add(i)
    return {i: g for g, m in groups.items() if len(m) > 1 for i in m}


@pytest.mark.parametrize("seed", range(6))
def test_chain_is_pairwise(spark, seed):
    rng = random.Random(seed)
    pick = lambda xs, p=0.5: rng.choice(xs) if rng.random() < p else None
    rows = []
    for i in range(40):
        ts = None if rng.random() < 0.05 else T0 + timedelta(hours=rng.choice([0, 1, 24, 25, 48, 49, rng.random() * 400]))
        rows.append((i, ts, pick(["Bob", "bob", "eve", "", *map(str, range(9))], 0.3), pick(["h1", "H2", *map(str, range(30))], 0.3), pick(list("abc"), 0.2), pick(list("abc"), 0.2), pick(["1", "2", "3"], 0.2), pick(["1", "2", "4"], 0.2), rng.random() < 0.1))
    got = {r.row: r.incident for r in incident_groups(spark.createDataFrame(rows, SCHEMA), ["user", "host"]).collect()}
    assert got == brute(rows)


def test_gap_of_a_day_stays_together(spark):
    rows = [(1, T0), (2, T0 + timedelta(hours=24)), (3, T0 + timedelta(hours=48, seconds=1)), (4, None)]
    df = spark.createDataFrame([("u", *r) for r in rows], "u string, i bigint, ts timestamp_ntz")
    assert {r.i: r.island for r in islands(df, ["u"], "ts", "i").collect()} == {1: 1, 2: 1, 3: 2}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (None, 4)] + [(100, i) for i in range(101, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 5 for i in range(5, 10)}, **{i: 100 for i in range(100, 150)}}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src bigint, dst bigint")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


def test_queries_take_the_whole_window(spark, tmp_path):
    """Events related within a day are in one incident, against the pairwise definition."""
    import json

    from tracewright.plans.registry import QUERIES

    rng = random.Random(12)
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(i, T0 + timedelta(seconds=rng.randrange(60 * 86400)), rng.randrange(9), rng.choice(kinds), 1.0, json.dumps({"k": rng.randrange(40)})) for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")

    def sizes(related):
        label = {r[0]: r[0] for r in rows}
        for a in rows:
            for b in rows:
                if abs(a[1] - b[1]) <= timedelta(hours=24) and related(a, b):
                    x, y = label[a[0]], label[b[0]]
                    label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return sorted(n for v in set(label.values()) if (n := list(label.values()).count(v)) > 1)

    day = [r.n for r in QUERIES["incident_components_day"](spark, str(tmp_path)).collect()]
    assert sorted(day) == sizes(lambda a, b: a[2] == b[2] or a[3] == b[3] and a[5] == b[5]) != []
    bulk = [r.n_rows for r in QUERIES["bulk_incidents"](spark, str(tmp_path)).collect()]
    assert sorted(bulk) == sizes(lambda a, b: a[2] == b[2] or a[5] == b[5])


def test_rows_of_the_same_slices_are_no_edges(spark, monkeypatch):
    """What components are made of grows with slices that meet, and not with rows: 600 rows of two users on two hosts within a day."""
    from datetime import datetime, timedelta

    from tracewright.operators import correlate

    seen = []
    monkeypatch.setattr(correlate, "connected_components", lambda edges: seen.append(edges.where("src <> dst").distinct().count()) or connected_components(edges))
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i), f"u{i % 2}", f"h{i % 2}") for i in range(600)] + [(600, start + timedelta(days=9), "u0", None), (601, None, None, "h1")]
    df = spark.createDataFrame(rows, "row bigint, ts timestamp_ntz, user string, host string")
    got = {r.row: r.incident for r in incident_groups(df, ["user", "host"], lineage=False).collect()}
    assert got == {**{i: i % 2 for i in range(600)}, 601: 1}
    assert seen[0] <= 4
