"""The stored index of vectors against comparing all."""

import numpy as np
import pytest

from tracewright.operators import vectors


def plain(q, v, k):
    unit = lambda x: np.array(x, float) / np.linalg.norm(x)
    out = {}
    for qi, qv in q:
        found = sorted((-round(float(unit(qv) @ unit(x)), 6) + 0.0, i) for i, x in v if i != qi)
        out[qi] = [(i, -s) for s, i in found[:k]]
    return out


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 10))
    v = [(i, (centre[i % 12] + rng.normal(size=10) * 0.15).tolist()) for i in range(900)]
    v += [(900 + i, v[5][1]) for i in range(30)] + [(2000, (np.array(v[7][1]) * 1e150).tolist())]
    return v, v[::60]


def _same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


def test_exact_and_saved(spark, data, tmp_path, monkeypatch):
    v, q = data
    vs, qs = spark.createDataFrame(v, "id bigint, v array<double>").repartition(3), spark.createDataFrame(q, "query_id bigint, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "TOGETHER", 4)
    index = vectors.save(vectors.build(vs), str(tmp_path / "i"), {"of": "v"})
    for k in (1, 7, 40, 2000):
        _same(rows(vectors.search(qs, index, k)), plain(q, v, k))
    read = vectors.lists_read(qs, index, 7).collect()
    assert len(read) == len(q) and all(0 < r.lists_read < r.lists for r in read)
    with pytest.raises(ValueError):
        vectors.load(spark, str(tmp_path / "i"), {"of": "w"})
    assert index.lists.selectExpr("sum(size(ids)) n").first().n == len(v)


def test_recall_of_probes(spark, data):
    v, q = data
    vs, qs = spark.createDataFrame(v, "id bigint, v array<double>"), spark.createDataFrame(q, "query_id bigint, v array<double>")
    got, want = rows(vectors.search(qs, vectors.build(vs), 10, probes=6)), plain(q, v, 10)
    hit = sum(len({i for i, _ in got[x]} & {i for i, _ in want[x]}) for x in want)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_odd_vectors(spark):
    odd = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [float("inf"), 0.0]), (None, [0.0, 1.0])]
    vs, qs = spark.createDataFrame(odd, "id bigint, v array<double>"), spark.createDataFrame(odd[:8], "query_id bigint, v array<double>")
    got = rows(vectors.search(qs.dropDuplicates(["query_id"]), vectors.build(vs), 5))
    assert set(got) == {1, 7} and [i for i, _ in got[1]][:2] == [7, 7] and got[7][0] == (1, 1.0)
    assert vectors.search(qs, vectors.build(vs.where("false")), 3).collect() == []
    with pytest.raises(ValueError):
        vectors.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, v array<double>"))
    names = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert [i for i, _ in rows(vectors.search(names.withColumnRenamed("id", "query_id").where("query_id = 'a'"), vectors.build(names), 2))["a"]] == ["b", "c"]


def test_nearest_in_blocks_and_closest(spark):
    """Against all pairs: copies, no direction, odd sizes, over several blocks and parts. Each task gives on only what may be among the best."""
    import random

    from pyspark.sql import functions as F

    from tracewright.operators import retrieve

    rng = random.Random(9)
    vs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, vs[i % 40], i % 3) for i in range(300)] + [(300, [0.0] * 4, 1), (301, None, 1), (302, [1.0, 2.0], None), (303, [1.0, None, 2.0, 3.0], 1), (None, vs[0], 1)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    asked = df.where("id % 25 = 0 or id > 299").withColumnRenamed("id", "query_id")
    got = retrieve.nearest(asked.select("query_id", "v"), df.select("id", "v"), 7, block=50, together=4)
    dot = F.aggregate(F.zip_with("q", "v", lambda i, j: i * j), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    pairs = asked.select("query_id", F.col("v").alias("q")).join(df, F.col("query_id") != F.col("id"))
    want = retrieve.ranked(pairs.select("query_id", "id", F.round(F.when((size("q") > 0) & (size("v") > 0), dot / size("q") / size("v")), 6).alias("score")), 7)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 7 * asked.count()
    low = retrieve._nearest_of(7)(pa_table(asked.where("query_id < 300"), "query_id", "own", "q"), pa_table(df.where("id < 300"), "id", None, "v"))
    assert low.num_rows < 12 * 40
    near = retrieve.closest(asked.select("query_id", "label"), df.select("id", "label"), "label", 5, block=20, together=3)
    of = {i: x for i, _, x in rows}
    best = {(q, i) for q in of if q is not None and (q % 25 == 0 or q > 299) and of[q] is not None for i in sorted((i for i in of if i is not None and i != q and of[i] == of[q]), key=lambda i: (abs(i - q), i))[:5]}
    assert {(r.query_id, r.id) for r in near.collect()} == best


def pa_table(df, first, own, v):
    import pyarrow as pa

    got = [(r[0], r.v) for r in df.select(first, "v").collect()]
    ids = pa.array([x for x, _ in got], pa.int64())
    return pa.table({first: ids, **({own: ids} if own else {}), v: pa.array([x for _, x in got], pa.list_(pa.float64()))})


def test_tasks_make_little_at_once(spark, monkeypatch):
    """A large Arrow batch is planned some queries at a time: a query leaves a row of each list, with its vector, and all of them at once grow with queries times lists."""
    import pyarrow as pa

    v = np.random.default_rng(4).normal(size=(400, 8))
    index = vectors.build(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>"))
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "query_id bigint, v array<double>")
    plans, through = [], type(queries).mapInArrow
    monkeypatch.setattr(type(queries), "mapInArrow", lambda df, f, schema, *a: (plans.append(f) if f.__name__ == "plan" else None, through(df, f, schema, *a))[1])
    vectors.search(queries, index, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(v.tolist())], ["query_id", "v"])
    sizes = [b.num_rows for b in plans[0](iter([batch]))]
    assert sum(sizes) == 400 * 20 and max(sizes) <= vectors.PLANNED * 20
