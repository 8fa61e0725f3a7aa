"""A stored index of vectors: lists around centroids, and search that skips lists by the triangle inequality.

Centroids come from a bounded sample, but every vector is put into the list of its nearest one. A list is kept as blocks of unit vectors, one
row of bytes a block, with its radius. A query looks into its nearest lists first. Then a list is read only if it can hold something nearer than the k-th found
so far: nothing in it is nearer than the distance to its centroid less its radius. So results are those of comparing all. With a number of probes
the search reads just so many lists and may miss some.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.sources import readers
from tracewright.workspace import materialize

#: Vectors that centroids are taken from, by a hash of their id; the most lists; vectors of a block; queries that meet a block at once; lists that are read first.
SAMPLE, LISTS, BLOCK, TOGETHER, FIRST = 20_000, 1_024, 4_096, 256, 4
#: Bytes of centroids that are sent to each task.
CENTROID_BYTES = 64 << 20
ROUNDS = 8
#: Distances to centroids that a task holds at once, and queries, each of which leaves it with a row of every list.
DISTANCES, PLANNED = 1 << 20, 32


class Index(NamedTuple):
    """lists(list, block, ids, unit) and centroids(list, centroid, radius, n)."""

    lists: DataFrame
    centroids: DataFrame


def usable(vectors: DataFrame, column: str = "v") -> DataFrame:
    """Vectors that have a direction: not null or empty, every component a finite number, not all zero. Others have no place in an index and no neighbours."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    scale = np.abs(m).max(1, keepdims=True)
    m = m / scale  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _slices(batches, rows: int):
    """Batches cut into some rows each, so that what a task makes of them is bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by rounds of k-means on the sphere; a list that runs empty keeps its centroid."""
    c = sample[np.unique(np.linspace(0, len(sample) - 1, lists).astype(int))]
    for _ in range(ROUNDS):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """An index of vectors(id, v). lists: how many, the square root of their number unless given, LISTS at most. Vectors of unlike sizes are an error; repeated ids all stay."""
    spark, kind = vectors.sparkSession, _id_type(vectors, "id")
    good = usable(vectors.select("id", "v"))
    n, low, high = good.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    empty = Index(spark.createDataFrame([], f"list int, block bigint, ids array<{kind}>, unit binary"), spark.createDataFrame([], "list int, centroid array<double>, radius double, n bigint"))
    if not n:
        return empty
    lists = max(1, min(lists or int(n**0.5), LISTS, n, CENTROID_BYTES // (8 * low)))
    sample = good.select(F.xxhash64("id").alias("h"), F.transform("v", lambda x: x.cast("double")).alias("v")).orderBy("h", "v").limit(SAMPLE).toArrow()
    c = _centroids(_matrix(sample.column("v").combine_chunks()), lists)

    def assign(batches):
        for batch in _slices(batches, max(1, DISTANCES // len(c))):
            m = _matrix(batch.column(1))
            near = (m @ c.T).argmax(1)
            far = np.sqrt(((m - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(far), pa.array([x.tobytes() for x in m], pa.binary())], ["id", "list", "far", "unit"])

    put = materialize(good.mapInArrow(assign, f"id {kind}, list int, far double, unit binary"), "assigned")
    radii = put.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    made = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list int, centroid array<double>").join(radii, "list")
    # rows of a list are dealt in turn, so that equal ids don't meet in one block
    block = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / BLOCK))
    dealt = put.join(F.broadcast(radii.select("list", "n")), "list").select("list", block.alias("block"), "id", "unit")
    packed = dealt.groupBy("list", "block").agg(F.collect_list(F.struct("id", "unit")).alias("x")).select("list", "block", F.col("x.id").alias("ids"), F.expr("unhex(array_join(transform(x.unit, u -> hex(u)), ''))").alias("unit"))
    return Index(packed, made)


def save(index: Index, path: str, stamp: dict) -> Index:
    """Writes both tables and reads them again; the stamp says what the index is of."""
    for name, df in (("centroids", index.centroids), ("lists", index.lists)):
        readers.write_index(df, f"{path}/{name}", stamp)
    return load(index.lists.sparkSession, path, stamp)


def load(spark, path: str, stamp: dict) -> Index:
    """The index that was saved last, if its stamp is the one asked for; else an error."""
    return Index(readers.open_index(spark, f"{path}/lists", stamp), readers.open_index(spark, f"{path}/centroids", stamp))


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine, rounded to six places, ties to the smaller id; an entry with the query's own id is none.

    Exact unless probes is given. A repeated query_id is one query for each of its rows' vectors, ranked together.
    """
    return _search(queries, index, k, probes)[0]


def lists_read(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, lists_read, lists): how many lists an exact search opens for a query, of how many there are."""
    _, asked = _search(queries, index, k, None)
    return asked.groupBy("query_id").agg(F.count_distinct("list").alias("lists_read")).withColumn("lists", F.lit(index.centroids.count()).cast("bigint"))


def _search(queries, index, k, probes):
    spark, q_kind, kind = queries.sparkSession, _id_type(queries, "query_id"), _id_type(index.lists, "ids").removeprefix("array<").removesuffix(">")
    table = index.centroids.orderBy("list").toArrow()  # LISTS rows at most
    none = spark.createDataFrame([], f"query_id {q_kind}, id {kind}, score double, rank int")
    if not table.num_rows:
        return none, spark.createDataFrame([], f"query_id {q_kind}, list int")
    number = table.column("list").to_numpy()
    c, radius, held = _matrix(table.column("centroid").combine_chunks()), table.column("radius").to_numpy(), table.column("n").to_numpy()

    def plan(batches):
        """For each query all lists that are read first, and for the others how near they may come."""
        for batch in _slices(batches, max(1, min(PLANNED, DISTANCES // len(c)))):
            m = _matrix(batch.column(1))
            far = np.sqrt(np.maximum(0, 2 - 2 * (m @ c.T)))
            order = np.argsort(far, axis=1, kind="stable")
            place = np.broadcast_to(np.arange(len(c)), order.shape)
            if probes:
                keep, first = place < probes, place < probes
            else:  # until the lists before hold more than k
                keep, first = np.ones(order.shape, bool), (np.cumsum(held[order], axis=1) - held[order] <= k) | (place < FIRST)
            low = np.maximum(0, np.take_along_axis(far - radius, order, 1))
            take = pa.array(np.repeat(np.arange(len(m)), keep.sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(number[order[keep]].astype(np.int32)), pa.array(first[keep]), pa.array(low[keep]), pa.array([x.tobytes() for x in m], pa.binary()).take(take)], ["query_id", "list", "first", "low", "q"])

    good = usable(queries.select("query_id", "v"))
    groups = max(1, -(-good.count() // TOGETHER))
    asked = materialize(good.mapInArrow(plan, f"query_id {q_kind}, list int, first boolean, low double, q binary"), "asked")
    head = asked.where("first")
    scores = materialize(_scores(head, index.lists, groups, k, q_kind, kind), "near")
    if probes:
        return _ranked(scores, k), head
    # ranks come from rounded scores, so a list counts unless it is clearly beyond the k-th
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    worst = scores.withColumn("_r", rank).where(F.col("_r") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") - 2e-6))).alias("far"))
    more = asked.where(~F.col("first")).join(worst, "query_id", "left").where(F.col("far").isNull() | (F.col("low") <= F.col("far")))
    both = scores.unionByName(_scores(more, index.lists, groups, k, q_kind, kind))
    return _ranked(both, k), head.select("query_id", "list").unionByName(more.select("query_id", "list"))


def _ranked(scores, k):
    rounded = scores.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def _scores(asked, lists, groups, k, q_kind, kind):
    """(query_id, id, score): of each block that is read, the k best of each query. Queries of a list meet its blocks some hundred at a time, by a join of lists."""
    together = asked.groupBy("list", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("x"))
    pairs = together.join(lists, "list").select(F.col("x.query_id").alias("query_ids"), F.col("x.q").alias("q"), "ids", "unit")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asking, q = batch.column(0)[i].values, np.frombuffer(b"".join(batch.column(1)[i].as_py()), np.float64)
                ids = batch.column(2)[i].values
                m = np.frombuffer(batch.column(3)[i].as_py(), np.float64).reshape(len(ids), -1)
                dot, kept = q.reshape(len(asking), -1) @ m.T, [(np.empty(0, int), np.empty(0, int), np.empty(0))]
                for j, own in enumerate(asking):
                    s = np.where(pc.equal(ids, own).fill_null(False).to_numpy(zero_copy_only=False), -np.inf, dot[j])
                    if len(s) > 2 * k:  # all that may be among the k best once rounded
                        least = np.partition(s, len(s) - k)[len(s) - k] - 1e-6
                        at = np.flatnonzero((s >= least) & (s > -np.inf))
                    else:
                        at = np.flatnonzero(s > -np.inf)
                    kept.append((np.full(len(at), j), at, s[at]))
                of, at, score = (np.concatenate(x) for x in zip(*kept, strict=True))
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(of)), ids.take(pa.array(at)), pa.array(score)], ["query_id", "id", "score"])

    return pairs.mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")
