"""Exact top-k by inner product with no-random-access aggregation.

Candidates are dealt into blocks, each with a list a dimension sorted by value. A query reads the lists of its positive
components from the top and those of its negative ones from the bottom, sequentially, to a depth that grows by rounds. What
it has seen and the last values read bound every candidate's score from above, what it has seen and the lists' far ends from below.
A candidate whose upper bound is below the k-th best lower bound is out. Reading stops when no more than k are left or the
rounds end; only then are the final scores of those that are left resolved.

The first k-th lower bound of a query is its k-th best score among a bounded sample of candidates, so most outsiders go in the first round, which is one
matrix product for all queries at hand. Bounds are floating-point numbers that allow for their own error; final scores are whole numbers, exact at any size. Candidates are never copied, however many queries there are: a task holds one block of
them and the queries stream by. A last window keeps each query's k best of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.memory import trimmed

#: Candidates of a block at most; smaller tables have up to SPREAD blocks of LEAST or more.
CANDIDATES, SPREAD, LEAST = 32_768, 16, 2_048
#: Candidates that seed the bounds at most, and the share of them all at most. They reach the driver and every task: 4 MB at 64 dimensions.
SAMPLE, SHARE = 8_192, 4
#: Depths of the rounds as shares of the lists, and queries of one product.
DEPTHS = (0.5, 0.75, 0.9, 0.97)
CHUNK = 64


def kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: as 64-bit integers where they fit, else as Python's."""
    if not len(rows):
        return np.zeros(0, np.int64)
    most = int(np.abs(rows.astype(object)).max() if (rows == np.iinfo(np.int64).min).any() else np.abs(rows).max()) * sum(abs(int(x)) for x in query)
    return rows @ query if most < 1 << 63 else rows.astype(object) @ query.astype(object)


def fitting(score: int) -> int:
    """The nearest 64-bit integer."""
    return max(-(1 << 63), min(int(score), (1 << 63) - 1))


def slack(rows: int, most: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """How far a product of floating-point numbers may be from the whole number it stands for, a query: rows components of at most `most` each."""
    return np.abs(queries) @ most * (rows + 4) * 2.0**-51


class Lists:
    """A block's candidates with their sorted lists. whole are the candidates as 64-bit integers."""

    def __init__(self, whole: np.ndarray, ids: np.ndarray):
        rows = whole.astype(np.float64)
        self.whole, self.rows, self.ids, self.lists = whole, rows, ids, np.sort(rows, axis=0)
        self.most = np.abs(rows).max(0)
        head, foot = self.read(DEPTHS[0])
        self.first = np.concatenate([np.maximum(rows, head), np.minimum(rows, foot)], 1)

    def read(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """The last values read from the top and from the bottom."""
        n = len(self.rows)
        t = min(n, max(1, int(n * depth)))
        return self.lists[n - t], self.lists[t - 1]

    def top(self, whole: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
        """(query id, id, score) of each query's k best with another id and a score of its seed or more, ties to the smaller id; and how many candidates were left to resolve. A score is the nearest 64-bit integer, ranks follow the whole number."""
        queries = whole.astype(np.float64)
        upper = self.first @ np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1).T
        may_err = slack(queries.shape[1], self.most, queries)
        out, resolved = [], 0
        for x, (q, own, seed, err) in enumerate(zip(queries, query_ids.tolist(), seeds.tolist(), may_err.tolist(), strict=True)):
            seed -= err
            alive = np.flatnonzero((upper[:, x] >= seed - err) & (self.ids != own))
            for depth in DEPTHS[1:]:
                if len(alive) <= k:
                    break
                head, foot = self.read(depth)
                last, rest, rows = np.where(q > 0, head, foot), np.where(q > 0, self.lists[0], self.lists[-1]), self.rows[alive]
                seen = np.where(q > 0, rows >= last, rows <= last)
                least = max(seed, kth(np.where(seen, rows, rest) @ q, k) - err)
                alive = alive[np.where(seen, rows, last) @ q >= least - err]
            resolved += len(alive)
            score = exact(self.whole[alive], whole[x])
            best = sorted(range(len(alive)), key=lambda i: (-score[i], self.ids[alive[i]]))[:k] if score.dtype == object else np.lexsort((self.ids[alive], -score))[:k]
            out += [(own, int(self.ids[alive[b]]), int(score[b])) for b in best]
        return out, resolved


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component, a row each. Rows without vec_id, with a null or empty vector or with null or non-finite components are out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & (F.size("embedding") > 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def seeded(queries: DataFrame, vectors: DataFrame, rows: int, k: int) -> DataFrame:
    """queries(dim, vec_id, v) with seed, the k-th best score among a sample of vectors with other ids; -infinity if that has fewer of the dimension."""
    step = max(SHARE, -(-rows // SAMPLE))
    sample = {}
    for dim, i, v in vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(2 * SAMPLE).select("dim", "vec_id", "v").collect():
        sample.setdefault(dim, []).append((i, v))
    sample = {dim: (np.array([i for i, _ in x]), np.array([v for _, v in x], np.int64).astype(np.float64)) for dim, x in sample.items()}

    def run(batches):
        for batch in batches:
            dims, ids, seeds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 0))
            seeds = np.full(len(dims), -np.inf)
            for dim in set(dims.tolist()) & set(sample):
                other, known = sample[dim]
                for some in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // CHUNK)):
                    asked = _matrix(batch.column(2).take(pa.array(some))).astype(np.float64)
                    scores = known @ asked.T - slack(dim, np.abs(known).max(0), asked)
                    scores[other[:, None] == ids[some]] = -np.inf
                    if len(other) >= k:
                        seeds[some] = np.partition(scores, len(other) - k, axis=0)[len(other) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seeds)], ["dim", "vec_id", "v", "seed"])

    return queries.select("dim", "vec_id", "v").mapInArrow(trimmed(run), "dim int, vec_id bigint, v array<bigint>, seed double")


def top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, v) its k best rows of vectors(vec_id, v) with another vec_id and as many components. Repeated rows count as often as they are there.

    A score that no 64-bit integer holds is given as the nearest one; its rank is that of the whole number, to 53 bits of what it exceeds by. Components beyond 64 bits count as the nearest that fits.
    """
    dim = F.size("v").alias("dim")
    vectors, queries = vectors.select(dim, "vec_id", "v"), queries.select(dim, "vec_id", "v")
    counts = vectors.groupBy("dim").agg(F.count("*").alias("n"))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = counts.select("dim", F.greatest(F.ceil(F.col("n") / CANDIDATES), F.least(F.lit(SPREAD), F.ceil(F.col("n") / LEAST))).cast("int").alias("blocks"))
    # any dealing will do, and one by hash would put repeated rows together
    near = vectors.withColumn("_i", F.monotonically_increasing_id()).join(blocks, "dim").select("dim", F.pmod("_i", "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("seed"))
    far = seeded(queries, vectors, rows, k).join(blocks, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "seed")
    order = ["dim", "block", "kind"]

    def search(batches):
        now, parts, lists = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, where = batch.slice(a, b - a), tuple(key[:2, a].tolist())
                if where != now:
                    now, parts, lists = where, [], None
                ids = part.column(3).to_numpy(zero_copy_only=False)
                if key[2, a] == 0:
                    parts.append((_matrix(part.column(4)), ids))
                    continue
                if lists is None and parts:
                    lists = Lists(np.concatenate([m for m, _ in parts]), np.concatenate([i for _, i in parts]))
                    parts = []
                for c in range(0, b - a if lists else 0, CHUNK):
                    some = part.slice(c, CHUNK)
                    found, _ = lists.top(_matrix(some.column(4)), ids[c : c + CHUNK], some.column(5).to_numpy(zero_copy_only=False), k)
                    # a score beyond 64 bits is ranked by its excess too
                    columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([fitting(f[2]) for f in found], pa.int64()), pa.array([float(f[2] - fitting(f[2])) for f in found])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "excess"])

    met = near.unionByName(far).repartition("dim", "block").sortWithinPartitions(*order)
    found = met.select(*order, "vec_id", "v", "seed").mapInArrow(trimmed(search), "query_id bigint, vec_id bigint, score bigint, excess double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("excess").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nra_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all embeddings for each whose vec_id is divisible by 100."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
