"""Ranked lexical search with block maxima over blocks of variable size.

One pass over the documents keeps what the queries' terms need: of each document its number of terms, and which of these
terms it holds how often. From that table Spark takes the corpus's figures. Then each task holds a shard of the
documents as posting lists. Dynamic programming cuts each list into blocks so that the sum of what block maxima
overstate is least. A query adds up the maxima of the blocks that lie over each document, as WAND does at a pivot. Where the
sum is below the k-th score so far, documents are passed over, and blocks without another document aren't opened. Scores are whole
numbers, so bounds are exact and nothing is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.chunks import SLICE, binary
from tracewright.llm.memory import trimmed
from tracewright.llm.words import text_arrays
from tracewright.workspace import materialize

#: Queries and characters of queries that one pass over the documents answers; more queries take more passes.
QUERIES, CHARACTERS = 4_000, 4_000_000
#: Postings that a task holds at once; a larger partition is several shards.
SHARD = 3_000_000
#: Postings of the longest block, postings within which boundaries are chosen together, and what a block costs in the unit of impacts.
BLOCK, ROW, OPENING = 64, 256, 2_000_000
#: Documents of the highest bounds whose scores give the first threshold, and documents between two looks at the threshold.
SEEDS, STRETCH = 64, 8_192

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts as one binary array, and at: text i has terms at[i]:at[i+1]. Null counts as empty."""
    data, offsets = text_arrays(column)
    data, offsets = _LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    solid = _TERM[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[offsets < len(data)]
    first[inner] = solid[inner]
    start = np.flatnonzero(first)
    edges = np.r_[np.cumsum(solid)[start] - 1, np.count_nonzero(solid)]
    return binary(data[solid], edges), np.searchsorted(start, offsets)


def postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, times): the number of terms of each row's whole text, and the places in known of those it holds with how often."""

    def run(batches):
        look = pa.array(known, pa.large_binary())
        for batch in batches:
            _, offsets = text_arrays(batch.column(1))
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
                found, at = terms(batch.column(1).slice(row, stop - row))
                place = pc.index_in(found, value_set=look)
                hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                doc = np.searchsorted(at, hit, "right") - 1
                key, times = np.unique(doc * max(1, len(known)) + place.drop_null().to_numpy().astype(np.int64), return_counts=True)
                ends = np.searchsorted(key, np.arange(stop - row + 1) * max(1, len(known))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(known)), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(np.diff(at).astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"])
                row = stop

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id bigint, n bigint, terms array<int>, times array<int>")


def boundaries(impact: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where blocks begin in the lists impact[at[i]:at[i+1]], and the end of all.

    Least sum, over blocks, of OPENING and of what the block's maximum overstates, by dynamic programming over blocks of up to BLOCK postings; a list longer than ROW is
    cut into rows of ROW first. All rows go forward together.
    """
    size = np.diff(at)
    rows = -(-size // ROW)
    start = np.repeat(at[:-1], rows) + (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * ROW
    n = np.minimum(np.repeat(at[1:], rows) - start, ROW)
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    if not len(n):
        return np.zeros(1, np.int64)
    most = int(n[0])
    col = np.arange(most)
    value = np.where(col < n[:, None], impact[np.minimum(start[:, None] + col, len(impact) - 1)], 0).astype(np.float64)
    total = np.zeros((len(n), most + 1))
    np.cumsum(value, axis=1, out=total[:, 1:])
    best = np.zeros((len(n), most + 1))
    back = np.zeros((len(n), most), np.int16)
    high = np.zeros((len(n), BLOCK))
    length = np.arange(1, BLOCK + 1)
    for i in range(most):
        r = int(np.searchsorted(-n, -i, "left"))  # rows longer than i
        v = value[:r, i, None]
        high[:r, 1:] = np.maximum(high[:r, :-1], v)
        high[:r, :1] = v
        w = min(i + 1, BLOCK)
        cost = high[:r, :w] * length[:w] + (best[:r, i - w + 1 : i + 1] + total[:r, i - w + 1 : i + 1])[:, ::-1]
        j = cost.argmin(1)
        best[:r, i + 1] = cost[np.arange(r), j] + OPENING - total[:r, i + 1]
        back[:r, i] = j + 1
    found, left, row = [], n.copy(), np.arange(len(n))
    while len(row):
        left = left - back[row, left - 1]
        found.append(start[row] + left)
        row, left = row[left > 0], left[left > 0]
    return np.r_[np.sort(np.concatenate(found)), at[-1]]


class Shard:
    """Posting lists of some documents, in the order of doc_id, null last."""

    def __init__(self, ids: pa.Array, n: np.ndarray, term: np.ndarray, times: np.ndarray, at: np.ndarray, corpus: tuple[int, int], vocabulary: int):
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = ids.take(pa.array(order))
        doc = place[np.repeat(np.arange(len(n)), np.diff(at))]
        by = np.lexsort((doc, term))
        self.doc, times = doc[by], times[by].astype(np.int64)
        documents, total = corpus
        m = 10 + (90 * n[order] * documents) // max(1, total)
        self.impact = (1_000_000_000 * times) // (1000 * times + 8 * m[self.doc])
        self.at = np.searchsorted(term[by], np.arange(vocabulary + 1))
        self.start = boundaries(self.impact, self.at)
        self.first, self.last = (self.doc[self.start[:-1]], self.doc[self.start[1:] - 1]) if len(self.doc) else (self.doc, self.doc)
        self.high = np.maximum.reduceat(self.impact, self.start[:-1]) if len(self.doc) else self.impact
        self.blocks = np.searchsorted(self.start[:-1], self.at) if len(self.doc) else np.zeros(vocabulary + 1, np.int64)
        self.opened = self.seen = 0

    def search(self, wanted: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the up to k best documents that reach least, best first. wanted: places of the query's terms; weight: of each."""
        sizes = self.blocks[wanted + 1] - self.blocks[wanted]
        block = _ranges(self.blocks[wanted], sizes)
        gain = np.repeat(weight, sizes)
        high = gain * self.high[block]
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, self.first[block], high)
        np.subtract.at(step, self.last[block] + 1, high)
        bound = np.cumsum(step[:-1])
        self.seen += len(block)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        todo = bound >= max(1, least)
        rounds = [np.arange(a, min(a + STRETCH, len(bound))) for a in range(0, len(bound), STRETCH)]
        if np.count_nonzero(todo) > SEEDS:
            rounds.insert(0, np.argpartition(-bound, SEEDS)[:SEEDS])
        for part in rounds:
            part = part[todo[part] & (bound[part] >= least)]
            if not len(part):
                continue
            todo[part] = False
            best, score = _best(np.r_[best, part], np.r_[score, self._scores(part, block, gain)], k)
            if len(best) == k:
                least = max(least, int(score[-1]))
        keep = score >= max(1, least)
        return best[keep], score[keep]

    def _scores(self, part, block, gain):
        """The scores of the documents at part, from the blocks that hold one of them."""
        live = np.zeros(len(self.ids), bool)
        live[part] = True
        upto = np.r_[0, np.cumsum(live)]
        used = upto[self.last[block] + 1] > upto[self.first[block]]
        b, g = block[used], gain[used]
        self.opened += len(b)
        n = self.start[b + 1] - self.start[b]
        at = _ranges(self.start[b], n)
        mine = live[self.doc[at]]
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.doc[at[mine]], np.repeat(g, n)[mine] * self.impact[at[mine]])
        return out[part]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _best(place, score, k):
    order = np.lexsort((place, -score))[:k]
    return place[order], score[order]


def _blocks(queries: DataFrame):
    """Lists of (item_id, text), of QUERIES rows and CHARACTERS characters at most (or one row)."""
    rows, size = [], 0
    for r in queries.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) >= QUERIES or size + len(r.text) > CHARACTERS):
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += len(r.text)
    if rows:
        yield rows


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of docs(doc_id, text) for each row of queries(item_id, text), score above 0, ties to the smaller doc_id, null last.

    Null and term-less queries and documents have no result. A repeated row of docs is a document of its own; equal rows of queries are one; an item_id with unlike texts
    has each text's ranks. Queries are answered in blocks whose size is bounded, each by a pass over all documents.
    """
    spark, out = docs.sparkSession, None
    for rows in _blocks(queries):
        found = _answer(docs, rows, k)
        out = found if out is None else out.unionByName(found)
    kind = queries.schema["item_id"].dataType.simpleString()
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score") if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def _answer(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    found, at = terms(pa.array([t for _, t in rows], pa.string()))
    known = found.unique()
    place = pc.index_in(found, value_set=known).to_numpy(zero_copy_only=False)
    wanted = [np.unique(place[a:b]).astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
    index = materialize(postings(docs, known.to_pylist()), "postings")
    figures = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    documents, total = figures.documents, figures.total
    weight = np.zeros(len(known), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weight[r.t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))

    def run(batches):
        least = [0] * len(wanted)
        kept = [np.zeros((0,), np.int64)] * len(wanted)
        for shard in _shards(batches, (documents, total), len(weight)):
            query, ids, scores = [], [], []
            for q, terms_ in enumerate(wanted):
                best, score = shard.search(terms_, weight[terms_], k, least[q])
                if len(best):
                    kept[q] = -np.sort(-np.r_[kept[q], score])[:k]
                    least[q] = int(kept[q][-1]) if len(kept[q]) == k else 0
                    query.append(np.full(len(best), q, np.int32))
                    ids.append(shard.ids.take(pa.array(best)))
                    scores.append(score)
            if query:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.concat_arrays(ids), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

    best = index.mapInArrow(trimmed(run), "query int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, str(i) if i is not None else None) for q, (i, _) in enumerate(rows)], "query int, item_id string")
    return top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def _shards(batches, corpus, vocabulary):
    held, size = [], 0
    for batch in batches:
        row = 0
        ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))]
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SHARD - size, "right")) - 1)
            held.append(batch.slice(row, stop - row))
            size += int(ends[stop] - ends[row])
            row = stop
            if size >= SHARD or row < batch.num_rows:
                yield _shard(held, corpus, vocabulary)
                held, size = [], 0
    if held:
        yield _shard(held, corpus, vocabulary)


def _shard(held, corpus, vocabulary):
    t = pa.Table.from_batches(held).combine_chunks()
    ids, n, lists, times = (t.column(i).combine_chunks() if isinstance(t.column(i), pa.ChunkedArray) else t.column(i) for i in range(4))
    at = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
    return Shard(ids, n.to_numpy(), lists.flatten().to_numpy(), times.flatten().to_numpy(), at, corpus, vocabulary)


def op12_block_max_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_UPPER, _PATTERN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_PATTERN}') AS ts FROM documents),
figures AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS total FROM docs),
lengths AS (SELECT r, doc_id, 10 + (90 * len(ts) * docs) // total AS m FROM docs, figures WHERE len(ts) > 0),
held AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, figures GROUP BY t, docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_PATTERN}')) AS t FROM benchmark),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN held USING (t) JOIN weights USING (t) JOIN lengths USING (r) GROUP BY item_id, doc_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
