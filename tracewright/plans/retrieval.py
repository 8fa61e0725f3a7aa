"""Ranking, packing and fingerprint queries over documents, benchmark, embeddings and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from tracewright.functions import text
from tracewright.operators import retrieve, vectors
from tracewright.workspace import shared_dir, table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _bm25(spark, d, k):
    return retrieve.bm25(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _docs(spark, d), k)


def bm25_topk(spark, d):
    return _bm25(spark, d, 10)


def _embeddings(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e


def _vectors(spark, d, k):
    return retrieve.nearest(*_embeddings(spark, d), k)


def _index(spark, e):
    """The vectors' index, saved and opened again."""
    return vectors.save(vectors.build(e), f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", {"of": "embeddings", "dim": e.selectExpr("max(size(v)) n").first().n})


def vector_topk(spark, d):
    """The 20 nearest of each query through the stored index, exactly."""
    queries, e = _embeddings(spark, d)
    return vectors.search(queries, _index(spark, e), 20)


def vector_lists(spark, d):
    """How many queries opened how many of the index's lists for their 5 nearest, exactly."""
    queries, e = _embeddings(spark, d)
    return vectors.lists_read(queries, _index(spark, e), 5).groupBy("lists_read", "lists").agg(F.count("*").alias("queries"))


def vector_recall(spark, d):
    """Recall of the 10 nearest when each query opens half of the lists, against comparing all; true if it reaches 0.9."""
    queries, e = _embeddings(spark, d)
    index = _index(spark, e)
    best = vectors.search(queries, index, 10).select("query_id", "id")
    found = vectors.search(queries, index, 10, probes=max(1, index.centroids.count() // 2)).select("query_id", "id", F.lit(1).alias("hit"))
    return best.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("n"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def _fused(spark, d):
    semantic = _vectors(spark, d, 20).select("query_id", "id", "rank")
    e = table(spark, d, "embeddings")
    labelled = e.select(F.col("vec_id").alias("id"), "label")
    keyword = retrieve.closest(labelled.where("id % 100 = 0").withColumnRenamed("id", "query_id"), labelled, "label", 20).select("query_id", "id", "rank")
    return retrieve.fuse([semantic, keyword])


def rrf_fusion(spark, d):
    return _fused(spark, d)


def rrf_fusion_capped(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("technique"))
    return retrieve.cap_per_technique(_fused(spark, d).join(labels, "id")).select("query_id", "id", "technique", "rank")


def platform_filter_fallback(spark, d):
    docs = _docs(spark, d).select((F.col("id") % 50).alias("query_id"), "id", F.when(F.col("id") % 11 != 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("platforms"))
    wanted = F.when(F.col("query_id") % 3 == 0, "en").when(F.col("query_id") % 3 == 1, "es").otherwise("xx")
    return retrieve.platform_filter(docs, wanted).select("query_id", "id")


def minmax_support(spark, d):
    c = _vectors(spark, d, 20).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("technique")), "id")
    return retrieve.support(c).withColumn("relative", F.round("relative", 4))


def context_pack(spark, d):
    b = _docs(spark, d).select((F.col("id") % 20).alias("g"), "id", F.least(F.length("text"), F.lit(900)).alias("size"))
    return retrieve.pack(b, ["g"], "id", "size", 8500).select("g", "id", "size", "running", "place")


def history_trim(spark, d):
    """Newest turns of a conversation within the budget of tokens; the last always stays."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 1.9).cast("bigint").alias("tokens"), (-F.col("turn")).alias("back"))
    return retrieve.pack(c, ["conv_id"], "back", "tokens", 1500).select("conv_id", "turn", "tokens")


def token_budget(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.sum(F.ceil(F.length("text") / 1.9)).over(w).alias("used")).withColumn("state", F.when(F.col("used") > 4000, "over").when(F.col("used") > 3000, "near").otherwise("fine"))


def chunk_pack_greedy(spark, d):
    lines = _docs(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("trim(line) <> ''").withColumn("cost", text.estimated_tokens(F.col("line")))
    packed = retrieve.greedy_chunks(lines, "id", "n", "cost", 600, 10)
    return packed.groupBy("id", "bucket").agg(F.count("*").alias("lines"), F.sum("cost").alias("cost"), F.min("n").alias("first_line"))


def chunk_stats(spark, d):
    """Count and sizes of documents by language: least, middle, ninth tenth and most, by place and not interpolated."""
    return retrieve.chunk_stats(_docs(spark, d).withColumn("t", text.estimated_tokens(F.col("text"))), "lang", "t")


def content_fingerprint(spark, d):
    return retrieve.content_fingerprint(_docs(spark, d))


def embedding_mrr(spark, d):
    """Mean reciprocal rank and recall of the first neighbour with the query's label among twenty."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    top = _vectors(spark, d, 20).join(e, "id").join(e.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    first = top.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("r"))
    return first.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce((F.col("r") <= 5).cast("double"), F.lit(0.0))), 6).alias("recall5"))


_COS = "round(list_sum([CAST(q.embedding[i] AS DOUBLE) * e.embedding[i] FOR i IN range(1, 65)]) / (sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN q.embedding])) * sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN e.embedding]))), 6)"
_VEC = f"""s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20)"""
_FUSED = f"""{_VEC}, k AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(e.vec_id - q.vec_id), e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND e.label = q.label QUALIFY rank <= 20),
u AS (SELECT v.query_id, v.id, round(1.0::DOUBLE / (60 + v.rank) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 9) AS score FROM v LEFT JOIN k USING (query_id, id)),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM u)"""
_TOK = "regexp_extract_all(lower(text), '[a-z0-9_./:\\\\-]+')"
_EST = "CAST(greatest(1, round_even(round(len([w FOR w IN regexp_split_to_array({0}, '\\s+') IF w <> '']) * 1.3::DOUBLE, 6), 0)) AS INTEGER)"
QUERIES = {f.__name__: f for f in (bm25_topk, vector_topk, vector_lists, vector_recall, rrf_fusion, rrf_fusion_capped, platform_filter_fallback, minmax_support, context_pack, history_trim, token_budget, chunk_pack_greedy, chunk_stats, content_fingerprint, embedding_mrr)}
ORACLE_SQL = {
    "chunk_pack_greedy": f"""WITH RECURSIVE x AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
l AS (SELECT id, n, {_EST.format("line")} AS cost, row_number() OVER (PARTITION BY id ORDER BY n) AS o FROM x WHERE trim(line, ' ') <> ''),
s(id, o, n, cost, bucket, used) AS (SELECT id, o, n, cost, 0, 10 + cost FROM l WHERE o = 1 UNION ALL SELECT l.id, l.o, l.n, l.cost, CASE WHEN s.used + l.cost > 600 AND s.used > 10 THEN s.bucket + 1 ELSE s.bucket END, CASE WHEN s.used + l.cost > 600 AND s.used > 10 THEN 10 ELSE s.used END + l.cost FROM s JOIN l ON l.id = s.id AND l.o = s.o + 1)
SELECT id, CAST(bucket AS INTEGER) AS bucket, count(*) AS lines, CAST(sum(cost) AS BIGINT) AS cost, CAST(min(n) AS INTEGER) AS first_line FROM s GROUP BY id, bucket""",
    "bm25_topk": f"""WITH w AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), l AS (SELECT id, len(w) AS len FROM w), t AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY ALL),
d AS (SELECT term, ln((SELECT count(*) FROM l) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM t GROUP BY term), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM d) ELSE raw END AS idf FROM d),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM l)))), 6) AS score FROM q JOIN i USING (term) JOIN t USING (term) JOIN l USING (id) GROUP BY ALL)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "vector_topk": f"WITH {_VEC} SELECT * FROM v",
    "vector_recall": "SELECT 10 * count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, id, score, rank FROM f",
    "rrf_fusion_capped": f"WITH {_FUSED} SELECT query_id, id, label AS technique, rank FROM f JOIN embeddings ON id = vec_id QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) <= 2",
    "platform_filter_fallback": """WITH c AS (SELECT doc_id % 50 AS query_id, doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN lang = CASE (doc_id % 50) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'xx' END ELSE true END AS f FROM documents)
SELECT query_id, id FROM c QUALIFY f OR NOT bool_or(f) OVER (PARTITION BY query_id)""",
    "minmax_support": f"""WITH {_VEC}, b AS (SELECT query_id, label AS technique, max(score) AS absolute FROM v JOIN embeddings ON id = vec_id GROUP BY ALL)
SELECT *, round(CASE WHEN max(absolute) OVER w > min(absolute) OVER w THEN (absolute - min(absolute) OVER w) / (max(absolute) OVER w - min(absolute) OVER w) ELSE 1 END, 4) AS relative FROM b WINDOW w AS (PARTITION BY query_id)""",
    "context_pack": """WITH b AS (SELECT doc_id % 20 AS g, doc_id AS id, CAST(least(length(text), 900) AS INTEGER) AS size FROM documents), r AS (SELECT *, CAST(sum(size + 2) OVER w AS BIGINT) AS running, CAST(row_number() OVER w AS INTEGER) AS place FROM b WINDOW w AS (PARTITION BY g ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT * FROM r WHERE running <= 8500 OR place = 1""",
    "history_trim": """WITH c AS (SELECT conv_id, turn, CAST(ceil(length(text) / 1.9) AS BIGINT) AS tokens FROM conversations) SELECT conv_id, turn, tokens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) QUALIFY sum(tokens + 2) OVER w <= 1500 OR row_number() OVER w = 1""",
    "token_budget": """WITH c AS (SELECT conv_id, turn, CAST(sum(CAST(ceil(length(text) / 1.9) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) SELECT *, CASE WHEN used > 4000 THEN 'over' WHEN used > 3000 THEN 'near' ELSE 'fine' END AS state FROM c""",
    "chunk_stats": f"""WITH t AS (SELECT lang, {_EST.format("text")} AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM t)
SELECT lang, max(n) AS n, min(t) AS least, max(t) FILTER (i = floor(n * 0.5)) AS p50, max(t) FILTER (i = floor(n * 0.9)) AS p90, max(t) AS most FROM r GROUP BY lang""",
    "content_fingerprint": """WITH b AS (SELECT doc_id // 1000 AS b, count(*) AS n, sha256(string_agg(sha256(doc_id || chr(0) || coalesce(text, '')), '' ORDER BY doc_id)) AS d FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY b)) AS fingerprint FROM b""",
    "embedding_mrr": f"""WITH {_VEC}, f AS (SELECT v.query_id, min(rank) FILTER (a.label = b.label) AS r FROM v JOIN embeddings a ON v.id = a.vec_id JOIN embeddings b ON v.query_id = b.vec_id GROUP BY 1) SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr, round(avg(coalesce(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END, 0)), 6) AS recall5 FROM f""",
}
