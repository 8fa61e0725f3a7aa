"""Ranking of candidates: BM25, cosine, fusion of ranks, caps, platform filter, scaling, and packing into a budget."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.workspace import materialize, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60


def tokens(c: Column) -> Column:
    """Words as the keyword index takes them: ASCII letters, digits and _ . / : \\ - in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_./:\\-]+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, tf, len) of chunks(id, text); len is the chunk's number of words. This is what a keyword index keeps: save it with readers.write_index, its number of chunks in the stamp."""
    words = chunks.select("id", tokens(F.col("text")).alias("w"))
    return words.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf")).select("term", "id", "tf", "len")


def bm25(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best chunks that share a term with a query; a term that a query repeats counts again. Ties to the smaller id.

    Without a saved index: how many chunks hold a term is counted over all terms, as the mean idf needs them, but only the queries' terms are counted within chunks.
    """
    words = materialize(spread(chunks.select("id", "text")).select("id", tokens(F.col("text")).alias("w")), "words")
    n, total = words.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    df = materialize(words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    asked = queries.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    held = words.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).join(asked, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    return _bm25(queries, held, df, n, total, k)


def bm25_of(queries: DataFrame, index: DataFrame, n: int, k: int) -> DataFrame:
    """bm25 over postings of n chunks. Of the postings only the queries' terms go on, with what their chunks' scores need; a term in over half of the chunks gets EPSILON of the mean idf."""
    df = materialize(index.groupBy("term").agg(F.count("*").alias("df")), "df")
    total = index.agg(F.sum("tf")).first()[0] or 0
    wanted = queries.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    return _bm25(queries, index.join(wanted, "term", "left_semi"), df, n, total, k)


#: Chunks, words of chunks, and queries that meet in one group of a keyword search; queries that are scored at once there; cells of the table of chunks by terms that this takes.
CHUNKS, WORDS, ASKING, AT_ONCE, CELLS = 8_192, 2_000_000, 2_048, 256, 4_000_000


def _bm25(queries, held, df, n, total, k):
    """Ranks chunks by their postings held(id, term, tf, len). Chunks are dealt into blocks by their ids and queries into parts, and each block meets each part in a group of its own; only what may be among a query's k best leaves it, so pairs of queries and chunks are never rows."""
    df = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw")).first()[0] or 0.0
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw"))
    blocks, parts = max(1, -(-n // CHUNKS), -(-total // WORDS)), max(1, -(-queries.count() // ASKING))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = terms.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"), deal("query_id", parts).alias("part")).select("*", every(blocks).alias("block"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (total / n if n else 1.0)))
    known = held.where("id is not null").select("id", "term", share.alias("share"), deal("id", blocks).alias("block")).select("*", every(parts).alias("part"))
    kind, q_kind = held.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    scores = asked.groupBy("block", "part").cogroup(known.groupBy("block", "part")).applyInArrow(_bm25_of(k), f"query_id {q_kind}, id {kind}, score double")
    return ranked(scores.select("query_id", "id", F.round("score", 6).alias("score")), k)


def _bm25_of(k: int):
    """Of a group's queries(query_id, term, weight) and postings(id, term, share) the pairs that may be among a query's k best once rounded. Scores are a matrix product, some chunks and queries at a time."""

    def run(asking: pa.Table, known: pa.Table) -> pa.Table:
        known = known.take(pc.sort_indices(known, sort_keys=[("id", "ascending")]))
        numbered = pc.dictionary_encode(known.column("id").combine_chunks())
        ids, chunk, words, share = numbered.dictionary, numbered.indices.to_numpy(), known.column("term").combine_chunks(), known.column("share").to_numpy()
        asked = pc.dictionary_encode(asking.column("query_id").combine_chunks(), null_encoding="encode")
        names, who, weight = asked.dictionary, asked.indices.to_numpy(), asking.column("weight").to_numpy()
        kept = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for begin in range(0, len(names), AT_ONCE):
            mine = np.flatnonzero((who >= begin) & (who < begin + AT_ONCE))
            terms = pc.dictionary_encode(asking.column("term").combine_chunks().take(pa.array(mine)))
            place = pc.index_in(words, terms.dictionary)
            held = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
            at, of, value = pc.fill_null(place, 0).to_numpy()[held], chunk[held], share[held]
            asks = np.zeros((len(terms.dictionary), min(AT_ONCE, len(names) - begin)))
            weights = np.zeros_like(asks)
            column = (terms.indices.to_numpy(), who[mine] - begin)
            asks[column], weights[column] = 1, weight[mine]
            plain = bool((weight[mine] > 0).all())  # then a score of 0 is that of no common term
            scores, step = np.empty((len(ids), asks.shape[1])), max(1, CELLS // max(1, len(asks)))
            for low in range(0, len(ids), step):
                cells = np.zeros((min(step, len(ids) - low), len(asks)))
                some = slice(*np.searchsorted(of, [low, low + step]))
                np.add.at(cells, (of[some] - low, at[some]), value[some])
                dots = cells @ weights
                scores[low : low + step] = np.where(dots > 0 if plain else cells @ asks > 0, dots, -np.inf)
            for j in range(asks.shape[1]):
                s = np.ascontiguousarray(scores[:, j])
                found = _best(s, k)
                kept.append((np.full(len(found), begin + j), found, s[found]))
        asked_by, found, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
        return pa.table({"query_id": names.take(pa.array(asked_by)), "id": ids.take(pa.array(found)), "score": pa.array(scores)})

    return run


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Where the scores stand that may be among the k best once rounded: beyond the k-th only what comes within a rounding of it, and of equal scores the first k. -inf is no score."""
    least = np.partition(s, len(s) - k)[len(s) - k] - 1e-6 if len(s) > k else -np.inf
    at = np.flatnonzero((s >= least) & (s > -np.inf))
    if len(at) > 2 * k:
        at = at[np.argsort(-s[at], kind="stable")]
        begins = np.flatnonzero(np.r_[True, s[at][1:] != s[at][:-1]])
        at = at[np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)])) < k]
    return at


def ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Vectors, and queries, that meet in one group of nearest.
BLOCK, TOGETHER = 8_192, 2_048


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors(id, v) with another id by cosine, for queries(query_id, v); a vector of length 0 has a null score.

    Vectors are dealt into blocks and queries into parts, and each block meets each part in a group of its own, so the join is by equality and a group's size is bounded. Vectors are brought
    to length one before they meet. A group is one matrix product, of which only what may be among a query's k best leaves the task.
    """
    vectors, queries = vectors.where("id is not null"), queries.where("query_id is not null")
    blocks, parts = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // together))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = lambda c: F.when(size(F.col(c)) > 0, F.transform(F.arrays_zip(F.col(c).alias("x"), F.array_repeat(size(F.col(c)), F.size(c)).alias("n")), lambda z: z["x"].cast("double") / z["n"]))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind, q_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    near = vectors.select("id", unit("v").alias("v"), deal("id", blocks).alias("block")).select("*", every(parts).alias("part"))
    far = queries.select("query_id", F.col("query_id").cast(kind).alias("own"), unit("v").alias("q"), deal("query_id", parts).alias("part")).select("*", every(blocks).alias("block"))
    pairs = far.groupBy("block", "part").cogroup(near.groupBy("block", "part")).applyInArrow(_nearest_of(k), f"query_id {q_kind}, id {kind}, score double")
    return ranked(pairs.select("query_id", "id", F.round("score", 6).alias("score")), k)


def _nearest_of(k: int):
    """Of a group's queries and vectors the pairs that may be among the k best of a query once scores are rounded: beyond the k-th only what comes within a rounding of it, and of equal scores the k smallest ids."""

    def matrix(column, at):
        return pc.take(column, pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)

    def run(asking: pa.Table, known: pa.Table) -> pa.Table:
        known = known.take(pc.sort_indices(known, sort_keys=[("id", "ascending")]))
        ids, own = known.column("id").combine_chunks(), asking.column("own").combine_chunks()
        of_v, of_q = (pc.fill_null(pc.list_value_length(t.column(c)), 0).to_numpy() for t, c in ((known, "v"), (asking, "q")))
        kept = [(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, bool))]
        for length in np.unique(of_q):
            same = (of_v == length) & (length > 0)
            these, others = np.flatnonzero(same), np.flatnonzero(~same)  # others have no direction or another size, and no score
            m = matrix(known.column("v"), these) if len(these) else None
            asks = np.flatnonzero(of_q == length)
            for some in np.array_split(asks, -(-len(asks) // 64)):
                dots = matrix(asking.column("q"), some) @ m.T if len(these) else None
                for n, j in enumerate(some):
                    mine = pc.fill_null(pc.equal(ids, own[int(j)]), False).to_numpy(zero_copy_only=False)
                    at = others[~mine[others]][:k]
                    kept.append((np.full(len(at), j), at, np.zeros(len(at)), np.ones(len(at), bool)))
                    if len(these):
                        s = np.where(np.isnan(dots[n]), np.inf, dots[n])  # NaN ranks above all numbers
                        s[mine[these]] = -np.inf
                        at = _best(s, k)
                        kept.append((np.full(len(at), j), these[at], dots[n][at], np.zeros(len(at), bool)))
        asked, found, scores, none = (np.concatenate(x) for x in zip(*kept, strict=True))
        return pa.table({"query_id": asking.column("query_id").combine_chunks().take(pa.array(asked)), "id": ids.take(pa.array(found)), "score": pa.array(scores, mask=none)})

    return run


def closest(queries: DataFrame, entries: DataFrame, key: str, k: int, block: int = 8 * BLOCK, together: int = TOGETHER) -> DataFrame:
    """(query_id, id, score, rank): the k entries(id, key) of a query's key whose whole-number ids lie nearest to the query's own, another id than it; score is the distance, negative.

    Entries are dealt into blocks and queries into parts, as nearest does. Of a block's ids in order only k before and k behind a query can be among its k, so no query meets all entries of its key.
    """
    queries, entries = queries.where(F.col("query_id").isNotNull() & F.col(key).isNotNull()), entries.where(F.col("id").isNotNull() & F.col(key).isNotNull())
    blocks, parts = max(1, -(-entries.count() // block)), max(1, -(-queries.count() // together))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = entries.select(F.col("id").cast("bigint").alias("id"), key, deal("id", blocks).alias("block")).select("*", every(parts).alias("part"))
    asking = queries.select(F.col("query_id").cast("bigint").alias("query_id"), key, deal("query_id", parts).alias("part")).select("*", every(blocks).alias("block"))

    def run(asking: pa.Table, known: pa.Table) -> pa.Table:
        q, ids = asking.column("query_id").to_numpy(), np.sort(known.column("id").to_numpy())
        at = np.concatenate([np.searchsorted(ids, q)[:, None] - 1 - np.arange(k), np.searchsorted(ids, q, "right")[:, None] + np.arange(k)], 1)
        inside = (at >= 0) & (at < len(ids))
        return pa.table({"query_id": pa.array(np.repeat(q, inside.sum(1)), pa.int64()), "id": pa.array(ids[at[inside]], pa.int64())})

    near = asking.groupBy(key, "block", "part").cogroup(known.groupBy(key, "block", "part")).applyInArrow(run, "query_id bigint, id bigint")
    return ranked(near.select("query_id", "id", (-F.abs(F.col("id") - F.col("query_id"))).alias("score")), k)


def living(chunks: DataFrame) -> DataFrame:
    """chunks without those of revoked and deprecated entries, before anything is ranked; a filter that reaches the scan."""
    return chunks.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))


#: Characters of a token: the cautious ratio, and the largest that a measured one may take.
CHARS, MOST_CHARS = 1.9, 3.0


def chat_tokens(text: Column, ratio: Column | None = None) -> Column:
    """Tokens that a text may take, rather too many; ratio is a measured number of characters a token."""
    r = F.lit(CHARS) if ratio is None else F.least(F.greatest(F.coalesce(ratio, F.lit(CHARS)), F.lit(CHARS)), F.lit(MOST_CHARS))
    return (F.floor(F.length(F.coalesce(text, F.lit(""))) / r) + 1).cast("bigint")


def budget_status(turns: DataFrame, by: list[str], budget: int) -> DataFrame:
    """(by, total, fits, overflow): whether the tokens of all turns(by, text) fit a budget."""
    total = F.coalesce(F.sum(chat_tokens(F.col("text"))), F.lit(0))
    return turns.groupBy(*by).agg(total.alias("total")).withColumn("fits", F.col("total") <= budget).withColumn("overflow", F.greatest(F.col("total") - budget, F.lit(0)))


def trimmed_history(turns: DataFrame, by: list[str], order: str, budget: int) -> DataFrame:
    """turns(by, order, text) that a budget of tokens holds, from the newest back; the last always stays, and nothing before the first that doesn't fit."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    running = F.sum(chat_tokens(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("tokens", chat_tokens(F.col("text"))).withColumn("_sum", running).withColumn("_n", F.row_number().over(w)).where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def fuse(lists: list[DataFrame]) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal ranks of lists (query_id, id, rank); the first list decides who takes part. Ties to the smaller id."""
    parts = [x.select("query_id", "id", (1.0 / (RRF + F.col("rank"))).alias("s"), F.lit(int(i == 0)).alias("f")) for i, x in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"), F.max("f").alias("f")).where("f = 1").drop("f")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return fused.withColumn("rank", rank)


def cap_per_technique(candidates: DataFrame, limit: int = 2) -> DataFrame:
    """At most limit candidates of a technique and query, the best ranked; what goes is not filled up."""
    n = F.row_number().over(Window.partitionBy("query_id", "technique").orderBy("rank"))
    return candidates.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def platform_filter(candidates: DataFrame, platform: Column) -> DataFrame:
    """Candidates without platforms or with the query's; if a query would keep none, all of its candidates."""
    fits = F.coalesce(F.size("platforms") == 0, F.lit(True)) | F.coalesce(F.array_contains("platforms", platform), F.lit(True))
    some = F.max(fits.cast("int")).over(Window.partitionBy("query_id"))
    return candidates.withColumn("_f", fits).withColumn("_s", some).where(F.col("_f") | (F.col("_s") == 0)).drop("_f", "_s")


def support(candidates: DataFrame) -> DataFrame:
    """(query_id, technique, absolute, relative): best score of each technique, scaled within the query; 1 if all are equal."""
    best = candidates.groupBy("query_id", "technique").agg(F.max("score").alias("absolute"))
    w = Window.partitionBy("query_id")
    low, high = F.min("absolute").over(w), F.max("absolute").over(w)
    return best.withColumn("relative", F.when(high > low, (F.col("absolute") - low) / (high - low)).otherwise(F.lit(1.0)))


def pack(blocks: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """The first blocks of each group whose sizes, with two for each separator, stay within the budget; the first always stays, and nothing after the first that doesn't fit."""
    w = Window.partitionBy(*by).orderBy(order)
    total = F.sum(F.col(size) + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("running", total).withColumn("place", F.row_number().over(w)).where((F.col("running") <= budget) | (F.col("place") == 1))


def greedy_chunks(items: DataFrame, by: str, order: str, cost: str, limit: int, header: int | str) -> DataFrame:
    """items(by, order, cost) with bucket: filled in order until the next item would pass the limit, each starting with the header's cost, which is a number or a column.

    Groups are dealt over tasks and sorted there; a task goes once through its rows and remembers a bucket and a sum, so neither a group's size nor its cells matter. A null cost is 0.
    """
    start = F.lit(header) if isinstance(header, int) else F.col(header)
    kinds = {c: items.schema[c].dataType.simpleString() for c in (by, order)}
    dealt = items.select(by, order, F.coalesce(F.col(cost), F.lit(0)).cast("bigint").alias("_c"), F.coalesce(start, F.lit(0)).cast("bigint").alias("_h")).repartition(by).sortWithinPartitions(by, order)

    def run(batches):
        import pyarrow as pa

        group, used, bucket = object(), 0, 0
        for batch in batches:
            out = []
            for key, c, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != group:
                    group, used, bucket = key, h, 0
                elif used + c > limit and used > h:
                    bucket, used = bucket + 1, h
                used += c
                out.append(bucket)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int32())], [by, order, cost, "bucket"])

    return dealt.mapInArrow(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, `{cost}` bigint, bucket int")


def context_blocks(chunks: DataFrame, budget: int | None = 8_500, clip: int = 900, first: int | None = 8) -> DataFrame:
    """(query_id, place, attack_id, block): what a model is shown of chunks(query_id, rank, attack_id, content_type, text, name, object_type, url, revoked, deprecated).

    The first chunks of a query by rank count, all for None. A text longer than clip is cut there, without blanks at its end, and marked. Chunks of one entry stand together where its best one stands, under a line that names it,
    and above its address. Blocks follow until one would pass budget characters with the two between blocks; the first always stays, and nothing after the first that doesn't fit.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    some = chunks.withColumn("_n", F.row_number().over(by_rank)).where(F.col("_n") <= first) if first else chunks.withColumn("_n", F.row_number().over(by_rank))
    text = F.when(F.length("text") > clip, F.concat(F.rtrim(F.substring("text", 1, clip), F.lit(" \t\n\r\f\x0b")), F.lit(" [...]"))).otherwise(F.col("text"))
    told = some.withColumn("_line", F.struct("_n", F.concat(F.lit("("), "content_type", F.lit(") "), text).alias("t"), "name", "object_type", "url", F.coalesce("revoked", F.lit(False)).alias("revoked"), F.coalesce("deprecated", F.lit(False)).alias("deprecated")))
    entry = told.groupBy("query_id", "attack_id").agg(F.array_sort(F.collect_list("_line")).alias("l")).withColumn("h", F.get("l", F.lit(0)))
    placed = entry.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("h._n")))
    title = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("attack_id"), F.lit(" | "), F.coalesce("h.name", F.lit("-")), F.lit(" | "), F.coalesce("h.object_type", F.lit("-")), F.when(F.col("h.revoked"), " | revoked").otherwise(""), F.when(F.col("h.deprecated"), " | deprecated").otherwise(""))
    block = F.concat_ws("\n", title, F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.concat(F.lit("Source: "), F.coalesce("h.url", F.lit("-"))))
    blocks = placed.select("query_id", "place", "attack_id", block.alias("block"))
    if budget is None:
        return blocks
    upto = F.sum(F.length("block") + 2).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - 2
    return blocks.withColumn("_upto", upto).where((F.col("_upto") <= budget) | (F.col("place") == 1)).drop("_upto")


def chunk_stats(chunks: DataFrame, by: str, size: str) -> DataFrame:
    """(by, n, least, p50, p90, most) of a column of whole numbers: by place in order, floor(n / 2) and floor(0.9 n), and not interpolated. Equal sizes are counted first, so no task orders more than the distinct sizes of a group."""
    counted = chunks.where(F.col(size).isNotNull()).groupBy(by, F.col(size).alias("t")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    r = counted.withColumn("upto", F.sum("c").over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda e: F.min(F.when(F.col("upto") > F.floor(F.col("n") * e), F.col("t")))
    return r.groupBy(by).agg(F.max("n").alias("n"), F.min("t").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("t").alias("most"))


#: Digests that one digest of the next level covers.
FAN = 1_000


def content_fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: n, the number of chunks(id, text), and fingerprint, the root of a tree of sha256 digests. A changed, added or removed chunk changes it; the order of rows and files doesn't.

    Each chunk's digest is made where it lies. Whole-number ids go to groups of FAN neighbours, texts to groups by their hash, and groups to groups of groups until one is left, so no task holds
    more than some thousand digests.
    """
    line = F.sha2(F.concat_ws("\u0000", F.col("id").cast("string"), F.coalesce("text", F.lit(""))), 256)
    numbers = chunks.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    place = F.floor(F.col("id") / FAN) if numbers else F.pmod(F.xxhash64("id"), F.lit(FAN ** max(1, math.ceil(math.log(max(2, chunks.count() / FAN), FAN)))))
    level = chunks.select(place.alias("b"), F.col("id").alias("o"), F.lit(1).cast("bigint").alias("n"), line.alias("d"))
    while True:
        level = level.groupBy("b").agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"])), 256).alias("d"))
        few = materialize(level, "digests")
        if few.count() <= FAN:
            break
        level = few.select(F.floor(F.col("b") / FAN).alias("b"), F.col("b").alias("o"), "n", "d")
    return few.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("fingerprint"))
