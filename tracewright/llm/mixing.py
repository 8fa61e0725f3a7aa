"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled by a hash. A copy of a document gets a virtual finish time: its source's
words up to and including it, whole earlier passes over the source counted too, divided by the source's target. All
copies of all sources are then ordered by that time and the order is cut at the total budget.

Running sums are never one task's work: rows are dealt into buckets of about BUCKET rows by their hash, bucket sums
(few) are accumulated, and only the sum within a bucket runs over rows. The cut is found the same way over ranges of virtual time.
It is one row, so whether a copy is taken needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.workspace import materialize

#: Rows a bucket is meant to have.
BUCKET = 20_000
#: Buckets at least, so that a source of very many rows is many of them.
BUCKETS = 256
#: A source is passed over so often at most.
PASSES = 3
WEIGHTS = (1, 2, 3)
WORDS = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the total shared by weight, no target above PASSES times its source's size.

    Weights go by the order of the sources' code points, null last: 1, 2, 3, 1, ... What a limited source leaves is
    reshared among the rest. With limits sorted by limit / weight, the share of one unit of weight is the largest of
    (total - limits before) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)).withColumn("cap", PASSES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    remaining = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        weighed.withColumn("share", (F.sum("source_size").over(whole) - capped) / remaining)
        .withColumn("share", F.max("share").over(whole))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight")).alias("target"))
    )


def _hash(c):
    """60 bits of a digest, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def text_key():
    return _hash(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n")))


def shuffle_key():
    """A document's place in the shuffle of its source, from doc_id, source and text_key."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    return _hash(F.concat_ws("|", part("doc_id"), part("source"), F.col("text_key").cast("string")))


def schedule(docs: DataFrame) -> tuple[DataFrame, tuple | None]:
    """(doc_id, text_key, source, size, source_size, target, h, finish) a row of docs, and the last copy taken as (time, h, doc_id) or None if all are.

    finish is the document's place in its source's first pass, in words.
    """
    sized = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.expr(WORDS).cast("bigint").alias("size"), text_key().alias("text_key")).withColumn("h", shuffle_key()),
        "sized",
    )
    rows = sized.agg(F.count("*")).first()[0]
    buckets = max(BUCKETS, rows // BUCKET)
    k = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("k")
    dealt = sized.select("*", k, F.pmod("h", F.lit(buckets)).alias("bucket"))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).select(k, "source_size", "target")
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("k", "bucket").agg(F.sum("size").alias("own")).withColumn("offset", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own").join(aims, "k")
    within = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = materialize(
        dealt.join(offsets, ["k", "bucket"]).withColumn("finish", F.col("offset") + F.sum("size").over(within)).drop("offset", "bucket", "k"),
        "timed",
    )
    total = timed.agg(F.sum("size")).first()[0] or 0
    copies = timed.select("h", "doc_id", "size", F.explode(times()).alias("time"))
    span = F.least(F.floor(F.col("time") * buckets), F.lit(2 * buckets)).alias("span")
    sums = copies.groupBy(span).agg(F.sum("size").alias("own")).withColumn("upto", F.sum("own").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)))
    over = sums.where(F.col("upto") > total).orderBy("span").first()
    if over is None:
        return timed, None
    left = total - (over["upto"] - over["own"])
    order = Window.orderBy("time", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = copies.where(span == over["span"]).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") > left).orderBy("time", "h", "doc_id").first()
    return timed, (last["time"], last["h"], last["doc_id"])


def times():
    """The virtual finish times of a row's copies, one for each pass that its source's target needs."""
    passes = F.greatest(F.lit(1), F.least(F.lit(PASSES), F.ceil(F.col("target") / F.col("source_size")).cast("int")))
    each = F.transform(F.sequence(F.lit(0), F.coalesce(passes, F.lit(1)) - 1), lambda e: (e * F.col("source_size") + F.col("finish")) / F.col("target"))
    return F.when(F.col("target") > 0, each).otherwise(F.array(F.lit(0.0)))


def taken_times(cut: tuple | None):
    """The times of the copies before the cut: the first copy that the budget can't hold, and all after it, go."""
    if cut is None:
        return times()
    time, h, doc_id = cut
    tie = (F.col("h") < h) if doc_id is None else (F.col("h") < h) | ((F.col("h") == h) & F.coalesce(F.col("doc_id") < doc_id, F.lit(True)))
    return F.filter(times(), lambda t: (t < time) | ((t == time) & tie))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    size counts words (null and empty texts: 0, and nothing of them is taken), taken the words of all copies taken. A null source is a source of its own.
    Equal rows are taken one by one; the result depends on the rows alone, not on their order. Other columns play no part.
    """
    timed, cut = schedule(docs)
    return timed.select("doc_id", "size", "source_size", "target", (F.size(taken_times(cut)) * F.col("size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken (0 to PASSES times), in the order of virtual time.

    A document without words costs no budget and is taken if its time is before the cut. Of rows equal in doc_id, text and
    source, all copies taken come back as copies of the first of them in the order of all columns as JSON, so reruns agree.
    """
    timed, cut = schedule(docs)
    taken = timed.select("h", "text_key", taken_times(cut).alias("_times")).groupBy(F.col("h").alias("_h"), F.col("text_key").alias("_text")).agg(F.flatten(F.collect_list("_times")).alias("_times"), F.count("*").alias("_rows")).where("size(_times) > 0")
    keys = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", text_key().alias("text_key")).select("_row", shuffle_key().alias("_h"), F.col("text_key").alias("_text"))
    joined = keys.join(taken.where("_rows = 1"), ["_h", "_text"]).select("_row", "_times")
    again = taken.where("_rows > 1")
    if not again.isEmpty():
        one = keys.join(again, ["_h", "_text"]).groupBy("_h", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row"), F.first("_times").alias("_times"))
        joined = joined.unionByName(one.select("_row", "_times"))
    return joined.withColumn("_time", F.explode("_times")).repartitionByRange("_time").sortWithinPartitions("_time").select("_row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed, a row each."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, CAST('0x' || substr(md5(coalesce('t' || text, 'n')), 1, 15) AS BIGINT) AS text_key FROM documents),
k AS (SELECT *, CAST('0x' || substr(md5(coalesce('v' || doc_id, 'n') || '|' || coalesce('v' || source, 'n') || '|' || text_key), 1, 15) AS BIGINT) AS h, greatest({BUCKETS}, count(*) OVER () // {BUCKET}) AS buckets FROM d),
f AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h % buckets, h, doc_id, text_key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS finish FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, {PASSES} * source_size AS cap, row_number() OVER (ORDER BY {PASSES} * source_size / weight, source NULLS LAST) AS place FROM s),
u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(share) OVER () * weight) AS target FROM u),
j AS (SELECT f.*, source_size, target FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source),
m AS (SELECT doc_id, h, size, target, e, CASE WHEN target > 0 THEN (e * source_size + finish) / target ELSE 0 END AS time FROM j, range(0, {PASSES}) r(e) WHERE e < greatest(1, CASE WHEN target > 0 THEN ceil(target / source_size) ELSE 1 END)),
o AS (SELECT *, sum(size) OVER (ORDER BY time, h, doc_id ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM d) AS fits FROM m),
n AS (SELECT h, doc_id, count(*) FILTER (fits) AS copies FROM o GROUP BY ALL)
SELECT j.doc_id, CAST(j.size AS BIGINT) AS size, source_size, target, CAST(copies * j.size AS BIGINT) AS taken FROM j JOIN n ON j.h = n.h AND j.doc_id IS NOT DISTINCT FROM n.doc_id
"""
