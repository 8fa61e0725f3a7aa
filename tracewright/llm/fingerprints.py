"""Threshold-scaled sketches of documents, with DataFrame operations only.

A sketch keeps every hash of a text's shingles below a fixed fraction of the hash range, and nothing else. So the sketch of a union is the union
of the sketches, cut by nobody's size, and shared shares of hashes estimate likeness and containment even between a page and a book.
Shingles are of several lengths, which gives a short text some hashes where five-word ones alone would leave it none or one. A text
whose shingles all lie above the fraction has an empty sketch, from which nothing can be said.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.llm.expressions import let

#: Words of a shingle.
LENGTHS = (2, 3, 5)
#: One in so many shingle hashes is kept; and the scale that keeps all, to compare with.
SCALE, WHOLE = 4, 1
#: Bits of a hash that are printed, below those that the fraction leaves open.
PRINTED = 48
#: Documents that a block is meant to have, quantiles of doc_id that the blocks start from, and text bytes that a task is meant to have.
BLOCK, QUANTILES, TASK = 2_000, 256, 1 << 23
#: Blocks at most, however many documents: their first keys are broadcast, 3 MB then.
BLOCKS = 100_000


def under(s: Column, scale: int) -> Column:
    """The hashes in the fraction of the range."""
    return s if scale == WHOLE else F.filter(s, lambda x: x < F.lit(-(1 << 63) + (1 << 64) // scale))


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The sorted sketch of a text as array<bigint>: shingles of each of LENGTHS words, which are lower-cased runs of other than ASCII white space; a text of one word is one shingle. Null and empty texts have none."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def of(h: Column) -> Column:
        def shingles(n: int) -> Column:
            made = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
            return F.when(F.size(h) >= n, under(made, scale)).otherwise(none)

        return F.when(F.size(h) == 1, under(F.transform(h, lambda x: F.xxhash64(x)), scale)).otherwise(F.concat(*[shingles(n) for n in LENGTHS]))

    return F.coalesce(F.sort_array(F.array_distinct(let(hashes, of))), none)


def merged(sketches: Column) -> Column:
    """The sketch of the union of documents from an array of their sketches of one scale."""
    return F.sort_array(F.array_distinct(F.flatten(sketches)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness; of two empty sketches 1, of one empty 0."""
    return let(F.size(F.array_intersect(a, b)), lambda both: let(F.size(a) + F.size(b) - both, lambda all_: F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; of an empty sketch null, as nothing is known, or 1 if sketches are of the whole range and so a has no shingle."""
    return let(F.size(a), lambda n: F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(1.0 if scale == WHOLE else None).cast("double")))


def printed(s: Column) -> Column:
    """A sketch of SCALE as text: of each hash, in order, the PRINTED bits behind those that the fraction fixes, in base 64: eight letters a hash."""
    open_bits = 64 - (SCALE - 1).bit_length()
    digits = PRINTED // 4
    part = lambda x: F.lpad(F.hex(F.shiftrightunsigned(x - F.lit(-(1 << 63)), open_bits - PRINTED)), digits, "0")
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(s, part), ""))), "\r\n", "")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(key, text, ...) with next, the struct of text and sketch of the row after it in the order of key, the text's hash and the text; after the last comes the first.

    Rows are dealt into ranges of that order. Ranges of key start from quantiles; a key that several quantiles fall on is a range
    of its own, divided by the texts' hashes, and any other range is divided by key, so that a key of very many rows is many blocks too. The first row of
    each block is also dealt to the block before it. So texts cross the network once, and no task orders more than a block.
    """
    docs = docs.withColumn("_h", F.xxhash64("text"))
    rows, size, low, high, marks = docs.agg(F.count("*"), F.sum(F.octet_length("text")), F.min("key"), F.max("key"), F.percentile_approx("key", [i / QUANTILES for i in range(1, QUANTILES)], F.lit(10_000))).first()
    rows, low, high, marks = (rows, low, high, marks or []) if rows else (0, 0, 0, [])
    hot = {m for m, n in Counter(marks).items() if n > 1}
    starts = sorted({low, *marks, *(m + 1 for m in hot if m < high)})
    share = Counter(starts[bisect_right(starts, m) - 1] for m in marks)
    per = -(-min(rows, BLOCK * BLOCKS) // (BLOCK * QUANTILES))  # blocks that a quantile's rows make
    parts = [per * max(1, share[s]) for s in starts]
    ends = [*starts[1:], min(high + 1, (1 << 63) - 1)]
    array = lambda xs: F.expr(f"array({','.join(f'{x}L' if x > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for x in xs)})")
    coarse = F.size(F.filter(array(starts), lambda m: m <= F.col("key"))) - 1
    start, end = F.get(array(starts), F.col("_c")).cast("double"), F.get(array(ends), F.col("_c")).cast("double")
    by_key = (F.col("key").cast("double") - start) / F.greatest(F.lit(1.0), end - start)
    by_text = F.col("_h").cast("double") / 2.0**64 + 0.5
    place = F.when(F.get(array([int(s in hot) for s in starts]), F.col("_c")) == 1, by_text).otherwise(by_key) * F.get(array(parts), F.col("_c"))
    before = F.get(array([0, *itertools.accumulate(parts)]), F.col("_c"))
    block = (before + F.least(F.floor(place), F.get(array(parts), F.col("_c")) - 1)).cast("int").alias("block")
    dealt = docs.withColumn("_c", coarse).select("*", block).drop("_c")
    firsts = dealt.groupBy("block").agg(F.min(F.struct("key", "_h")).alias("first"))
    order = Window.orderBy("block")
    to = F.coalesce(F.lag("block").over(order), F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ghosts = firsts.select(F.col("first.key"), F.col("first._h"), to.alias("to"), F.lag("block").over(order).isNull().alias("wraps"))
    ghost_rows = docs.join(F.broadcast(ghosts), ["key", "_h"]).groupBy("to", "wraps", "key", "_h").agg(F.min("text").alias("text"))
    ghost_rows = ghost_rows.select(F.col("to").alias("block"), F.when(F.col("wraps"), 2).otherwise(1).alias("ghost"), "key", "_h", "text")
    # sketches are made after the rows are dealt, so that texts alone cross the network
    met = dealt.withColumn("ghost", F.lit(0)).unionByName(ghost_rows, allowMissingColumns=True).repartition(max(1, -(-(size or 0) // TASK)), "block").withColumn("sketch", sketch(F.col("text")))
    following = F.lead(F.struct("text", "sketch")).over(Window.partitionBy("block").orderBy("ghost", "key", "_h", "text"))
    return met.withColumn("next", following).where("ghost = 0").drop("ghost", "block", "_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_in_next for every row of docs.

    The edited text ends in the first floor(n_chars / 4) code points of the next document (all of it, if it has fewer) in place
    of its own last as many. Next is the row after it by doc_id, then the text's hash, null doc_ids first; after the last comes the first. Null texts
    count as empty. Fingerprints are printed sketches, empty for texts without words or without a shingle in the fraction; equal texts have equal ones, and equal ones a likeness of 1. Other columns play no part.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = with_next(docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("_null")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.substring(F.col("next.text"), F.lit(1), quarter)))
    sketched = edited.select(
        F.when(~F.col("_null"), F.col("key")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", F.col("next.sketch").alias("next_sketch"), sketch(F.col("edited")).alias("edited_sketch")
    )
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"),
    )


def op7_scaled_sketches(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
