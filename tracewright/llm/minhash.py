"""Near duplicates: min-max hashing for candidates, links confirmed on full shingle sets.

Every permutation gives two signature values, the minimum and the maximum, so a band of r values
costs half the hash evaluations. Bands are many enough that a pair at the threshold shares none
with a probability under one in a million. Then:

1. Texts with equal shingle sets form a class (a grouped minimum, so a class of any size combines before the shuffle).
2. One representative a class goes on, named by (doc_id, text hash). Those that share a band are tied to the smallest
   of that band; the components of these ties are clusters, outside which no link can lie.
3. A cluster of up to BLOCK shingles meets in one group. A larger one is dealt into blocks of that size, each with the same few
   members, through which the parts of a large group find each other.
4. Inside a group, a breadth-first walk compares each newly linked set with those not yet reached.
   It emits a spanning forest of the confirmed links, not all pairs.
5. In a larger cluster, members of different components may still be linked. They are compared along the bands that they
   share: in each such band, the members outside its largest component meet all others, block by block. What one component
   holds is not compared again, so a group of near copies costs its size and not its square.
6. Components of all links give every text its class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.memory import trim, trimmed
from tracewright.llm.words import U, mix, shingles, slices, text_arrays, Words
from tracewright.operators.graph import connected_components, frequent, spread_join
from tracewright.workspace import materialize

#: Shingles in a block of a cluster: about 8 MB of hashes.
BLOCK = 1_000_000
#: Members of a large cluster that every block of it holds.
SEEDS = 16
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows a band) for a threshold in percent; bands are even, half of minima and half of maxima."""
    rows = 5 if percent >= 85 else 4
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
    return bands + bands % 2, rows


def _signature(h: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of the documents whose (not empty) sets lie at at[i]:at[i+1]."""
    keys = np.zeros((len(at) - 1, bands), U)
    half = bands // 2
    for k in range(half * rows):
        seed = mix(np.array([2 * k + 1, 2 * k + 2], U) * U(0x9E3779B97F4A7C15))
        v = (h ^ seed[0]) * (seed[1] | U(1))
        for band, kept in ((k // rows, np.minimum), (half + k // rows, np.maximum)):
            keys[:, band] = mix(keys[:, band] * U(0xD1342543DE82EF95) + kept.reduceat(v, at[:-1]) + U(band + 1))
    return keys


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, the hash that tells the texts of a repeated doc_id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, set_a, set_b, bands): text_key names the text, set_a and set_b its shingle set, bands the set's keys (empty without shingles)."""
    bands, rows = banding(percent)

    def run(batches):
        for batch in batches:
            for a, b, w in slices(batch.column(1)):
                h, at = shingles(w, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                starts = np.r_[at[:-1][some], len(h)]
                set_a, set_b = np.zeros(len(n), U), np.zeros(len(n), U)
                keys = np.zeros((0, bands), U)
                if len(some):
                    set_a[some] = np.add.reduceat(mix(h + U(1)), starts[:-1])
                    set_b[some] = np.bitwise_xor.reduceat(mix(h + U(2)), starts[:-1])
                    keys = _signature(h, starts, bands, rows)
                ends = np.r_[0, np.cumsum((n > 0) * bands)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))],
                    ["doc_id", "text_key", "n", "set_a", "set_b", "bands"],
                )

    return keyed(docs).mapInArrow(trimmed(run), "doc_id bigint, text_key bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def walk(ids: list, h: np.ndarray, at: np.ndarray, percent: int) -> list[tuple]:
    """A spanning forest of the links among some sets: breadth first, each set reached compared with all not yet reached.

    Only sets whose size allows the threshold are compared, and what is left is packed again whenever half is reached.
    """
    _, local = np.unique(h, return_inverse=True)
    flag = np.zeros(len(h) + 1, np.int32)
    n = np.diff(at)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    links, queue, left = [], [], order
    alive = np.ones(len(n), bool)

    def pack(members):
        size = n[members]
        where = np.r_[0, np.cumsum(size)]
        return size, where, local[np.repeat(at[members] - where[:-1], size) + np.arange(where[-1])]

    size, where, packed = pack(left)
    gone, seed = 0, 0
    while True:
        if queue:
            x = queue.pop()
        else:
            while seed < len(order) and not alive[order[seed]]:
                seed += 1
            if seed == len(order):
                return links
            x = order[seed]
            alive[x] = False
            gone += 1
        if 2 * gone > len(left):
            left = left[alive[left]]
            size, where, packed = pack(left)
            gone = 0
        lo, hi = np.searchsorted(size, [-(-n[x] * percent // 100), n[x] * 100 // percent + 1])
        if lo >= hi:
            continue
        mine = local[at[x] : at[x + 1]]
        flag[mine] = 1
        both = np.add.reduceat(flag[packed[where[lo] : where[hi]]], where[lo:hi] - where[lo])
        flag[mine] = 0
        hit = left[lo:hi][(both * (100 + percent) >= percent * (n[x] + size[lo:hi])) & alive[left[lo:hi]]]
        alive[hit] = False
        gone += len(hit)
        queue += hit.tolist()
        links += [(ids[x], ids[y]) for y in hit.tolist()]


NODE = "struct<doc_id:bigint,text_key:bigint>"


def _confirmed(placed: DataFrame, by: list[str], docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(src, dst) of a spanning forest of the links in each group of placed(doc_id, text_key, *by)."""
    # members grow with the documents: never broadcast; equal rows combine before the shuffle
    texts = keyed(docs).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    here = placed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*by)).alias("_at"))
    met = texts.join(here.hint("merge"), ["doc_id", "text_key"]).withColumn("_at", F.explode("_at")).select("_at.*", "doc_id", "text_key", "text")

    def confirm(t):
        data, offsets = text_arrays(t.column("text").combine_chunks())
        h, at = shingles(Words(data, offsets), size)
        ids = list(zip(t.column("doc_id").to_pylist(), t.column("text_key").to_pylist(), strict=True))
        links = walk(ids, h, at, percent)
        if t.num_rows > 100:
            trim()
        node = lambda i: pa.StructArray.from_arrays([pa.array([x[i][c] for x in links], pa.int64()) for c in (0, 1)], ["doc_id", "text_key"])
        return pa.table({"src": node(0), "dst": node(1)})

    return met.groupBy(*by).applyInArrow(confirm, f"src {NODE}, dst {NODE}")


def _across(large: DataFrame, links: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of different components, along the bands that they share; large: (component, rep, nid, n, bands) of the large clusters' members, links: what is confirmed so far."""
    label = connected_components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "part")
    known = materialize(large.join(label, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "parts")
    banded = known.select("component", "rep", "nid", "n", "part", F.explode("bands").alias("band"))
    parts = banded.groupBy("band", "part").agg(F.sum("n").alias("own"), F.min("component").alias("component"), F.bit_xor("nid").alias("a"), F.bit_xor(F.xxhash64("nid")).alias("b"), F.count("*").alias("rows"))
    bands = parts.groupBy("band").agg(
        F.sum("own").alias("all"), F.max(F.struct("own", "part")).alias("major"), F.count("*").alias("parts"), F.min("component").alias("component"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("rows").alias("rows")
    ).where("parts > 1")
    # bands with the same members would confirm the same links
    once = bands.groupBy("component", "a", "b", "rows").agg(F.min(F.struct("band", "all", "major")).alias("x")).select("x.band", F.ceil(F.col("x.all") / F.lit(BLOCK)).cast("int").alias("every"), F.ceil((F.col("x.all") - F.col("x.major.own")) / F.lit(BLOCK)).cast("int").alias("few"), F.col("x.major.part").alias("major"), "rows")
    once = materialize(once, "bands")
    met = spread_join(banded, once.drop("rows"), "band", "nid", frequent(once, "band", "rows")[0])
    own = lambda n, seed: F.pmod(F.xxhash64("nid", F.lit(seed)), F.col(n)).cast("int")
    anyone = met.select("band", "rep", own("every", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("j"))
    outside = met.where("part <> major").select("band", "rep", F.explode(F.sequence(F.lit(0), F.col("every") - 1)).alias("i"), own("few", 2).alias("j"))
    placed = anyone.unionByName(outside).distinct().select("rep.*", "band", "i", "j")
    return _confirmed(placed, ["band", "i", "j"], docs, size, percent)


def labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, class) a row of docs: class is the smallest (doc_id, text_key) that links reach; null without shingles or doc_id."""
    sig = materialize(signatures(docs, size, percent), "sig")
    key = ["n", "set_a", "set_b"]
    classes = materialize(
        sig.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands")).withColumn("nid", F.xxhash64("rep.doc_id", "rep.text_key")), "classes"
    )
    # clusters only gather candidates, so a hash may stand for a representative here: two of one hash would share a cluster
    banded = classes.select("nid", F.explode("bands").alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.min("nid").alias("leader"), F.max("nid").alias("most"), F.count("*").alias("n")).where("leader < most").select("band", "leader", "n"), "shared")
    ties = spread_join(banded, shared.drop("n"), "band", "nid", frequent(shared, "band")[0]).where("nid <> leader").select("nid", "leader").distinct()
    members = materialize(connected_components(ties, "nid", "leader").withColumnRenamed("node", "nid").join(classes.select("rep", "nid", "n", "bands"), "nid"), "members")
    blocks = materialize(members.groupBy("component").agg(F.sum("n").alias("all"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("all") / F.lit(BLOCK)).cast("int")), "blocks")
    sized = spread_join(members, blocks.select("component", "blocks"), "component", "nid", frequent(blocks, "component")[0])
    own = sized.select("rep.*", "component", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block"))
    large = sized.where("blocks > 1")
    some = not blocks.where("blocks > 1").isEmpty()
    if some:
        first = F.row_number().over(Window.partitionBy("component").orderBy("nid", "rep"))
        seeds = large.withColumn("_n", first).where(F.col("_n") <= SEEDS).select("rep.*", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        own = own.unionByName(seeds).distinct()
    links = materialize(_confirmed(own, ["component", "block"], docs, size, percent), "links")
    if some:
        links = links.unionByName(materialize(_across(large, links, docs, size, percent), "links"))
    found = connected_components(links).withColumnsRenamed({"node": "rep", "component": "class"})
    named = materialize(classes.select(*key, "rep").join(found, "rep", "left").select(*key, F.coalesce("class", "rep").alias("class")), "named")
    return sig.select("doc_id", "text_key", *key).join(named, key, "left").select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Links join documents whose shingle sets have a Jaccard likeness of percent / 100 or more;
    component_id is the smallest doc_id reachable, kept says that it is the row's own. Null and empty
    texts, and texts without words, have no shingles and stand alone. Texts with shingles that share a doc_id count
    as linked; a row without doc_id has no component and is kept. Other columns play no part.
    """
    rows = materialize(labelled(docs, size, percent).select("doc_id", "n", F.col("class.doc_id").alias("id")), "labelled")
    several = rows.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    out = rows
    if not several.isEmpty():
        ties = connected_components(rows.join(several, "doc_id").select("id", "least").distinct(), "id", "least")
        out = rows.join(ties, F.col("id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "id").alias("id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near-duplicate detection keeps: of each group of linked texts the one with the smallest doc_id, once.

    Groups are of texts, so of a repeated doc_id with unlike texts each text has its own fate. Of rows equal in doc_id and
    text the first in the order of all columns as JSON stays. Rows without doc_id, and texts without shingles, stay.
    """
    rows = labelled(docs, size, percent).where("class is not null")
    fate = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.first("class").alias("class"))
    fate = fate.withColumn("gone", F.col("class") != F.struct("doc_id", "text_key")).where("gone or copies > 1")
    fate = materialize(fate.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "gone"), "fate")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_key"))
    kept = row.join(fate.hint("merge"), ["_id", "_key"], "left_anti").select("_row.*")
    again = fate.where("not gone").drop("gone")
    if again.isEmpty():
        return kept
    one = row.join(again, ["_id", "_key"]).groupBy("_id", "_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.unionByName(one.select("_row.*"))


def op3_minmax_dedup(spark, sf_dir: str) -> DataFrame:
    """Links at a likeness of 0.85 over 3-word shingles, for all documents."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 85)


#: The same by brute force: all pairs that share a shingle, and the labels that reach each document.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 85 * (len(sa.s) + len(sb.s) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, label) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.label FROM r JOIN e ON r.doc = e.a WHERE r.label < e.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.label AS component_id, m.label = s.doc_id AS kept FROM s JOIN (SELECT doc, min(label) AS label FROM r GROUP BY doc) m ON m.doc = s.doc_id
"""
