"""Correlation: which rows belong to one incident.

Two rows are related if they share a non-empty field value (letter case aside) or are parent and child process, and lie
within a window of each other; a row without time fits any. The pairwise definition is never run: rows that share a value are
tied to the least of their slice, which gives the same components from a sort in place of a cross product. A value's rows are cut into slices of
the window's length, and slices without a gap between them are tied to the first of their run, so a value that very many rows share is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.operators.graph import connected_components, frequent, spread_join
from tracewright.workspace import materialize

HOURS = 24
#: Lineage: (own id, parent's id); the second pair counts only for rows without the first's own id.
LINEAGE = (("process_guid", "parent_process_guid"), ("process_id", "parent_process_id"))


#: Slices that a value's rows without time are dealt into.
UNTIMED = 64


def _window(hours: float) -> tuple[int, Column]:
    """The window in whole seconds, and as an interval."""
    seconds = int(hours * 3600)
    if seconds < 1:
        raise ValueError("the window must be a second or more")
    return seconds, F.expr(f"INTERVAL '{seconds}' SECOND")


def time_slice(ts: str, seconds: int) -> Column:
    """The number of the slice of so many seconds that a time lies in. Rows of one slice lie within the window of each other, and rows two slices apart don't."""
    c = F.col(ts)
    at = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.floor(at / seconds)


def _value(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))


def islands(rows: DataFrame, key: list[str], ts: str, order: str, hours: float = HOURS) -> DataFrame:
    """rows with island: the number, from 1, of the run of rows of one key without a gap of more than hours. A gap of just hours stays together. Null times form no island.

    A slice lies in one island, so islands are numbered over slices, and rows only look theirs up; the order of rows within a slice (order) plays no part.
    """
    seconds, near = _window(hours)
    sliced = rows.where(F.col(ts).isNotNull()).withColumn("_s", time_slice(ts, seconds))
    ends = sliced.groupBy(*key, "_s").agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))
    w = Window.partitionBy(*key).orderBy("_s")
    new = F.when(F.coalesce(F.col("_low") - F.lag("_high").over(w) > near, F.lit(True)), 1).otherwise(0)
    numbered = ends.withColumn("_new", new).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], F.col("_s").alias("_of"), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)], F.col("_s") == F.col("_of"))
    return sliced.join(numbered, same).select(*rows.columns, "island")


def bucket_keys(items: DataFrame, fields: list[str]) -> DataFrame:
    """(row, ts, bucket): a row for each non-empty value that a row can share."""
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), _value(f).alias("v")) for f in fields])
    return items.select("row", "ts", F.explode(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("b")).select("row", "ts", F.concat_ws("\u0001", "b.v", "b.k").alias("bucket"))


def _sliced(buckets: DataFrame, seconds: int) -> DataFrame:
    none = F.col("ts").isNull()
    return buckets.withColumn("_none", none).withColumn("_s", F.when(none, F.pmod(F.xxhash64("row"), F.lit(UNTIMED))).otherwise(time_slice("ts", seconds)))


def slice_ties(buckets: DataFrame, hours: float = HOURS) -> DataFrame:
    """(row, tie): each row of a bucket's slice with the slice's least row, which stands for the slice; the least row with itself."""
    so_far = Window.partitionBy("bucket", "_none", "_s").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return _sliced(buckets, _window(hours)[0]).select("row", F.first("row").over(so_far).alias("tie"))


def slice_edges(buckets: DataFrame, hours: float = HOURS) -> DataFrame:
    """(src, dst), least rows of slices: each slice of a run without a larger gap than the window with the run's first; in a bucket with a row without time, each slice with the least such row."""
    seconds, near = _window(hours)
    ends = _sliced(buckets, seconds).groupBy("bucket", "_none", "_s").agg(F.min("row").alias("tie"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    bridge = F.min(F.when(F.col("_none"), F.col("tie"))).over(Window.partitionBy("bucket"))
    by_slice = Window.partitionBy("bucket", "_none").orderBy("_s")
    begins = F.coalesce(F.col("first") - F.lag("last").over(by_slice) > near, F.lit(True))
    run = F.last(F.when(F.col("_begins"), F.col("tie")), ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, 0))
    tied = ends.withColumn("_bridge", bridge).withColumn("_begins", begins).withColumn("_run", F.when(F.col("_none"), None).otherwise(run))
    return tied.select(F.col("tie").alias("src"), F.explode(F.array("_run", "_bridge")).alias("dst")).where("dst is not null and src <> dst")


def chain_edges(buckets: DataFrame, hours: float = HOURS) -> DataFrame:
    """(src, dst): slice_ties and slice_edges.

    So no path between two related rows is longer than a few edges, however long a run is, and components settle in a few rounds.
    """
    inside = slice_ties(buckets, hours).select(F.col("row").alias("src"), F.col("tie").alias("dst")).where("src <> dst")
    return inside.unionByName(slice_edges(buckets, hours))


def lineage_edges(items: DataFrame, hours: float = HOURS) -> DataFrame:
    """(src, dst) of parents and children alone, enough of them for the same components.

    Two children of one parent id are no relatives unless the parent's row is there, so lineage isn't chained like a shared value. Of the rows of one
    id in order of time, as own or as parent's id, each child is tied to the nearest parent before and after it, and each parent to the nearest child: between any
    two that are related, neighbours of unlike kind follow each other, so all are tied. Each slice also sees the nearest ends of the slices beside it. A row
    without time is tied to one row of the other kind, and each row of the other kind to one such row.
    """
    seconds, near = _window(hours)
    (guid, parent_guid), (pid, parent_pid) = LINEAGE

    def sides(kind, own, parent, where):
        side = lambda c, name: items.where(where).select("row", "ts", F.lit(kind).alias("kind"), _value(c).alias("v"), F.lit(name).alias("side"))
        return side(own, "parent").unionByName(side(parent, "child"))

    every = sides("guid", guid, parent_guid, F.lit(True)).unionByName(sides("pid", pid, parent_pid, _value(guid).isNull())).where("v is not null")
    none = F.col("ts").isNull()
    dealt = every.withColumn("_none", none).withColumn("_s", F.when(none, F.pmod(F.xxhash64("row"), F.lit(UNTIMED))).otherwise(time_slice("ts", seconds)))
    at = lambda f, side: f(F.when(F.col("side") == side, F.struct("ts", "row", "side")))
    ends = dealt.groupBy("kind", "v", "_none", "_s").agg(*[at(f, side).alias(f"{name}_{side}") for f, name in ((F.min, "first"), (F.max, "last")) for side in ("parent", "child")])
    beside = F.array(*[F.struct((F.col("_s") + (1 if name == "last" else -1)).alias("_s"), F.col(f"{name}_{side}").alias("x")) for name in ("first", "last") for side in ("parent", "child")])
    ghosts = ends.where("not _none").select("kind", "v", F.explode(beside).alias("e")).where("e.x is not null").select("kind", "v", "e._s", "e.x.*")
    met = dealt.where("not _none").select("kind", "v", "_s", "ts", "row", "side").unionByName(ghosts)
    w = Window.partitionBy("kind", "v", "_s").orderBy("ts", "row", "side")
    other = lambda f, side, rows: f(F.when(F.col("side") == side, F.struct("ts", "row")), ignorenulls=True).over(rows)
    ahead, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    nearest = F.when(F.col("side") == "child", F.array(other(F.last, "parent", ahead), other(F.first, "parent", behind))).otherwise(F.array(other(F.last, "child", ahead), other(F.first, "child", behind)))
    timed = met.select("row", "ts", nearest.alias("o")).select("row", "ts", F.explode("o").alias("o")).where((F.col("ts") - F.col("o.ts")).between(-near, near)).select(F.col("row").alias("src"), F.col("o.row").alias("dst"))
    # rows without time
    row_of = lambda side, only: F.min(F.when(F.col("_none"), F.col(f"first_{side}.row")) if only else F.col(f"first_{side}.row"))
    free = ends.groupBy("kind", "v").agg(row_of("parent", True).alias("free_parent"), row_of("child", True).alias("free_child"), row_of("parent", False).alias("parent"), row_of("child", False).alias("child")).where("free_parent is not null or free_child is not null")
    known = ends.select("kind", "v", "_none", "_s").join(free, ["kind", "v"])
    tied = F.when(F.col("side") == "child", F.array("free_parent", F.when(F.col("_none"), F.col("parent")))).otherwise(F.array("free_child", F.when(F.col("_none"), F.col("child"))))
    untimed = dealt.join(known, ["kind", "v", "_none", "_s"]).select(F.col("row").alias("src"), F.explode(tied).alias("dst"))
    return timed.unionByName(untimed).where("dst is not null and src <> dst")


def incident_groups(items: DataFrame, fields: list[str], hours: float = HOURS, lineage: bool = True) -> DataFrame:
    """(row, incident): incident is the smallest row of the component; components of one row have none, nor have rows whose skipped is true.

    Components are made of slices, each as its least row: a row only says which of its slices belong together, and looks its component up by one of them.
    items: row, ts, the fields, skipped if there is such a column, and the LINEAGE columns if lineage is asked for.
    """
    usable = items.where(~F.coalesce(F.col("skipped"), F.lit(False))) if "skipped" in items.columns else items
    buckets = bucket_keys(usable, fields)
    ties, edges = slice_ties(buckets, hours), slice_edges(buckets, hours)
    if lineage:
        family = materialize(lineage_edges(usable, hours), "lineage")
        ties = ties.unionByName(family.select(F.explode(F.array("src", "dst")).alias("row")).distinct().withColumn("tie", F.col("row")))
        edges = edges.unionByName(family)
    # a row's ties in order: the least stands for the row, and the others are tied to it
    w = Window.partitionBy("row").orderBy("tie")
    ties = materialize(ties.select("row", "tie", F.first("tie").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("least"), (F.row_number().over(w) == 1).alias("one")), "ties")
    near = connected_components(ties.where("tie <> least").select(F.col("tie").alias("src"), F.col("least").alias("dst")).unionByName(edges))
    rows = ties.where("one").select("row", "least")
    sizes = materialize(rows.groupBy("least").agg(F.count("*").alias("n")), "sizes")
    several = sizes.where("n > 1").select(F.col("least").alias("node"), F.col("least").alias("component"))
    found = near.unionByName(several).groupBy(F.col("node").alias("least")).agg(F.min("component").alias("incident"))
    return spread_join(rows, found, "least", "row", frequent(sizes, "least")[0]).select("row", "incident")
