"""Joins whose frequent keys are dealt over many tasks, and connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.workspace import discard, materialize

#: A key counts as frequent from one in so many rows on, so that there are that few of them at most: their list fits the driver and can be broadcast.
SHARE = 500


def limit(total: int) -> int:
    """Rows of a key from which it counts as frequent among total rows."""
    return max(100, -(-total // SHARE))


def frequent(counts: DataFrame, key: str, n: str = "n") -> tuple[list, int]:
    """The frequent keys of counts(key, n) as (key, tasks to deal it over), SHARE at most, and the total of n."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return [(r[0], -(-r[1] // limit(total))) for r in counts.where(F.col(n) > limit(total)).select(key, n).collect()], total


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right by key, where left may have very many rows of a key and right has few.

    Rows of the frequent keys `hot` (SHARE at most, see frequent) are dealt by a hash of the column `by` over as many tasks as stand
    there, and right's rows of those keys are copied to each.
    """
    if not hot:
        return left.join(right, key, how)
    listed = F.broadcast(left.sparkSession.createDataFrame(hot, f"_hot {left.schema[key].dataType.simpleString()}, _salts int"))
    salt = lambda df, made: df.join(listed, F.col(key) == F.col("_hot"), "left").withColumn("_salt", made).drop("_hot", "_salts")
    dealt = salt(left, F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_salts"))).otherwise(0).cast("int"))
    copied = salt(right, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges; nodes are of any type with an order.

    Loops and null ends are ignored; a node without another end has no row. Edges point from the larger end to the
    smaller. A round moves each edge's smaller end to the least neighbour of that (large star), then ties each node's
    smaller neighbours to their least (small star), until all edges form stars. Each round's edges are written to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Minima combine before the shuffle, and nodes with very many neighbours are dealt over many tasks.
    """
    e = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "cc",
    )
    while True:
        total = e.count()
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        degrees = ends.groupBy("x").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
        many = lambda n: F.collect_list(F.when(F.col(n) > limit(total), F.struct("x", n)))
        odd, below, above = degrees.agg(F.count_if(F.expr("above > 1 or above > 0 and below > 0")), many("below"), many("above")).first()
        if not odd:
            break
        tasks = lambda found: [(x, -(-n // limit(total))) for x, n in found]
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = spread_join(e, least, "v", "u", tasks(below), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            spread_join(large, low, "u", "v", tasks(above))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        last, e = e, materialize(small, "cc")
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
