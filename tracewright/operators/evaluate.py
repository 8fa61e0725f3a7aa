"""Measures of a run against expectations, and of one run against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hierarchical(predicted: DataFrame, expected: DataFrame, kb: DataFrame, key: str) -> DataFrame:
    """(key, score): the best of 1 for an expected id, 0.7 for an alternative, 0.5 for an expected one's parent, 0.1 for a shared tactic, else 0. Where nothing is expected, 1 if nothing is predicted.

    predicted: key, id; expected: key, ids, alternatives, tactics; kb: id, parent, tactics.
    """
    of = expected.select(key, F.explode("ids").alias("id")).join(kb.select("id", "parent"), "id").where("parent is not null").groupBy(key).agg(F.collect_set("parent").alias("parents"))
    e = expected.join(of, key, "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    p = predicted.select(key, "id").join(kb.select("id", F.col("tactics").alias("own")), "id", "left").join(e, key)
    s = F.when(F.array_contains("ids", F.col("id")), 1.0).when(F.array_contains("alternatives", F.col("id")), 0.7).when(F.array_contains("parents", F.col("id")), 0.5).when(F.coalesce(F.arrays_overlap("tactics", "own"), F.lit(False)), 0.1).otherwise(0.0)
    best = p.groupBy(key).agg(F.max(s).alias("best"))
    return expected.join(best, key, "left").select(key, F.when(F.size("ids") == 0, F.when(F.col("best").isNull(), 1.0).otherwise(0.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def recall_at_k(retrieved: DataFrame, expected: DataFrame, key: str, k: int) -> DataFrame:
    """(key, hit): 1 if one of the wanted ids is among the first k distinct ones retrieved, null if none is wanted. retrieved: key, rank, id; expected: key, wanted ARRAY."""
    first = retrieved.groupBy(key, "id").agg(F.min("rank").alias("r"))
    top = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("r", "id"))).where(F.col("n") <= k).groupBy(key).agg(F.collect_set("id").alias("top"))
    j = expected.join(top, key, "left")
    return j.select(key, F.when(F.size("wanted") == 0, F.lit(None)).otherwise(F.coalesce(F.arrays_overlap("wanted", "top"), F.lit(False)).cast("double")).alias("hit"))


def abstained(negative: Column, expected_level: Column, strong_alerts: Column, bad_high: Column) -> Column:
    """Whether a run held back where it should: no strong alert on a harmless case, no sure and wrong one on an unclear case; null elsewhere."""
    return F.when(negative, strong_alerts == 0).when(expected_level == "insufficient", bad_high == 0)


def unknown_rate(mappings: DataFrame, kb: DataFrame, key: str) -> DataFrame:
    """(key, rate): share of ids that the knowledge base doesn't have."""
    known = kb.select("id").distinct().withColumn("k", F.lit(1))
    return mappings.join(known, "id", "left").groupBy(key).agg(F.avg(F.when(F.col("k").isNull(), 1.0).otherwise(0.0)).alias("rate"))


def run_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Means over rows without error, nulls left out: (by, n, errors, score, recall, abstention)."""
    fine = F.col("error").isNull()
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~fine).alias("errors"), F.round(F.avg(F.when(fine, F.col("score"))), 6).alias("score"), F.round(F.avg(F.when(fine, F.col("recall"))), 6).alias("recall"), F.round(F.avg(F.when(fine, F.col("abstained").cast("double"))), 6).alias("abstention"))


def run_compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(changed, improved, worsened, same, only_a, only_b) of two runs' values."""
    x, y = a.select(key, F.col(value).alias("x"), F.lit(1).alias("in_a")), b.select(key, F.col(value).alias("y"), F.lit(1).alias("in_b"))
    j = x.join(y, key, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return j.agg(F.count_if(both & ~F.col("x").eqNullSafe(F.col("y"))).alias("changed"), F.count_if(both & (F.col("y") > F.col("x"))).alias("improved"), F.count_if(both & (F.col("y") < F.col("x"))).alias("worsened"), F.count_if(both & F.col("x").eqNullSafe(F.col("y"))).alias("same"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def loss_layer(in_output: Column, agent_rejected: Column, gate_rejected: Column, selected: Column, retrieved: Column) -> Column:
    """Where an expected technique got lost, the first layer that holds."""
    return F.when(in_output, "found").when(agent_rejected, "reviewer").when(gate_rejected, "gate").when(selected, "after_review").when(retrieved, "not_selected").otherwise("never_retrieved")


def heavy_hitters(rows: DataFrame, item: str, k: int, capacity: int = 10_000) -> DataFrame:
    """(item, n, rank): the k most frequent values of a column with their exact counts, ties to the smaller value; null is no value.

    Each task keeps capacity counters at most (every decrement takes one from each, as Misra and Gries do); the counters of all tasks, summed, miss no value that is more
    frequent than rows / capacity. Only these candidates are counted exactly. If the k-th count doesn't lie above that bound, or candidates are fewer than k, all values are counted instead.
    """
    import pyarrow as pa

    kind = rows.schema[item].dataType.simpleString()

    def run(batches):
        held: dict = {}
        for batch in batches:
            for c in batch.column(0).value_counts().to_pylist():
                v, n = c["values"], c["counts"]
                held[v] = held.get(v, 0) + n
            if len(held) > 2 * capacity:
                held = _decreased(held, capacity)
        held = _decreased(held, capacity) if len(held) > capacity else held
        yield pa.RecordBatch.from_arrays([pa.array(list(held), batch_type), pa.array(list(held.values()), pa.int64())], ["item", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(rows.schema[item].dataType)
    values = rows.where(F.col(item).isNotNull()).select(F.col(item).alias("item"))
    total = values.count()
    parts = values.mapInArrow(run, f"item {kind}, n bigint")
    # summed counters overstate nothing and miss total / capacity at most, so a value above that is among the largest
    candidates = parts.groupBy("item").agg(F.sum("n").alias("least")).orderBy(F.col("least").desc(), "item").limit(capacity * 4).select("item")
    counted = values.join(F.broadcast(candidates), "item", "left_semi").groupBy("item").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.col("n").desc(), "item").limit(k).collect()
    if len(best) < k or best[-1].n <= total / capacity:
        counted = values.groupBy("item").agg(F.count("*").alias("n"))
        best = counted.orderBy(F.col("n").desc(), "item").limit(k).collect()
    return rows.sparkSession.createDataFrame([(r["item"], r.n, i) for i, r in enumerate(best, 1)], f"`{item}` {kind}, n bigint, rank int")


def _decreased(held: dict, capacity: int) -> dict:
    """At most capacity counters: all lose what the one after the largest capacity has."""
    least = sorted(held.values(), reverse=True)[capacity]
    return {v: n - least for v, n in held.items() if n > least}


def false_positives(given: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(technique, n, rank): the k techniques that most rows got and weren't to get. given, expected: key, technique; a technique counts once a row."""
    wrong = given.select("key", "technique").distinct().join(expected.select("key", "technique").distinct(), ["key", "technique"], "left_anti")
    return heavy_hitters(wrong, "technique", k)


def decision_scores(decisions: DataFrame, suspicious: str) -> DataFrame:
    """One row over decisions(key, decision, expected, negative): n, right, false_alarms of negatives, missed, the most frequent decision (of equals the least), how many are right for who always says that, and whether the run beats this."""
    by = decisions.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == F.col("expected")).alias("right"), F.count_if((F.col("decision") == suspicious) & F.col("negative")).alias("alarms"))
    wanted = decisions.groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.col("decision").isNull() | (F.col("decision") != suspicious)).alias("other"), F.count_if("negative").alias("negatives"))
    run = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"), F.coalesce(F.sum("alarms"), F.lit(0)).alias("false_alarms"))
    want = wanted.agg(F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"), F.coalesce(F.sum(F.when(F.col("expected") == suspicious, F.col("other"))), F.lit(0)).alias("missed"), F.map_from_entries(F.collect_list(F.when(F.col("expected").isNotNull(), F.struct("expected", "n")))).alias("of"))
    # both are one row: decisions are a few classes
    most = by.where("decision is not null").agg(F.get(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "decision"))), F.lit(0))["decision"].alias("majority"))
    one = [x.withColumn("_one", F.lit(1)) for x in (run, want, most)]
    both = one[0].join(one[1], "_one").join(one[2], "_one")
    return both.withColumn("baseline", F.coalesce(F.try_element_at("of", F.col("majority")), F.lit(0))).select("n", "right", "false_alarms", "negatives", "missed", "majority", "baseline", (F.col("right") > F.col("baseline")).alias("beats_baseline"))


def arm_rows(results: DataFrame, arms: list[str], metrics: list[str]) -> DataFrame:
    """(key, arm, metrics): a row for each arm of results(key, and a column <arm>_<metric> each), by unpivoting; a null stays null."""
    columns = [f"{a}_{m}" for a in arms for m in metrics]
    long = results.select("key", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("key", columns, "_column", "_value")
    places = F.create_map(*[F.lit(x) for a in arms for m in metrics for x in (f"{a}_{m}", f"{a}\n{m}")])[F.col("_column")]
    named = long.select("key", F.split_part(places, F.lit("\n"), F.lit(1)).alias("arm"), F.split_part(places, F.lit("\n"), F.lit(2)).alias("_metric"), "_value")
    return named.groupBy("key", "arm").pivot("_metric", metrics).agg(F.first("_value")).select("key", "arm", *metrics)


def arm_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(arm, means): the mean of each metric over the rows that have it, to four places; 0 if none has."""
    return rows.groupBy("arm").agg(*[F.coalesce(F.round(F.avg(m), 4), F.lit(0.0)).alias(m) for m in metrics])


def technique_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(technique, only_a, only_b): in how many rows one run has a technique and the other hasn't. a, b: key, technique; rows are matched one by one, so no row's set is collected. Keys that a run lacks altogether don't count."""
    keys = a.select("key").distinct().join(b.select("key").distinct(), "key")
    sides = [x.select("key", "technique").where("technique is not null").distinct().join(keys, "key", "left_semi") for x in (a, b)]
    both = sides[0].withColumn("_a", F.lit(1)).join(sides[1].withColumn("_b", F.lit(1)), ["key", "technique"], "full")
    return both.where("_a is null or _b is null").groupBy("technique").agg(F.count("_a").alias("only_a"), F.count("_b").alias("only_b"))


def arm_compare(a: DataFrame, b: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: rows of both runs, the change of their mean score, how many rows changed their techniques, and how many of these became better or worse.

    a, b: key, place, technique (null for a row without one); scores: key, a, b. A row changed if a technique or its place did.
    """
    sides = [x.where("technique is not null").select("key", "place", "technique").distinct() for x in (a, b)]
    met = sides[0].withColumn("_a", F.lit(1)).join(sides[1].withColumn("_b", F.lit(1)), ["key", "place", "technique"], "full")
    changed = met.where("_a is null or _b is null").select("key").distinct().withColumn("_changed", F.lit(1))
    s = scores.join(changed, "key", "left")
    is_changed = F.col("_changed").isNotNull()
    delta = F.round(F.round(F.avg("b"), 4) - F.round(F.avg("a"), 4), 4)
    return s.agg(F.count("*").alias("n"), F.coalesce(delta, F.lit(0.0)).alias("delta"), F.count_if(is_changed).alias("changed"), F.count_if(is_changed & (F.col("b") > F.col("a"))).alias("improved"), F.count_if(is_changed & (F.col("b") < F.col("a"))).alias("worsened"))
