"""What an incident says: techniques once each, strong and weak, attack chain, risk, timeline, indicators, most common values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The order of the kill chain's phases.
TACTICS = ["Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Stealth", "Defense Impairment", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command And Control", "Exfiltration", "Impact"]
# Phases that weigh more in the risk score.
HIGH_RISK = ["Credential Access", "Lateral Movement", "Exfiltration", "Impact", "Command And Control"]
EVIDENCE = 5
STRONG = ["high", "medium"]
STRONG_SCORE = 0.5


def technique_rows(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, technique, row) once each: the rows of every technique as a table, as one cell could not hold them."""
    return entries.where("technique is not null and technique <> ''").select(*by, "technique", "row").distinct()


def dedupe_techniques(entries: DataFrame, by: list[str]) -> DataFrame:
    """One row for each of by and technique: occurrences, number of distinct rows, first time, best score and its representative (of equal scores the first), and the first EVIDENCE distinct quotes in order.

    entries: by, technique, row, ord (order within), ts, score, level, evidence ARRAY<STRING>. Entries without technique are left out; a null score counts as 0. technique_rows() has the rows.
    """
    key = [*by, "technique"]
    e = entries.where("technique is not null and technique <> ''").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = F.max(F.struct("score", (-F.col("ord")).alias("o"), "row", "level")).alias("best")
    main = e.groupBy(*key, "row").agg(F.count("*").alias("n"), F.min("ts").alias("ts"), best).groupBy(*key).agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_rows"), F.min("ts").alias("first_seen"), F.max("best").alias("best"))
    quotes = e.select(*key, "ord", F.posexplode("evidence").alias("p", "quote")).groupBy(*key, "quote").agg(F.min(F.struct("ord", "p")).alias("at"))
    first = quotes.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).where(F.col("n") <= EVIDENCE)
    evidence = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "quote"))), lambda q: q["quote"]).alias("evidence"))
    return main.join(evidence, key, "left").select(*key, "occurrences", "n_rows", "first_seen", F.col("best.score").alias("max_score"), F.col("best.level").alias("level"), F.col("best.row").alias("representative"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def is_strong(level: Column, score: Column) -> Column:
    """High and medium are strong; without a level the score decides."""
    return F.when(level.isNull(), F.coalesce(score, F.lit(0.0)) >= STRONG_SCORE).otherwise(level.isin(STRONG))


def tactic_rank(tactic: Column) -> Column:
    """Place in the kill chain from 1; unknown tactics come last."""
    at = F.array_position(F.array(*map(F.lit, TACTICS)), tactic)
    return F.when(at > 0, at).otherwise(len(TACTICS) + 1)


def primary_tactic(tactics: Column) -> Column:
    """The earliest of the technique's tactics; if none is known, the first listed."""
    known = F.filter(F.array(*map(F.lit, TACTICS)), lambda t: F.array_contains(tactics, t))
    return F.when(F.size(known) > 0, F.get(known, F.lit(0))).otherwise(F.get(tactics, F.lit(0)))


def attack_chain(techniques: DataFrame, by: list[str], primary_only: bool = True) -> DataFrame:
    """(by, phase, tactic, techniques): each technique in its primary tactic, or in all of its tactics."""
    tactic = F.array(primary_tactic(F.col("tactics"))) if primary_only else F.array_distinct("tactics")
    placed = techniques.select(*by, "technique", F.explode(tactic).alias("tactic")).where("tactic is not null")
    return placed.groupBy(*by, "tactic").agg(F.array_sort(F.collect_set("technique")).alias("techniques")).select(*by, tactic_rank(F.col("tactic")).cast("int").alias("phase"), "tactic", "techniques")


def severity(score: Column) -> Column:
    return F.when(score >= 75, "Critical").when(score >= 50, "High").when(score >= 25, "Medium").otherwise("Low")


def risk_scores(techniques: DataFrame, by: list[str]) -> DataFrame:
    """(by, phases, n_techniques, score, severity) from strong techniques (by, technique, tactics, score); half-way scores go to the even number."""
    chain = techniques.withColumn("tactic", primary_tactic(F.col("tactics")))
    high = F.count_distinct(F.when(F.col("tactic").isin(HIGH_RISK), F.col("tactic")))
    g = chain.groupBy(*by).agg(F.count_distinct("tactic").alias("phases"), high.alias("high"), F.count("*").alias("n_techniques"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    raw = 30.0 * F.col("phases") / len(TACTICS) + F.least(15 * F.col("high"), F.lit(30)) + F.least(3 * F.col("n_techniques"), F.lit(20)) + 20 * F.col("mean")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(raw, 6), 0))).cast("int")
    return g.select(*by, "phases", "n_techniques", score.alias("score"), severity(score).alias("severity"))


def timeline(entries: DataFrame, by: list[str]) -> DataFrame:
    """The best mapping of each row in order of time: (by, place, row, ts, technique, evidence). Rows without time come last; of equal scores the first mapping is taken."""
    best = F.row_number().over(Window.partitionBy(*by, "row").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ts").asc_nulls_last(), "row"))
    return entries.withColumn("_b", best).where("_b = 1").withColumn("place", place).select(*by, "place", "row", "ts", "technique")


def most_common(rows: DataFrame, by: list[str], value: str, ord_: str) -> DataFrame:
    """(by, value, n): the most frequent non-empty value, of equal ones the first seen."""
    counted = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(ord_).alias("_first"))
    best = F.max(F.struct("n", (-F.col("_first")).alias("o"), F.col(value).alias("v"))).alias("b")
    return counted.groupBy(*by).agg(best).select(*by, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def distinct_indicators(indicators: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, value, n) once for each kind and value, letter case aside, in the first spelling seen. indicators: by, ord, kind, value; null and blank values are none."""
    clean = indicators.where("value is not null and trim(value) <> ''").withColumn("_l", F.lower("value"))
    first = F.min(F.struct("ord", "value")).alias("f")
    return clean.groupBy(*by, "kind", "_l").agg(first, F.count("*").alias("n")).select(*by, "kind", F.col("f.value").alias("value"), "n")


# Ids and words that put a row into a category of indicators.
CATEGORY_IDS = {"process": ["1", "4688"], "network": ["3", "5156"], "service": ["7045", "4697"], "user": ["4720"], "registry": ["12", "13", "14", "4657"], "credential": ["10"]}
DOWNLOADS = ["downloadfile", "downloadstring", "invoke-webrequest", "iwr ", "certutil -urlcache", "certutil.exe -urlcache", "bitsadmin", "wget ", "curl "]
CREDENTIALS = ["lsass", "mimikatz", "sekurlsa"]


def indicator_rows(rows: DataFrame) -> DataFrame:
    """(row, category, detail), a row each category that a row of rows(row, event_id, process, command_line, source_ip, destination_ip, service, file_path, target_image, target_object, target_user) shows.

    Categories: process, network, download, service, user, registry, credential. detail is what the category is about, null if the row doesn't name it.
    """
    some = lambda c, words: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)) for w in words])
    of = lambda kind: F.coalesce(F.col("event_id").isin(CATEGORY_IDS[kind]), F.lit(False))
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kinds = [
        ("process", of("process") | there("process"), F.col("process")),
        ("network", of("network") | there("source_ip") | there("destination_ip"), F.concat_ws(" -> ", "source_ip", "destination_ip")),
        ("download", some(F.col("command_line"), DOWNLOADS), F.col("file_path")),
        ("service", of("service") | there("service"), F.col("service")),
        ("user", of("user"), F.col("target_user")),
        ("registry", of("registry") | there("target_object"), F.col("target_object")),
        ("credential", of("credential") | some(F.col("target_image"), ["lsass"]) | some(F.col("command_line"), CREDENTIALS) | some(F.col("process"), CREDENTIALS), F.coalesce("target_image", "process")),
    ]
    shown = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), d.cast("string").alias("detail"))) for k, c, d in kinds]))
    return rows.select("row", F.explode(shown).alias("x")).select("row", "x.*")


def risk_parts(techniques: DataFrame, by: list[str]) -> DataFrame:
    """(by, tactics, high_risk, coverage, bonus, volume, confidence, n_techniques): the parts that risk_scores adds, from the same strong techniques, with the tactics behind them in order."""
    chain = techniques.withColumn("tactic", primary_tactic(F.col("tactics")))
    rank = F.struct(tactic_rank(F.col("tactic")).alias("r"), F.col("tactic").alias("t"))
    names = lambda c: F.transform(F.array_sort(F.collect_set(c)), lambda x: x["t"])
    g = chain.groupBy(*by).agg(names(rank).alias("tactics"), names(F.when(F.col("tactic").isin(HIGH_RISK), rank)).alias("high_risk"), F.count("*").alias("n_techniques"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    return g.select(*by, "tactics", "high_risk", F.round(30.0 * F.size("tactics") / len(TACTICS), 2).alias("coverage"), F.least(15 * F.size("high_risk"), F.lit(30)).alias("bonus"), F.least(3 * F.col("n_techniques"), F.lit(20)).cast("int").alias("volume"), (F.round(20 * F.col("mean") * 100) / 100).alias("confidence"), "n_techniques")


def rebuilt(saved: DataFrame, by: list[str]) -> DataFrame:
    """(by, strong, weak, phases, score, severity) made anew from saved techniques (by, technique, tactics, level, max_score), as after a change of the rules of presentation."""
    t = saved.withColumn("_strong", is_strong(F.col("level"), F.col("max_score"))).withColumn("score", F.col("max_score"))
    counts = t.groupBy(*by).agg(F.count_if("_strong").alias("strong"), F.count_if(~F.col("_strong")).alias("weak"))
    return counts.join(risk_scores(t.where("_strong"), by).drop("n_techniques"), by, "left").select(*by, "strong", "weak", F.coalesce("phases", F.lit(0).cast("bigint")).alias("phases"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("severity", F.lit("Low")).alias("severity"))


def rule_parameters(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, ids, processes, correlate_by, correlate_value, window_minutes, threshold) of a detection rule from an incident's hits (by, row, ts, id, process, host, user); incidents of fewer than two ids give none.

    The correlation key is the host if all rows have one, else the user likewise. The window is one and a half of the span, from 15 minutes to a day. Programs go by their names in lower case.
    """
    base = F.lower(F.regexp_extract(F.col("process"), r"([^\\/]+)$", 1)) if "process" in hits.columns else F.lit(None).cast("string")
    g = hits.withColumn("_p", F.nullif(base, F.lit(""))).groupBy(*by).agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("_p")).alias("processes"), F.count_distinct("host").alias("hosts"), F.count_distinct("user").alias("users"), F.min("host").alias("host"), F.min("user").alias("user"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("span"), F.count_distinct("row").alias("n"))
    window = F.greatest(F.lit(15), F.least(F.lit(1440), F.floor(F.col("span") / 60 * 1.5) + 1)).cast("int")
    key = lambda a, b: F.when(F.col("hosts") == 1, a).when(F.col("users") == 1, b)
    return g.where("size(ids) >= 2").select(*by, "ids", "processes", key(F.lit("host"), F.lit("user")).alias("correlate_by"), key(F.col("host"), F.col("user")).alias("correlate_value"), window.alias("window_minutes"), F.least("n", F.lit(3)).cast("int").alias("threshold"))
