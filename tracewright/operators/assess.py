"""Checking of proposed techniques: validation against a knowledge base, evidence gate, reviewers' decisions, confidence, verdicts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.text import evidence_norm, quoted_share, shortened
from tracewright.operators.rules import LEVELS
from tracewright.sources import catalog
from tracewright.workspace import materialize

# Shares of the parts of a composite confidence.
WEIGHTS = {"retrieval": 0.30, "evidence": 0.30, "fields": 0.15, "event_id": 0.15, "platform": 0.10}
# Evidence that a technique can't do without, any of them.
REQUIRED_TERMS = {
    "T1685.005": ["wevtutil", "Remove-EventLog", "EventID 1102", "winevt", "*.evtx deletion"],
    "T1047": ["wmic.exe", "WMI", "Win32_Process", "COM WMI", "powershell Get-WmiObject"],
    "T1021.006": ["WinRM", "winrs", "WSMAN", "port 5985", "port 5986"],
}
#: Characters of a summary at most.
SUMMARY = 600
VERDICTS = ["INSUFFICIENT_DATA", "SUFFICIENT_BENIGN", "SUFFICIENT_SUSPICIOUS"]
HARDNESS = {"SUFFICIENT_BENIGN": 0, "INSUFFICIENT_DATA": 1, "SUFFICIENT_SUSPICIOUS": 2}


def level_rank(level: Column) -> Column:
    """Place in high, medium, low, insufficient; the larger the weaker."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def level_of(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("insufficient")


def confidence(parts: dict[str, Column]) -> Column:
    """Weighted mean of the parts that are known; 0 if none is."""
    known = [(WEIGHTS[k], c) for k, c in parts.items()]
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in known])
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for w, c in known])
    return F.when(weight > 0, total / weight).otherwise(0.0)


def redirects(kb: DataFrame) -> DataFrame:
    """(id, target, hops): where a revoked entry leads after any number of hops; null for a chain that ends in a circle or in an unknown entry. kb: id, revoked_by.

    Every entry points to where it leads, and each round it takes over what its own target points to, so a chain of n hops takes log2(n) rounds of one equal join. An entry also keeps the
    least entry on its way: where that is the entry itself it stands in a circle, and whatever came by it can stop. Rows that have arrived are written once, and a round writes only what still
    moves, to the shared folder. Of a repeated id the row with the least revoked_by counts, none before any.
    """
    once = kb.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("revoked_by").isNotNull(), "revoked_by")).alias("r")).select("id", F.col("r.revoked_by").alias("next"))
    first = materialize(once.select("id", F.coalesce("next", "id").alias("at"), F.col("next").isNotNull().cast("bigint").alias("hops"), F.col("next").isNull().alias("done"), F.col("next").alias("least")), "redirects")
    settled, moving = first.where("done"), first.where("not done")
    for _ in range(first.count().bit_length() + 1):  # then chains of all entries would have ended
        if moving.isEmpty():
            break
        step = settled.unionByName(moving).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("done").alias("_done"), F.col("least").alias("_least"))
        moved = materialize(moving.join(step, "at", "left").select("id", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.coalesce("_done", F.lit(True)).alias("done"), F.least("least", "_least").alias("least")), "redirects")
        settled, moving = settled.unionByName(moved.where("done or at is null")), moved.where("not done and at is not null")
        circles = moving.where("least = id").select("least")
        if not circles.isEmpty():
            sorted_out = materialize(moving.join(circles.withColumn("_in", F.lit(True)), "least", "left").select("id", F.when(F.col("_in").isNull(), F.col("at")).alias("at"), "hops", "done", "least"), "redirects")
            settled, moving = settled.unionByName(sorted_out.where("at is null")), sorted_out.where("at is not null")
    arrived = F.col("done") & F.col("at").isNotNull()
    return settled.unionByName(moving).select("id", F.when(arrived, F.col("at")).alias("target"), F.when(arrived, F.col("hops")).cast("int").alias("hops"))


def validated(mappings: DataFrame, kb: DataFrame, grounded: DataFrame) -> DataFrame:
    """mappings(mapping_id, technique, name, level, text, evidence ARRAY) with status and what was put right.

    Unknown techniques, and revoked ones without a living successor, are rejected; a revoked one gives way to its successor. Name comes from the knowledge base kb(id, name, revoked_by);
    quotes that the text doesn't have go; a technique that was never retrieved (grounded: mapping_id, technique) falls to low.
    """
    known = kb.select(F.col("id").alias("_id"), F.col("name").alias("kb_name"))
    lead = redirects(kb).select(F.col("id").alias("_from"), F.col("target").alias("_to"), "hops")
    quotes = F.filter("evidence", lambda q: quoted_share(q, F.col("text")) >= 0.5)
    m = mappings.join(lead, F.col("technique") == F.col("_from"), "left").join(known, F.col("_to") == F.col("_id"), "left")
    g = grounded.select("mapping_id", F.col("technique").alias("_g")).distinct().withColumn("_in", F.lit(True))
    m = m.join(g.withColumnRenamed("mapping_id", "_m"), (F.col("mapping_id") == F.col("_m")) & (F.col("_to") == F.col("_g")), "left")
    weak = F.col("_in").isNull() & (level_rank(F.col("level")) < 2)
    return m.select(
        "mapping_id",
        F.coalesce("_to", "technique").alias("technique"),
        F.when(F.col("_to").isNull(), "rejected").otherwise("accepted").alias("status"),
        F.col("kb_name").alias("name"),
        F.when(weak, "low").otherwise(F.col("level")).alias("level"),
        quotes.alias("evidence"),
        F.array_compact(F.array(F.when(F.col("_to").isNull(), "unknown"), F.when(F.col("hops") > 0, "redirected"), F.when(F.col("kb_name") != F.col("name"), "renamed"), F.when(F.size(quotes) < F.size("evidence"), "unquoted"), F.when(F.col("_in").isNull(), "ungrounded"))).alias("notes"),
    )


def corrected(mappings: DataFrame, kb: DataFrame, grounded: DataFrame) -> DataFrame:
    """What validated gives, and every claim about a technique put right by the knowledge base: mapping_id, technique, status, name, object_type, tactics, source_url, level, summary, evidence, notes.

    mappings: those of validated, and object_type, tactics ARRAY, source_url, summary; kb: id, name, revoked_by, is_subtechnique, tactics ARRAY, source_url, deprecated. A mapping without
    one of the terms that its technique needs is rejected. Tactics that aren't the technique's give way to all of its own, addresses are compared without slashes at their
    end, an unknown level is low, a summary is shortened to SUMMARY characters at a sentence or word, and a deprecated technique is noted.
    """
    out = validated(mappings, kb, grounded)
    know = kb.select(F.col("id").alias("_id"), F.when(F.coalesce("is_subtechnique", F.lit(False)), "sub-technique").otherwise("technique").alias("_type"), F.coalesce("tactics", F.array().cast("array<string>")).alias("_tactics"), F.col("source_url").alias("_url"), F.coalesce("deprecated", F.lit(False)).alias("_old")).dropDuplicates(["_id"])
    claimed = mappings.select(F.col("mapping_id").alias("_m"), F.col("object_type").alias("_said"), F.coalesce("tactics", F.array().cast("array<string>")).alias("_claims"), F.col("source_url").alias("_at"), F.col("level").alias("_level"), "summary", F.col("text").alias("_text"))
    j = out.join(claimed, F.col("mapping_id") == F.col("_m")).join(know, F.col("technique") == F.col("_id"), "left")
    accepted = F.col("status") == "accepted"
    lacks = accepted & ~required_evidence(F.col("technique"), F.coalesce("_text", F.lit("")))
    typed = accepted & ~F.col("_said").eqNullSafe(F.col("_type"))
    moved = accepted & (F.size(F.array_except("_claims", "_tactics")) > 0)
    address = lambda c: F.rtrim(F.coalesce(c, F.lit("")), F.lit("/"))
    linked = accepted & (address("_at") != address("_url"))
    odd = ~F.coalesce(F.col("_level").isin(LEVELS), F.lit(False))
    long = F.length("summary") > SUMMARY
    notes = F.array_compact(F.array(*[F.when(c, n) for c, n in ((lacks, "no_required_evidence"), (typed, "type"), (moved, "tactics"), (linked, "url"), (odd, "level"), (accepted & F.col("_old"), "deprecated"), (long, "summary"))]))
    return j.select(
        "mapping_id",
        "technique",
        F.when(lacks, "rejected").otherwise(F.col("status")).alias("status"),
        "name",
        F.when(accepted, F.col("_type")).otherwise(F.col("_said")).alias("object_type"),
        F.when(moved, F.col("_tactics")).otherwise(F.col("_claims")).alias("tactics"),
        F.when(linked, F.col("_url")).otherwise(F.col("_at")).alias("source_url"),
        F.when(odd, "low").otherwise(F.col("level")).alias("level"),
        F.when(long, shortened(F.col("summary"), SUMMARY)).otherwise(F.col("summary")).alias("summary"),
        "evidence",
        F.concat("notes", notes).alias("notes"),
    )


def required_evidence(technique: Column, text: Column) -> Column:
    """Whether the text has one of the terms that the technique needs; true for those that need none."""
    norm = evidence_norm(text)
    out = F.lit(True)
    for t, terms in REQUIRED_TERMS.items():
        plain = [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in terms]
        out = F.when(technique == t, reduce(lambda a, b: a | b, [F.contains(norm, F.lit(x)) for x in plain])).otherwise(out)
    return out


def evidence_gate(mappings: DataFrame, hits: DataFrame, rules: DataFrame, events: DataFrame) -> DataFrame:
    """(technique, row, verdict) of mappings(technique, row): no rule of the technique: silent; one that matches the mapping's own row: confirm;
    rules that need an id, on a row without: abstain; else reject. hits(technique, row), rules(technique, needs_id), events(row, event_id)."""
    has = rules.groupBy("technique").agg(F.bool_and("needs_id").alias("needs_id"))
    own = hits.select("technique", "row").distinct().withColumn("hit", F.lit(True))
    m = mappings.join(has, "technique", "left").join(own, ["technique", "row"], "left").join(events.select("row", "event_id"), "row", "left")
    v = F.when(F.col("needs_id").isNull(), "silent").when(F.col("hit"), "confirm").when(F.col("needs_id") & F.col("event_id").isNull(), "abstain").otherwise("reject")
    return m.select("technique", "row", v.alias("verdict"))


def apply_decisions(findings: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """findings(by, technique, level) with status and level: any reject rejects; every downgrade is a ceiling, and a level never rises. decisions: by, technique, verdict, downgrade_to. No technique is added."""
    key = [*by, "technique"]
    d = decisions.groupBy(*key).agg(F.max((F.col("verdict") == "reject").cast("int")).alias("no"), F.max(F.when(F.col("verdict") == "downgrade", level_rank(F.col("downgrade_to")))).alias("cap"))
    rank = F.greatest(level_rank(F.col("level")), F.coalesce("cap", F.lit(0)))
    return findings.join(d, key, "left").select(*key, F.when(F.col("no") == 1, "rejected").otherwise("kept").alias("status"), F.get(F.array(*map(F.lit, LEVELS)), rank.cast("int")).alias("level"))


def suppressed(actors: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of actors(family, process, account, trusted) for which the pair of family, process and account is expected and whose folder is trusted."""
    return actors.where("trusted").join(expected, ["family", "process", "account"], "left_semi")


def expected_actors(spark) -> DataFrame:
    return spark.createDataFrame([(f, p, a) for f, ps, accounts in catalog.EXPECTED_ACTORS for p in ps for a in accounts], "family string, process string, account string")


def event_decision(n_techniques: Column, confirmed: Column, criticality: Column, access: Column, expected: Column) -> Column:
    """Struct of verdict, path and suppressed for one event.

    Path A, techniques with confirmed evidence, comes first and can't be suppressed. Path B is writing to a critical or high asset, benign for an expected actor. Reading noise without confirmed
    evidence is benign; all else lacks data.
    """
    a = (n_techniques > 0) & (confirmed > 0)
    b = criticality.isin("critical", "high") & (access == "write")
    noise = (criticality == "noise") & (access == "read") & (confirmed == 0)
    say = lambda v, p, s: F.struct(F.lit(v).alias("verdict"), F.lit(p).alias("path"), F.lit(s).alias("suppressed"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(a), say(VERDICTS[2], "A", False)).when(yes(b & expected), say(VERDICTS[1], "B", True)).when(yes(b), say(VERDICTS[2], "B", False)).when(yes(noise), say(VERDICTS[1], "noise", False)).otherwise(say(VERDICTS[0], "none", False))


def combine_alarm(decisions: DataFrame, by: list[str]) -> DataFrame:
    """One verdict of decisions(by, idx, verdict, suppressed): the hardest event's, of equals the first's; with the number of events of each verdict. Suppression stays with its event."""
    hard = F.create_map(*[F.lit(x) for kv in HARDNESS.items() for x in kv])[F.col("verdict")]
    best = F.max(F.struct(hard.alias("h"), (-F.col("idx")).alias("o"), "verdict", "idx")).alias("b")
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS]
    return decisions.groupBy(*by).agg(best, *counts, F.count_if("suppressed").alias("n_suppressed")).select(*by, F.col("b.verdict").alias("verdict"), F.col("b.idx").alias("by_event"), *[v.lower() for v in VERDICTS], "n_suppressed")


def should_refine(accepted: Column, rejected: Column, passes: Column) -> Column:
    """Whether a second pass is due: none was made and nothing was accepted or something was rejected."""
    return (passes < 1) & ((accepted == 0) | (rejected > 0))


def second_pass(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both passes, of one key the first pass's."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(2)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_p"))).where("_n = 1").drop("_n", "_p")


def quoted_matches(quotes: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """(quote_id, text_id, share) of quotes(quote_id, quote) that texts(text_id, text) bear out: share of the quote's distinct words of over three letters that the text has as words.

    A text that bears out a quote has one of any of its words that are more than it may lack; a quote looks for the rarest so many, so a word that most texts have brings no pairs together.
    What meets is compared in full. A repeated quote_id or text_id counts with all of its rows' words.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[^\s\p{Punct}]+"), F.lit(0)), lambda w: F.length(w) > 3))
    of = lambda df, key, c: df.select(key, words(F.col(c)).alias("w")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w")).where("size(w) > 0")
    q = materialize(of(quotes, "quote_id", "quote"), "quotes")
    t = materialize(of(texts, "text_id", "text"), "texts")
    asked = q.select("quote_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    held = t.select("text_id", F.explode("w").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    often = held.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("quote_id").orderBy("df", "word"))
    rare = asked.join(often, "word").withColumn("_n", place)
    # words that no text has are the rarest, and take up that many of the places
    missing = asked.join(often, "word", "left_anti").groupBy("quote_id").agg(F.count("*").alias("gone"))
    wanted = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1 - F.coalesce("gone", F.lit(0))
    signs = rare.join(missing, "quote_id", "left").where(F.col("_n") <= wanted).select("quote_id", "word")
    met = signs.join(held, "word").select("quote_id", "text_id").distinct()
    both = met.join(q.select("quote_id", F.col("w").alias("qw")), "quote_id").join(t, "text_id")
    share = F.size(F.array_intersect("qw", "w")) / F.size("qw")
    return both.select("quote_id", "text_id", F.round(share, 6).alias("share")).where(F.col("share") >= least)


# Programs whose scheduled tasks are routine; rights that read memory; products that open every process.
ROUTINE_TASKS = r"(?i)\\windows\\system32\\(sc|wevtutil|defrag|compattelrunner)\.exe|\\program files\\windows defender\\|\\program files\\microsoft\\.*\\updater\.exe|\\windows\\system32\\usoclient\.exe"
MEMORY_READ = r"(?i)(0x1010|0x1410|0x143a|PROCESS_VM_READ|VMRead)"
SECURITY_TOOLS = r"(?i)\\(MsMpEng|MpDefenderCoreService|CSFalconService|SentinelAgent|cb\.exe|xagt|SysmonDrv)\b|\\windows defender\\"


def review(technique: Column, level: Column, text: Column, polarity: Column) -> Column:
    """Struct of reviewer, verdict and downgrade_to for techniques that have a fixed reviewer, null for others.

    Scheduled tasks on another machine are confirmed, routine programs rejected; process memory opened by security products is rejected, with rights to read it confirmed, else medium at most; firewall
    changes need evidence of a broken control.
    """
    say = lambda who, v, to=None: F.struct(F.lit(who).alias("reviewer"), F.lit(v).alias("verdict"), F.lit(to).cast("string").alias("downgrade_to"))
    task = F.when(text.rlike(r"(?i)/s\s+\S+"), say("scheduled-task", "confirm")).when(text.rlike(ROUTINE_TASKS), say("scheduled-task", "reject")).otherwise(say("scheduled-task", "abstain"))
    weaker = level_rank(level) < level_rank(F.lit("medium"))
    memory = F.when(text.rlike(SECURITY_TOOLS), say("process-memory", "reject")).when(text.rlike(MEMORY_READ), say("process-memory", "confirm")).when(weaker, say("process-memory", "downgrade", "medium")).otherwise(say("process-memory", "abstain"))
    wall = F.when(polarity == "breaking", say("firewall", "confirm")).otherwise(say("firewall", "reject"))
    return F.when(technique == "T1053.005", task).when(technique == "T1003.001", memory).when(technique == "T1686.003", wall)


def benign_signals(text: Column) -> Column:
    """Struct of strong and weak: signs that an activity is approved work. A ticket is strong, and so are two weak ones."""
    ticket = text.rlike(r"(?i)\b(CHG|INC|RFC|REQ|TASK|CR)[-#]?\d{3,}\b")
    weak = [text.rlike(p).cast("int") for p in (r"(?i)\b(approved|authori[sz]ed|scheduled maintenance|change window)\b", r"(?i)\b(it team|sysadmin|administrator|help ?desk)\b", r"(?i)\b(sccm|wsus|intune|patch management|backup server)\b")]
    n = reduce(lambda a, b: a + b, weak)
    return F.struct((ticket | (n >= 2)).alias("strong"), n.alias("weak"))
