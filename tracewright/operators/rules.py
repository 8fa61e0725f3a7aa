"""Technique rules: up to COMPILED of them as one expression each, more by the literals of their patterns (rulebook), over all rows in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.text import asset_path, looks_like_registry, needs_broken_control, polarity, registry_path
from tracewright.operators import rulebook
from tracewright.sources import catalog
from tracewright.workspace import materialize

#: Rules that are compiled into the plan; more are tested as data.
COMPILED = 200
#: Rows that a finding lists.
LISTED = 20
LEVELS = ["high", "medium", "low", "insufficient"]


@dataclass(frozen=True)
class Condition:
    """A field's value, or its registry spelling, matches must, and neither matches must_not."""

    field: str
    must: str | None = None
    must_not: str | None = None

    @property
    def on_paths(self) -> bool:
        return "\\\\" in f"{self.must}{self.must_not}"

    def compiled(self, fields: Column, paths: dict[str, Column]) -> Column:
        """paths: columns of registry spellings by field, for conditions on paths."""
        v = F.coalesce(fields[self.field], F.lit(""))
        norm = paths.get(self.field) if self.on_paths else None
        either = lambda p: v.rlike(p) if norm is None else v.rlike(p) | F.coalesce(norm.rlike(p), F.lit(False))
        out = F.lit(True)
        if self.must:
            out = out & either(self.must)
        return out & ~either(self.must_not) if self.must_not else out


@dataclass(frozen=True)
class Rule:
    """All of conditions, each any of its alternatives, on a row with a required id and without a forbidden one; and so many rows at least."""

    technique: str
    name: str
    tactic: str
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    conditions: tuple[tuple[Condition, ...], ...] = ()
    min_events: int = 1
    level: str = "high"
    id_field: str = field(default="EventID")

    def __post_init__(self):
        if not self.required and not self.conditions:
            raise ValueError(f"{self.technique}: a rule needs ids or conditions")
        if self.level not in LEVELS or self.min_events < 1:
            raise ValueError(f"{self.technique}: level or min_events")

    def has_id(self, event_id: Column) -> Column:
        ids = F.lit(True)
        if self.forbidden:
            ids = ids & ~F.coalesce(event_id.isin(list(self.forbidden)), F.lit(False))
        if self.required:
            ids = ids & F.coalesce(event_id.isin(list(self.required)), F.lit(False))
        return ids

    def holds(self, fields: Column, paths: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [c.compiled(fields, paths) for c in any_of]) for any_of in self.conditions], F.lit(True))


def catalogue() -> list[Rule]:
    return [Rule(t, n, ta, tuple(r), tuple(f), tuple(tuple(Condition(*c) for c in a) for a in cs), m, lv) for t, n, ta, r, f, cs, m, lv in catalog.RULES]


def review_catalogue() -> list[Rule]:
    """Rules without technique: an analyst should look."""
    return [Rule(i, i, "", (), (), tuple(tuple(Condition(*c) for c in a) for a in cs), m, "low") for i, cs, m in catalog.REVIEW_RULES]


def event_number(fields: Column) -> Column:
    """The id of an event: the first digits of event.id or EventID, else EventID= or EventID: in the message."""
    v = F.coalesce(fields["event.id"], fields["EventID"])
    return F.coalesce(F.nullif(F.regexp_extract(v, r"\d+", 0), F.lit("")), F.nullif(F.regexp_extract(fields["Message"], r"(?i)event\s?id\s*[=:]\s*(\d+)", 1), F.lit("")))


def hits(rows: DataFrame, rules: list[Rule], event_id: Column | None = None, with_polarity: bool = True) -> DataFrame:
    """(row, rule, polarity): rule is the place in rules. rows: row and fields MAP. One projection tests all rules, or one automaton beyond COMPILED of them; no row meets another."""
    number = event_number(F.col("fields")) if event_id is None else event_id
    if len(rules) > COMPILED:
        return rulebook.hits(rows, rules, number, with_polarity)
    on_paths = sorted({c.field for r in rules for any_of in r.conditions for c in any_of if c.on_paths})
    spelt = {f"_path{i}": F.when(looks_like_registry(F.col("fields")[f]), registry_path(F.col("fields")[f])) for i, f in enumerate(on_paths)}
    paths = {f: F.col(f"_path{i}") for i, f in enumerate(on_paths)}
    # ids first, since they are cheap and most rows fail them; a condition below a when of its own isn't computed for the other rows, as one in a conjunction is that several rules share
    tested = F.array_compact(F.array(*[F.when(r.has_id(F.col("_id")), F.when(r.holds(F.col("fields"), paths), F.lit(i))) for i, r in enumerate(rules)]))
    source = F.coalesce(F.nullif(F.col("fields")["Message"], F.lit("")), F.array_join(F.map_values("fields"), " "))
    return rows.withColumns({"_id": number, **spelt}).select("row", polarity(source).alias("polarity"), F.explode(tested).alias("rule"))


def allowed_hits(rows: DataFrame, rules: list[Rule], event_id: Column | None = None) -> DataFrame:
    """(row, rule) of hits that tell of a broken control where the rule's technique asks for it. A row's text is looked at for that only if such a rule matches it, as two searches through each text cost more than all rules."""
    bound = [i for i, r in enumerate(rules) if needs_broken_control(r.technique)]
    return hits(rows, rules, event_id, bool(bound)).where(~F.col("rule").isin(bound) | (F.col("polarity") == "breaking")).select("row", "rule")


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    columns = {"rule": range(len(rules)), **{c: [getattr(r, c) for r in rules] for c in ("technique", "name", "tactic", "min_events", "level")}, "rank": [LEVELS.index(r.level) for r in rules]}
    schema = pa.schema([(c, pa.int32() if c in ("rule", "min_events", "rank") else pa.string()) for c in columns])
    return spark.createDataFrame(pa.Table.from_pydict({c: pa.array(v, schema.field(c).type) for c, v in columns.items()}, schema=schema))


def evidence(rows: DataFrame, rules: list[Rule], by: list[str] = (), event_id: Column | None = None) -> DataFrame:
    """(by, rule, technique, name, rank, row), a row each: rows that match a rule, where the rule has enough of them within by. Evidence of polarity where the technique asks for it."""
    found = allowed_hits(rows, rules, event_id).join(F.broadcast(rule_table(rows.sparkSession, rules)), "rule")
    allowed = found.select("row", "rule", "technique", "name", "rank", "min_events")
    allowed = materialize(allowed.join(rows.select("row", *by), "row") if by else allowed, "hits")
    enough = allowed.groupBy(*by, "rule", "min_events").agg(F.count_distinct("row").alias("n")).where("n >= min_events").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rule").alias("_rule"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("rule") == F.col("_rule"))
    return allowed.join(enough, same, "left_semi").drop("min_events")


def findings(rows: DataFrame, rules: list[Rule], by: list[str] = (), event_id: Column | None = None) -> DataFrame:
    """(by, technique, name, level, evidence_rows, n_rows, first_row, last_row, n_rules): rules with enough rows, merged by technique; the strongest level counts.

    evidence_rows are the first LISTED rows; evidence() has them all, a row each, as one cell could not.
    """
    if len(rules) > COMPILED:
        return _findings_of_many(rows, rules, list(by), event_number(F.col("fields")) if event_id is None else event_id)
    found = evidence(rows, rules, by, event_id).groupBy(*by, "technique", "row").agg(F.min(F.struct("rule", "name")).alias("n"), F.min("rank").alias("rank"), F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_rules") if len(rules) <= 63 else F.collect_set("rule").alias("_rules"))
    found = materialize(found, "found")
    first = _listed(found, by)
    n_rules = F.bit_count(F.bit_or("_rules")).cast("bigint") if len(rules) <= 63 else F.size(F.array_distinct(F.flatten(F.collect_set("_rules")))).cast("bigint")
    merged = found.groupBy(*by, "technique").agg(F.min("n").alias("n"), F.min("rank").alias("rank"), F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), n_rules.alias("n_rules"))
    right = first.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("technique").alias("_technique"), "evidence_rows")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("technique") == F.col("_technique"))
    return merged.join(right, same).select(*by, "technique", F.col("n.name").alias("name"), F.get(F.array(*map(F.lit, LEVELS)), F.col("rank")).alias("level"), "evidence_rows", "n_rows", "first_row", "last_row", "n_rules")


def _listed(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, technique, evidence_rows): the first LISTED rows of found(by, technique, row)."""
    place = F.row_number().over(Window.partitionBy(*by, "technique").orderBy("row"))
    return found.withColumn("_n", place).where(F.col("_n") <= LISTED).groupBy(*by, "technique").agg(F.array_sort(F.collect_list("row")).alias("evidence_rows"))


def _findings_of_many(rows: DataFrame, rules: list[Rule], by: list[str], event_id: Column) -> DataFrame:
    """findings for a book of many rules, whose hits are many times the rows: a row's rules stay one array but where they are counted, and names, levels and numbers of rules come from those that have enough rows."""
    bound = [i for i, r in enumerate(rules) if needs_broken_control(r.technique)]
    each = rulebook.by_row(rows, rules, event_id, bool(bound))
    if bound:
        each = each.withColumn("rules", F.filter("rules", lambda r: ~r.isin(bound) | (F.col("polarity") == "breaking")))
    # rows of one name are one, and passes meet
    held = each.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
    held = materialize(held.join(rows.select("row", *by).distinct(), "row") if by else held, "hits")
    same = lambda a, b, names: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in names])
    renamed = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])
    single = held.select("row", *by, F.explode("rules").alias("rule"))
    numbers = single.groupBy(*by, "rule").agg(F.count("row").alias("n"))
    enough = materialize(numbers.join(F.broadcast(rule_table(rows.sparkSession, rules)), "rule").where("n >= min_events").select(*by, "rule", "technique", "name", "rank"), "enough")
    merged = enough.groupBy(*by, "technique").agg(F.min(F.struct("rule", "name")).alias("n"), F.min("rank").alias("rank"), F.count("*").alias("n_rules"))
    right = renamed(enough.select(*by, "rule", "technique"))
    # without groups there are as many of these as rules at most
    met = single.join(right if by else F.broadcast(right), same(single, right, [*by, "rule"]))
    found = materialize(met.select("row", *by, F.col("_technique").alias("technique")).distinct(), "found")
    numbered = renamed(found.groupBy(*by, "technique").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row")))
    listed = renamed(_listed(found, by)).withColumnsRenamed({f"_{c}": f"__{c}" for c in [*by, "technique"]})
    out = merged.join(numbered, same(merged, numbered, [*by, "technique"]))
    out = out.join(listed, reduce(lambda x, y: x & y, [out[c].eqNullSafe(listed[f"__{c}"]) for c in [*by, "technique"]]))
    return out.select(*by, "technique", F.col("n.name").alias("name"), F.get(F.array(*map(F.lit, LEVELS)), F.col("rank")).alias("level"), F.col("_evidence_rows").alias("evidence_rows"), F.col("_n_rows").alias("n_rows"), F.col("_first_row").alias("first_row"), F.col("_last_row").alias("last_row"), "n_rules")


def coverage(rows: DataFrame, rules: list[Rule], event_id: Column) -> DataFrame:
    """(tactic, present, missing, assessable): of the ids that the tactic's rules need, those seen and those not; ids in the order of their text."""
    spark = rows.sparkSession
    needed = spark.createDataFrame(sorted({(r.tactic, i) for r in rules for i in r.required}), "tactic string, id string")
    seen = rows.select(event_id.alias("id")).where("id is not null").distinct().withColumn("seen", F.lit(True))
    g = needed.join(seen, "id", "left")
    part = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    return g.groupBy("tactic").agg(part(F.col("seen").isNotNull()).alias("present"), part(F.col("seen").isNull()).alias("missing")).withColumn("assessable", F.size("present") > 0)


def log_source(event_id: Column) -> Column:
    """The source of an id: single ids before ranges, the first range that holds it; unknown otherwise."""
    n = event_id.try_cast("int")
    chain = F.when(event_id.isNull(), F.lit(None).cast("string"))
    for i, name in catalog.SOURCE_IDS.items():
        chain = chain.when(event_id == i, name)
    for low, high, name in catalog.SOURCE_RANGES:
        chain = chain.when(n.between(low, high), name)
    return chain.otherwise("unknown")


def criticality(paths: DataFrame, assets: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """paths(row, path) with level and family of the longest asset path that covers each; unknown if none does.

    All beginnings of a path at segment bounds are looked up by equality, so the join grows with the paths and not with paths times assets. A path without a hive
    is tried below HKLM and HKCU; a user's own hive counts as HKCU, whoever the user is.
    """
    spark = paths.sparkSession
    raw = spark.createDataFrame([(i, *a) for i, a in enumerate(assets or catalog.ASSETS)], "n int, pattern string, level string, family string")
    table = raw.withColumn("pattern", asset_path(F.col("pattern"))).where(F.contains("pattern", F.lit("\\"))).withColumn("len", F.length("pattern"))
    norm = paths.withColumn("norm", asset_path(F.col("path")))
    tried = F.when(F.col("norm").rlike(r"^HK[A-Z]+(\\|$)"), F.array("norm")).otherwise(F.transform(F.array(F.lit("HKLM\\"), F.lit("HKCU\\")), lambda h: F.concat(h, F.col("norm"))))
    full = norm.select("row", "path", F.explode_outer(tried).alias("full"))
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("full", r"\\"))), lambda i: F.array_join(F.slice(F.split("full", r"\\"), 1, i), "\\"))
    exploded = full.select("row", "path", F.explode_outer(heads).alias("pattern")).join(F.broadcast(table), "pattern", "left")
    best = F.max(F.struct("len", (-F.col("n")).alias("o"), "level", "family")).alias("b")
    return exploded.groupBy("row", "path").agg(best).select("row", "path", F.coalesce("b.level", F.lit("unknown")).alias("level"), F.col("b.family").alias("family"))
