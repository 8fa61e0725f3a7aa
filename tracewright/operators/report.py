"""Incidents as text: Markdown, diagrams, rule drafts and one-sentence accounts. Every text is made by expressions, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.text import basename, first_present, hundredths, let
from tracewright.operators.incident import HIGH_RISK, primary_tactic, tactic_rank
from tracewright.operators.normalise import ACTIONS
from tracewright.sources import catalog


def sentence(fields: Column, verb: Column) -> Column:
    """Who did what to what, from a row's fields; null if neither actor nor target is known."""
    actor = first_present(fields["process.name"], basename(fields["process.path"]), fields["account.name"])
    target = first_present(fields["object.name"], fields["target.image"], fields["service.name"], fields["share.name"], fields["file.path"], F.concat_ws(":", fields["destination.ip"], fields["destination.port"]))
    short = lambda c: F.when(F.length(c) > 70, F.concat(F.substring(c, 1, 67), F.lit("..."))).otherwise(c)
    return F.when(actor.isNotNull() | target.isNotNull(), F.concat_ws(" ", short(actor), verb, short(target)))


# Fields of who acts and of what is acted on, the first that an event has counts; and the port that belongs to an address.
ACTORS = ["process.name", "process.path", "account.name"]
TARGETS = ["object.name", "target.image", "service.name", "share.name", "file.path", "destination.ip", "source.ip", "host.name"]
PORTS = {"destination.ip": "destination.port", "source.ip": "source.port"}


def told_of(event_id: Column, fields: Column, ts: Column) -> Column:
    """What happened in one event: time of day, who, what was acted on, what was done, the id. Only the fields that say most about such an event (catalog.EVENTS) are looked at; null if the id is unknown or none of them is there.

    A program is named without its folder; a value of over 70 characters is cut and marked; a port that the event tells of follows its address, in brackets if that has colons. Parts that aren't there are left out.
    """
    constant = lambda pairs: F.create_map(*[x for i, v in pairs for x in (F.lit(i), v)])
    said = constant([(i, F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")) for i, (_, _, _, names) in catalog.EVENTS.items()])[event_id]
    done = constant([(i, F.lit(ACTIONS[i][0]).cast("string")) for i in catalog.EVENTS if i in ACTIONS])[event_id]
    names = list(dict.fromkeys([*ACTORS, *TARGETS, *PORTS.values()]))
    # each step's values are computed once: as plain expressions they would stand in the plan once for each use of each use
    known = lambda ids: F.struct(*[F.when(F.array_contains(ids, f), let(F.regexp_replace(fields[f], r"\s++", " "), lambda c: first_present(c))).alias(f"f{n}") for n, f in enumerate(names)])
    short = lambda c: F.when(F.length(c) > 70, F.concat(F.rtrim(F.substring(c, 1, 67)), F.lit("..."))).otherwise(c)

    def parts(v: Column) -> Column:
        of = lambda f: v[f"f{names.index(f)}"]

        def actor(f: str) -> Column:
            return of(f) if f == "account.name" else F.coalesce(F.nullif(basename(of(f)), F.lit("")), of(f))

        def target(f: str) -> Column:
            if f not in PORTS:
                return of(f)
            host = F.when(F.contains(of(f), F.lit(":")), F.concat(F.lit("["), of(f), F.lit("]"))).otherwise(of(f))
            return F.when(of(PORTS[f]).isNotNull(), F.concat(host, F.lit(":"), of(PORTS[f]))).otherwise(of(f))

        return F.struct(F.coalesce(*map(actor, ACTORS)).alias("who"), F.coalesce(*map(target, TARGETS)).alias("what"))

    def line(p: Column) -> Column:
        told = F.concat_ws(" ", F.date_format(ts, "HH:mm"), F.concat_ws(" > ", short(p["who"]), short(p["what"])))
        return F.when(p["who"].isNotNull() | p["what"].isNotNull(), F.concat(F.concat_ws(", ", told, done), F.lit(" ("), event_id, F.lit(")")))

    return let(let(let(said, known), parts), line)


def technique_sentences(techniques: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, technique, sentence) of techniques(by, technique, row, ts), a row for each row that a technique was seen in, and rows(row, fields MAP): what happened in the first of them that rows has. A technique without a sentence isn't listed; a repeated row counts once."""
    from tracewright.operators.rules import event_number

    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("row").orderBy("row"))).where("_n = 1").select("row", "fields")
    seen = techniques.where("technique is not null").join(rows.select("row").distinct(), "row", "left_semi")
    first = seen.groupBy(*by, "technique").agg(F.min("row").alias("row"), F.min("ts").alias("ts"))
    told = first.join(once, "row").withColumn("_id", event_number(F.col("fields")))
    return told.select(*by, "technique", told_of(F.col("_id"), F.col("fields"), F.col("ts")).alias("sentence")).where("sentence is not null")


def chain_line(chain: DataFrame, by: list[str]) -> DataFrame:
    """(by, chain): phases in order, three techniques of each named and the rest counted."""
    named = F.concat(F.array_join(F.slice("techniques", 1, 3), ", "), F.when(F.size("techniques") > 3, F.format_string(" +%d more", F.size("techniques") - 3)).otherwise(""))
    one = chain.select(*by, F.struct("phase", F.concat(F.col("tactic"), F.lit(": "), named).alias("s")).alias("x"))
    return one.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), " -> ").alias("chain"))


def bullets(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("none")


def markdown_text() -> Column:
    """The report of a row with incident, score, severity, n_rows, first_ts, last_ts, chain, techniques ARRAY, indicators ARRAY."""
    return F.concat_ws(
        "\n\n",
        F.format_string("# Incident %s", F.col("incident").cast("string")),
        F.format_string("Risk %d of 100 (%s), %d rows, %s to %s", "score", "severity", "n_rows", F.date_format("first_ts", "yyyy-MM-dd HH:mm"), F.date_format("last_ts", "yyyy-MM-dd HH:mm")),
        F.concat(F.lit("## Attack chain\n"), F.coalesce("chain", F.lit("none"))),
        F.concat(F.lit("## Techniques\n"), bullets(F.col("techniques"))),
        F.concat(F.lit("## Indicators\n"), bullets(F.col("indicators"))),
    )


def markdown(incidents: DataFrame) -> DataFrame:
    """(incident, report) of incidents(incident, score, severity, n_rows, first_ts, last_ts, chain, techniques ARRAY, indicators ARRAY)."""
    return incidents.select("incident", markdown_text().alias("report"))


def mermaid(text: Column) -> Column:
    """Text safe within a diagram's label."""
    return F.regexp_replace(F.regexp_replace(text, '"', "#quot;"), r"[\r\n]+", "<br/>")


def timeline_diagram(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, diagram): a flow chart of entries(by, place, ts, technique) in order."""
    node = F.format_string('  n%d["%s<br/>%s"]', F.col("place").cast("int"), F.coalesce(F.date_format("ts", "MM-dd HH:mm"), F.lit("no time")), mermaid(F.col("technique")))
    edge = F.when(F.col("place") > 1, F.format_string("\n  n%d --> n%d", (F.col("place") - 1).cast("int"), F.col("place").cast("int"))).otherwise("")
    one = entries.select(*by, F.struct("place", F.concat(node, edge).alias("s")).alias("x"))
    return one.groupBy(*by).agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n")).alias("diagram"))


def chain_diagram(chain: DataFrame, by: list[str]) -> DataFrame:
    """(by, diagram): a flow chart of attack_chain's phases in order, a box each with its techniques in it, and an arrow from each box to the next. Techniques and tactics keep their names, safe for labels."""
    box = F.struct("phase", "tactic", "techniques")
    boxes = chain.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def drawn(b: Column, i: Column) -> Column:
        name = F.concat(F.lit("p"), i.cast("string"))
        nodes = F.transform(b["techniques"], lambda t, j: F.concat(F.lit("    "), name, F.lit("t"), j.cast("string"), F.lit('["'), mermaid(F.coalesce(t, F.lit("-"))), F.lit('"]')))
        arrow = F.when(i > 0, F.concat(F.lit("\n  p"), (i - 1).cast("string"), F.lit(" --> "), name)).otherwise("")
        return F.concat(F.lit("  subgraph "), name, F.lit('["'), mermaid(F.coalesce(b["tactic"], F.lit("-"))), F.lit('"]\n'), F.array_join(nodes, "\n"), F.when(F.size(b["techniques"]) > 0, "\n").otherwise(""), F.lit("  end"), arrow)

    return boxes.select(*by, F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform("boxes", drawn), "\n")).alias("diagram"))


def rule_draft(rules: DataFrame) -> DataFrame:
    """rules(name, ids, processes, correlate_by, correlate_value, window_minutes, threshold) with draft: a detection rule in words."""
    same = F.when(F.col("correlate_by").isNotNull(), F.format_string(" with the same %s (%s)", "correlate_by", "correlate_value")).otherwise("")
    programs = F.when(F.size("processes") > 0, F.format_string("\nof programs (%s)", F.array_join("processes", ", "))).otherwise("")
    return rules.withColumn("draft", F.concat(F.format_string("Rule %s\nwhen at least %d events with id in (%s)", "name", "threshold", F.array_join("ids", ", ")), programs, same, F.format_string("\nare seen within %d minutes", "window_minutes")))


def event_rule_draft(events: DataFrame) -> DataFrame:
    """events(technique, name, platform, process, tools ARRAY, command_line, remote_ip, remote, account, event_id, level) with draft, a rule for one event in words; null if it has neither program nor command line nor id."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"\nand {label} "), c))
    tools = F.when((F.size("tools") > 0) & F.col("process").isNull(), F.array_join("tools", " or "))
    parts = [
        F.concat(F.lit("Rule ["), "technique", F.lit("] "), F.coalesce("name", F.lit("?"))),
        line("the platform is", F.col("platform")),
        line("the program is", basename(F.col("process"))),
        line("the program is one of", tools),
        line("the command line contains", F.substring("command_line", 1, 80)),
        F.coalesce(line("the destination is", F.col("remote_ip")), F.when(F.col("remote"), "\nand the destination is the remote machine (not named in the event)")),
        line("the account is", F.col("account")),
        line("the event id is", F.col("event_id")),
        F.when(F.col("level").isin("low", "insufficient"), "\nnote: the technique is not sure, have it checked first"),
    ]
    enough = F.col("process").isNotNull() | (F.size("tools") > 0) | F.col("command_line").isNotNull() | F.col("event_id").isNotNull()
    return events.withColumn("draft", F.when(enough, F.concat_ws("", *parts)))


def risk_breakdown(parts: DataFrame) -> DataFrame:
    """parts of incident.risk_parts with sentences: what each part is made of and what it adds."""
    listed = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    number = lambda c: F.regexp_replace(F.format_string("%.2f", hundredths(c) / 100), r"\.?0+$", "")
    lines = [
        F.concat(F.lit("tactics: "), F.size("tactics").cast("string"), F.lit(" of 15 ("), listed("tactics", "none"), F.lit("), +"), number(F.col("coverage"))),
        F.concat(F.lit("high-risk tactics: "), listed("high_risk", "none"), F.when(F.size("high_risk") > 2, " (at the limit)").otherwise(""), F.lit(", +"), number(F.col("bonus"))),
        F.concat(F.lit("techniques: "), F.col("n_techniques").cast("string"), F.when(F.col("volume") >= 20, " (at the limit)").otherwise(""), F.lit(", +"), number(F.col("volume"))),
        F.concat(F.lit("confidence: mean "), number(F.col("confidence") / 20), F.lit(" x 20, +"), number(F.col("confidence"))),
    ]
    return parts.withColumn("sentences", F.concat_ws("\n", *lines))


def time_window(first: Column, last: Column) -> Column:
    """A span in words: one time, one day with two times, or two days; null without times."""
    full = "yyyy-MM-dd HH:mm:ss"
    return F.when(first == last, F.date_format(first, full)).when(F.to_date(first) == F.to_date(last), F.concat(F.date_format(first, full), F.lit(" to "), F.date_format(last, "HH:mm:ss"))).when(first.isNotNull(), F.concat(F.date_format(first, full), F.lit(" to "), F.date_format(last, full)))


#: Techniques that a phase of a summary names, and lines that each part of a report lists.
NAMED, LINES = 3, 100


def summaries(techniques: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, summary): scope, phases in the kill chain's order, high-risk findings, and how many weak signals are left out.

    techniques: by, technique, tactics, occurrences, strong; spans: by, n_rows, first_ts, last_ts, host, account.
    """
    strong = techniques.where("strong").withColumn("tactic", primary_tactic(F.col("tactics"))).where("tactic is not null")
    order = F.struct((-F.col("occurrences")).alias("o"), F.col("technique").alias("t"), F.format_string("%s (%d rows)", "technique", "occurrences").alias("s"))
    phase = strong.groupBy(*by, "tactic").agg(F.slice(F.array_sort(F.collect_list(order)), 1, NAMED).alias("x"), F.count("*").alias("n"))
    said = F.concat(F.col("tactic"), F.lit(": "), F.array_join(F.transform("x", lambda x: x["s"]), "; "), F.when(F.col("n") > NAMED, F.format_string(" and %d more", F.col("n") - NAMED)).otherwise(""))
    ranked = phase.select(*by, F.struct(tactic_rank(F.col("tactic")).alias("r"), F.col("tactic").alias("t"), said.alias("s")).alias("p"), F.col("tactic").isin(HIGH_RISK).alias("risky"), "n")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["s"]), "\n- ")
    flow = ranked.groupBy(*by).agg(text(F.col("p")).alias("flow"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("risky"), F.col("p")))), lambda p: p["t"]), ", ").alias("risky"), F.count("*").alias("phases"), F.sum("n").alias("n"))
    weak = techniques.groupBy(*by).agg(F.count_if(~F.col("strong")).alias("weak"))
    j = spans.join(flow, by, "left").join(weak, by, "left")
    who = F.concat_ws("", F.concat(F.lit("On "), "host", F.lit(", ")), F.concat(F.lit("by "), "account", F.lit(", ")), F.concat(time_window(F.col("first_ts"), F.col("last_ts")), F.lit(": ")))
    scope = F.concat(who, F.format_string("%d rows in one incident, %d techniques in %d phases.", "n_rows", F.coalesce("n", F.lit(0).cast("bigint")), F.coalesce("phases", F.lit(0).cast("bigint"))))
    parts = [scope, F.concat(F.lit("- "), "flow"), F.when(F.col("risky") != "", F.concat(F.lit("High risk: "), "risky", F.lit("."))), F.when(F.col("weak") > 0, F.format_string("%d weak signals are left out.", "weak"))]
    return j.select(*by, F.when(F.coalesce("n", F.lit(0)) > 0, F.concat_ws("\n\n", *parts)).otherwise("No technique has enough evidence.").alias("summary"))


def _listed(rows: DataFrame, by: list[str], order: list[str], line: Column, name: str) -> DataFrame:
    """(by, name): the first LINES lines of each group in order, and how many more there are."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = rows.withColumn("_l", line).withColumn("_n", place).where(F.col("_n") <= LINES).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"]), "\n").alias("_t"))
    total = rows.groupBy(*by).agg(F.count("*").alias("_c"))
    return first.join(total, by).select(*by, F.concat("_t", F.when(F.col("_c") > LINES, F.format_string("\nand %d more", F.col("_c") - LINES)).otherwise("")).alias(name))


def incident_reports(spans: DataFrame, techniques: DataFrame, timeline: DataFrame, indicators: DataFrame, risk: DataFrame, parts: DataFrame, chain: DataFrame, by: list[str]) -> DataFrame:
    """(by, report): the whole report of an incident, a section each for summary, risk, time line, chain, matrix, weak signals and indicators by category.

    spans: by, n_rows, first_ts, last_ts, host, account; techniques: by, technique, tactics, level, occurrences, strong; timeline: by, place, ts, event_id, evidence;
    indicators: by, category, detail, n; risk: by, score, severity; parts: of incident.risk_parts; chain: by, chain. Sections of very many lines list the first LINES.
    """
    entry = F.format_string("- %s id=%s %s", F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit("-")), F.coalesce("event_id", F.lit("-")), F.coalesce("evidence", F.lit("")))
    row = F.format_string("| %s | %s | %s | %d |", "technique", F.array_join("tactics", ", "), F.coalesce("level", F.lit("-")), "occurrences")
    sections = [
        summaries(techniques, spans, by),
        risk_breakdown(parts).select(*by, F.col("sentences").alias("breakdown")),
        _listed(timeline, by, ["place"], entry, "lines"),
        _listed(techniques.where("strong"), by, ["technique"], row, "matrix"),
        _listed(techniques.where("not strong"), by, ["technique"], row, "weak"),
        _listed(indicators, by, ["category", "detail"], F.format_string("- %s: %s (%d)", "category", F.coalesce("detail", F.lit("-")), "n"), "found"),
        risk.select(*by, "score", "severity"),
        chain.select(*by, "chain"),
    ]
    j = spans
    for s in sections:
        j = j.join(s, by, "left")
    part = lambda title, c: F.concat(F.lit(f"## {title}\n"), F.coalesce(c, F.lit("none")))
    head = F.format_string("# Incident %s, host %s, account %s", F.concat_ws("/", *[F.col(c).cast("string") for c in by]), F.coalesce("host", F.lit("-")), F.coalesce("account", F.lit("-")))
    risk_line = F.format_string("Risk %d of 100 (%s), %d rows", F.coalesce("score", F.lit(0)), F.coalesce("severity", F.lit("Low")), "n_rows")
    matrix = F.when(F.col("matrix").isNotNull(), F.concat(F.lit("| technique | tactics | level | rows |\n|-|-|-|-|\n"), "matrix"))
    return j.select(*by, F.concat_ws("\n\n", head, risk_line, part("Summary", F.col("summary")), part("Risk", F.col("breakdown")), part("Time line", F.col("lines")), part("Attack chain", F.col("chain")), part("Matrix", matrix), part("Weak signals", F.col("weak")), part("Indicators", F.col("found"))).alias("report"))
