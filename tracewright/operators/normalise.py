"""From fields to one row an event: platform, tools, actions, assets, access, search text, what is missing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.text import access_bit, access_class, first_of_each, let, name_tokens, first_present, mask_bits, mask_value, registry_path
from tracewright.sources import catalog

#: Rows that an entry of a grouped timeline lists.
LISTED = 1_000
# Programs that an analyst wants named.
TOOLS = ["schtasks.exe", "powershell.exe", "cmd.exe", "wmic.exe", "regsvr32.exe", "rundll32.exe", "mshta.exe", "certutil.exe", "psexec", "mimikatz", "net.exe", "netsh", "bitsadmin", "wscript", "cscript"]
# Signs of work on another machine.
REMOTE = ["/s ", "-computername", "/node:", "psexec", "wmiexec", "invoke-command", "winrs", "admin$", "ipc$", "remote system", "remote host", "remotely executed", "remote execution"]
# Words of a platform, in the order that settles ties.
PLATFORMS = {
    "Windows": ["powershell", ".exe", "schtasks", "hkey_", "c:\\", "wmic", "regsvr32", "rundll32", "windows"],
    "Linux": ["/etc/", "bash", "cron", ".sh", "/usr/bin", "syslog", "systemd", "linux"],
    "macOS": [".plist", "launchd", "launchagent", "macos", "osascript"],
}
# Ids that only Windows writes.
WINDOWS_IDS = ["1", "3", "10", "11", "13", "1102", "4104", "4624", "4634", "4656", "4663", "4688", "4697", "5140", "5145", "5156", "7045"]
# What an event says, the field of its target, and a further one.
ACTIONS = {
    "1": ("process created", "process.name", "process.command_line"),
    "3": ("network connection made", "destination.ip", "destination.port"),
    "10": ("memory of another process opened", "target.image", None),
    "11": ("file created", "file.name", None),
    "13": ("registry value changed", "object.name", None),
    "1102": ("audit log cleared", None, None),
    "4104": ("script block run", None, "script.block_text"),
    "4624": ("logon", "account.name", "logon.type"),
    "4656": ("handle to an object asked for", "object.name", "access.list"),
    "4663": ("object accessed", "object.name", "access.list"),
    "4688": ("process created", "process.name", "process.command_line"),
    "5140": ("network share accessed", "share.name", None),
    "5156": ("network connection made", "destination.ip", "destination.port"),
    "7045": ("service installed", "service.name", None),
}


def platform(event_id: Column, text: Column) -> Column:
    """Windows for its own ids; else the platform with most of its words in the text, of equals the first; null for none."""
    low = F.lower(text)
    n = {p: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words]) for p, words in PLATFORMS.items()}
    most = F.greatest(*n.values())
    chain = F.when(F.coalesce(event_id.isin(WINDOWS_IDS), F.lit(False)), "Windows")
    for p, c in n.items():
        chain = chain.when((most > 0) & (c == most), p)
    return chain


def tools(text: Column) -> Column:
    """The tools named as words, with or without .exe."""
    hit = [F.when(text.rlike(rf"(?i)\b{re.escape(t.removesuffix('.exe'))}(?:\.exe)?\b"), F.lit(t)) for t in TOOLS]
    return F.array_compact(F.array(*hit))


def is_remote(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in REMOTE])


def action(event_id: Column, fields: Column) -> Column:
    """What was done to what; null for ids without an action."""
    chain = F.lit(None).cast("string")
    for i, (verb, target, extra) in ACTIONS.items():
        parts = [F.lit(verb), *[first_present(fields[c]) for c in (target, extra) if c]]
        chain = F.when(event_id == i, F.concat_ws(": ", parts[0], F.concat_ws(" ", *parts[1:])) if len(parts) > 1 else parts[0]).otherwise(chain)
    return F.regexp_replace(chain, r": $", "")


def missing_fields(event_id: Column, fields: Column) -> Column:
    """Fields that say most about such an event and that it doesn't have."""
    chain = F.array().cast("array<string>")
    for i, (_, _, _, names) in catalog.EVENTS.items():
        chain = F.when(event_id == i, F.array_compact(F.array(*[F.when(first_present(fields[n]).isNull(), F.lit(n)) for n in names])) if names else chain).otherwise(chain)
    return chain


def access(event_id: Column, fields: Column) -> Column:
    """Struct of access, requested and source. The mask counts before the names, and both before the event's own class; what an event only asks for is
    requested, not done. Names that no bit has make the access unknown."""
    kind = F.lower(fields["object.type"])
    mask = mask_value(fields["access.mask"])
    family = {f: kind.isin([k for k, v in catalog.OBJECT_TYPES.items() if v == f]) for f in catalog.MASKS}
    by_mask = F.coalesce(*[F.when(c, access_class(mask_bits(mask, f))) for f, c in family.items() if f != "standard"], access_class(mask_bits(mask, "standard")))
    names = F.filter(F.transform(F.split(fields["access.list"], r"[|,;\r\n]|[ \t]{2,}"), F.trim), lambda x: x != "")

    def class_of(name: Column) -> Column:
        by_type = F.coalesce(*[F.when(c, access_bit(name, f)["kind"]) for f, c in family.items()])
        return F.coalesce(F.when(reduce(lambda a, b: a | b, family.values()), by_type).otherwise(access_bit(name, None)["kind"]), F.lit("unknown"))

    classes = F.transform(names, class_of)
    by_name = F.when(F.size(names) > 0, F.when(F.array_contains(classes, "write"), "write").when(F.array_contains(classes, "unknown"), "unknown").otherwise("read"))
    default = F.lit(None).cast("string")
    done = F.lit(True)
    for i, (kind_, realised, _, _) in catalog.EVENTS.items():
        default = F.when(event_id == i, F.lit(kind_)).otherwise(default)
        done = F.when(event_id == i, F.lit(realised)).otherwise(done)
    seen = F.when(mask.isNotNull(), by_mask).otherwise(by_name)
    source = F.when(mask.isNotNull(), "mask").when(by_name.isNotNull(), "names").otherwise("event")
    return F.struct(F.when(done & seen.isNotNull(), seen).otherwise(default).alias("access"), F.when(~done, seen).alias("requested"), source.alias("source"))


def access_names(names: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """names(row, ord, name, family) with bit, kind and how (equal, contained, alias, ambiguous or unknown), as access_bit tells it, for tables of any size.

    bits(family, bit, kind): the catalogue's unless given; a family of names also has the rights of the family standard. Names and bits meet by their words, so a name is
    held only against bits that share its rarest word; the number of common words then tells equal from contained.
    """
    spark = names.sparkSession
    if bits is None:
        bits = spark.createDataFrame([(f, n, k) for f, rows in catalog.MASKS.items() for _, n, k in rows], "family string, bit string, kind string")
    known = bits.dropDuplicates(["family", "bit"]).select(F.col("family").alias("look"), "bit", "kind", name_tokens(F.lower("bit")).alias("words")).withColumn("size", F.size("words"))
    index = known.select("look", "bit", "kind", "size", "words", F.explode("words").alias("word"))
    often = index.groupBy("look", "word").agg(F.count("*").alias("n"))
    asked = names.select("row", "ord", "name", "family", name_tokens(F.col("name")).alias("asked"))
    both = asked.withColumn("look", F.explode(F.array_distinct(F.array(F.coalesce("family", F.lit("standard")), F.lit("standard")))))
    rare = both.select("row", "ord", "look", F.explode("asked").alias("word")).join(often, ["look", "word"], "left").groupBy("row", "ord", "look").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).select("row", "ord", "look", F.col("r.word").alias("word"))
    met = both.join(rare, ["row", "ord", "look"]).join(index, ["look", "word"]).where(F.size(F.array_except("asked", "words")) == 0)
    equal = F.col("size") == F.size("asked")
    found = met.groupBy("row", "ord").agg(F.count_if(equal).alias("equals"), F.count_if(~equal).alias("larger"), F.min(F.when(equal, F.struct("bit", "kind"))).alias("same"), F.min(F.when(~equal, F.struct("bit", "kind"))).alias("any"))
    alias = F.create_map(*[F.lit(x) for kv in catalog.ACCESS_ALIASES.items() for x in kv])[F.lower(F.regexp_replace("name", r"[\s_\-]++", ""))]
    by_alias = both.withColumn("bit", alias).join(known.select("look", "bit", "kind"), ["look", "bit"]).groupBy("row", "ord").agg(F.min(F.struct("bit", "kind")).alias("told"))
    # bits with the same words are told by none; then the only one that has all of the words and more
    one = F.when(F.col("equals") == 1, F.col("same")).when(F.col("larger") == 1, F.col("any"))
    how = F.when(F.col("told").isNotNull(), "alias").when(F.col("equals") == 1, "equal").when(F.col("larger") == 1, "contained").when(F.col("equals") + F.col("larger") > 0, "ambiguous").otherwise("unknown")
    out = asked.join(found, ["row", "ord"], "left").join(by_alias, ["row", "ord"], "left").withColumn("b", F.coalesce("told", one))
    return out.select("row", "ord", "name", "family", F.col("b.bit").alias("bit"), F.coalesce("b.kind", F.lit("unknown")).alias("kind"), how.alias("how"))


def discriminating(fields: DataFrame, dedup: str = "identical") -> DataFrame:
    """(event_id, ord, name, value) of the long form of parse_fields: values that tell events apart. They are of known fields but ids, no plain numbers, of four letters or more or with a blank or slash, 200 characters at most.

    dedup: none keeps all; identical keeps the first of equal values, letter case aside; contained also drops a value that another one of the event contains.
    """
    worth = F.col("in_schema") & F.col("informative") & ~F.endswith("name", F.lit(".id")) & ~F.col("value").rlike(r"^(0[xX])?[0-9A-Fa-f]+$") & ((F.length("value") >= 4) | F.col("value").rlike(r"[\s/\\]"))
    told = fields.where(worth).select("event_id", "ord", "name", F.substring("value", 1, 200).alias("value"))
    if dedup == "none":
        return told
    once = told.withColumn("_n", F.row_number().over(Window.partitionBy("event_id", F.lower("value")).orderBy("ord", "name"))).where("_n = 1").drop("_n")
    if dedup == "identical":
        return once
    if dedup != "contained":
        raise ValueError(dedup)
    # an event has few fields, so they fit a cell
    others = F.collect_list(F.lower("value")).over(Window.partitionBy("event_id"))
    low = F.lower("value")
    return once.withColumn("_all", others).where(~F.exists("_all", lambda o: (o != low) & F.contains(o, low))).drop("_all")


def semantics(event_id: Column, fields: Column) -> Column:
    """What an event is in general words: its action's verb, its access class and the data components that record it; null if nothing is known of it."""
    verb = parts = F.lit(None).cast("string")
    for i, (name, _, _) in ACTIONS.items():
        verb = F.when(event_id == i, name).otherwise(verb)
    for i, (_, _, components, _) in catalog.EVENTS.items():
        parts = F.when(event_id == i, F.lit(" ".join(components) or None)).otherwise(parts)
    return F.nullif(F.concat_ws(" ", verb, access(event_id, fields)["access"], parts), F.lit(""))


def search_text(fields: DataFrame, raw: DataFrame, rows: DataFrame | None = None, dedup: str = "identical") -> DataFrame:
    """(event_id, query): layers with a blank line between: values that tell events apart and registry paths in one spelling, what the event is in general words, the raw text. Blank layers are left out.

    fields: the long form of parse_fields; raw: event_id, raw; rows: event_id, fields MAP of rule_rows, without which there is no second layer.
    """
    told = discriminating(fields, dedup).select("event_id", "ord", "value")
    path = registry_path(F.col("value"))
    told = told.select("event_id", "ord", F.explode(F.array_compact(F.array("value", F.when(path.rlike(r"^HK[A-Z]{1,2}\\"), path)))).alias("value"))
    once = told.withColumn("_n", F.row_number().over(Window.partitionBy("event_id", F.lower("value")).orderBy("ord", "value"))).where("_n = 1") if dedup != "none" else told
    layer = once.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), " ").alias("told"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = raw.join(layer, "event_id", "left")
    if rows is None:
        return out.select("event_id", F.concat_ws("\n\n", blank(F.col("told")), blank(F.col("raw"))).alias("query"))
    from tracewright.operators.rules import event_number

    means = rows.select("event_id", semantics(event_number(F.col("fields")), F.col("fields")).alias("means"))
    return out.join(means, "event_id", "left").select("event_id", F.concat_ws("\n\n", blank(F.col("told")), blank(F.col("means")), blank(F.col("raw"))).alias("query"))


def enriched(raw: Column, platform_: Column, remote: Column) -> Column:
    """A text with general terms after it: remote work and the platform. Names of techniques are never added, as finding them is the search's task."""
    terms = F.concat_ws(", ", F.when(remote, "remote execution, lateral movement"), platform_)
    return F.when(terms == "", raw).otherwise(F.concat(raw, F.lit("\n\nRelated terms: "), terms))


def facts(raw: Column) -> Column:
    """A map of every key=value pair of a text, the first of a key that says something; of a Message, labelled values fill fields that the pairs leave open."""
    from tracewright.functions.logparse import message_pairs, spaced_pairs
    from tracewright.functions.text import norm_key, present

    older = {re.sub(r"[\s_]+", "", a).lower(): catalog.LEGACY.get(k, a) for k, names in catalog.FIELDS.items() for a in [k, *names]}
    name = F.create_map(*[F.lit(x) for kv in older.items() for x in kv])
    none = F.array().cast("array<struct<key:string,value:string>>")

    def told(pairs: Column) -> Column:
        message = F.get(F.filter(pairs, lambda p: p["key"] == "Message"), F.lit(0))["value"]
        labelled = F.filter(F.transform(F.coalesce(message_pairs(message), none), lambda p: F.struct(name[norm_key(p["key"])].alias("key"), present(p["value"]).alias("value"))), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
        says = lambda p: present(p["value"]).isNotNull()
        return F.map_from_entries(first_of_each(F.concat(F.filter(pairs, says), labelled, F.filter(pairs, lambda p: ~says(p))), "key", "value"))

    return let(F.coalesce(spaced_pairs(raw), none), told)


def normalised(rows: DataFrame) -> DataFrame:
    """One row an event of rows(row, fields MAP): event_id, platform, process, command line, account, tools, remote, action, access, missing."""
    from tracewright.operators.rules import event_number

    f, raw = F.col("fields"), F.col("fields")["Message"]
    i = F.col("event_id")
    return rows.withColumn("event_id", event_number(f)).select(
        "row",
        "event_id",
        platform(i, raw).alias("platform"),
        first_present(f["process.name"]).alias("process"),
        first_present(f["process.command_line"]).alias("command_line"),
        first_present(f["account.name"]).alias("account"),
        tools(raw).alias("tools"),
        is_remote(raw).alias("remote"),
        action(i, f).alias("action"),
        access(i, f).alias("access"),
        missing_fields(i, f).alias("missing"),
    )


def grouped_timeline(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, sentence, n, first_ts, last_ts, rows): entries that say the same as one, with the first LISTED of their rows in order; timeline_rows has them all."""
    key = [*by, "sentence"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("row"))
    first = entries.select(*key, "row").withColumn("_n", place).where(F.col("_n") <= LISTED).groupBy(*key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    right = first.select(*[F.col(c).alias(f"_{c}") for c in key], "rows")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return entries.groupBy(*key).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).join(right, same).select(*key, "n", "first_ts", "last_ts", "rows")


def timeline_rows(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, sentence, place, row, ts): every row of every entry of grouped_timeline, a row each, numbered within its entry."""
    key = [*by, "sentence"]
    return entries.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("row")).alias("place"), "row", "ts")


# Words before a value in running text, for logs that no format fits.
_LAST = {
    "process": r"(?i)\b(?:new process name|process name|newprocessname|image)\s*+[:=]\s*+(\"[^\"\n]++\"|[^\s,;{}]++)",
    "command_line": r"(?i)\b(?:process command line|command line|commandline)\s*+[:=]\s*+(\"(?:[^\"\\\n]++|\\.)*+\"|[^\n]++)",
    "account": r"(?i)\b(?:account name|subjectusername|user name|username|user)\s*+[:=]\s*+(\"[^\"\n]++\"|[^\s,;{}]++)",
}
_FACT_NAMES = {"process": ("process.name", "NewProcessName"), "command_line": ("process.command_line", "CommandLine"), "account": ("account.name", "SubjectUserName")}


def by_authority(events: DataFrame) -> DataFrame:
    """(event_id, format, id, process, process_from, command_line, command_line_from, account, account_from, facts MAP) of events(event_id, raw).

    A value comes from the format's own fields, else from the text's pairs and labels (facts), else from words in running text; <value>_from says which: fields, facts or text. facts
    are the fields under their own and older names; where the format is key=value or none, pairs and labels of the text fill what these leave open. So a parser's whole value is never covered by a cut one.
    """
    from tracewright.functions.logparse import parse_fields
    from tracewright.functions.text import unescape
    from tracewright.operators.rules import event_number

    older = F.create_map(*[F.lit(x) for kv in catalog.LEGACY.items() for x in kv])
    parsed = parse_fields(events).where("informative or not in_schema")
    named = parsed.select("event_id", "format", F.explode(F.array_compact(F.array(F.struct(F.col("name").alias("key"), "value", "ord"), F.when(older[F.col("name")].isNotNull(), F.struct(older[F.col("name")].alias("key"), "value", "ord"))))).alias("x"))
    once = named.groupBy("event_id", "x.key").agg(F.min(F.struct("x.ord", "x.value")).alias("v"), F.first("format").alias("format"))
    own = once.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("v.value")))).alias("own"), F.first("format").alias("format"))
    e = events.select("event_id", F.coalesce("raw", F.lit("")).alias("raw")).join(own, "event_id", "left").withColumn("own", F.coalesce("own", F.create_map().cast("map<string,string>")))
    loose = F.col("format").isNull() | (F.col("format") == "space_kv")
    known = F.map_filter("own", lambda k, _: ~F.startswith(k, F.lit("unknown.")) | ~loose)
    e = e.withColumn("own", known).withColumn("_told", F.when(loose, facts(F.col("raw"))).otherwise(F.create_map().cast("map<string,string>")))
    e = e.withColumn("facts", F.map_concat("own", F.map_filter("_told", lambda k, _: ~F.map_contains_key("own", k)))).withColumn("id", event_number(F.map_concat(F.map_filter("own", lambda k, _: k != "Message"), F.create_map(F.lit("Message"), F.col("raw")))))

    def best(name: str) -> list[Column]:
        field, fact = _FACT_NAMES[name]
        found = F.nullif(F.trim(F.regexp_extract("raw", _LAST[name], 1)), F.lit(""))
        bare = F.when(F.startswith(found, F.lit('"')) & F.endswith(found, F.lit('"')) & (F.length(found) > 1), unescape(F.substring(found, F.lit(2), F.length(found) - 2))).otherwise(found)
        # labels of a Message give their values under canonical names where no older name stands
        bare = first_present(bare)
        first, second = first_present(F.col("own")[field]), first_present(F.col("facts")[fact], F.col("facts")[field])
        return [F.coalesce(first, second, bare).alias(name), F.when(first.isNotNull(), "fields").when(second.isNotNull(), "facts").when(bare.isNotNull(), "text").alias(f"{name}_from")]

    return e.select("event_id", "format", "id", *[c for name in _FACT_NAMES for c in best(name)], "facts")
