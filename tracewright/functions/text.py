"""Scalar functions over columns of log text, all from built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewright.sources import catalog


# White space of ASCII.
WHITE = " \t\n\x0b\f\r"


def norm_key(c: Column) -> Column:
    """A field's name without blanks and underscores, in lower case."""
    return F.lower(F.regexp_replace(c, r"[\s_]+", ""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(c, F.lit(WHITE))


def ends_trimmed(c: Column, chars: str = WHITE) -> Column:
    """Without these characters at the end. A trim of given characters lays out its whole text before it looks at the end, so blanks go first, and only a text that ends in another is trimmed."""
    rest = chars.replace(" ", "")
    return let(F.rtrim(c) if rest != chars else c, lambda v: F.when(reduce(lambda a, b: a | b, [F.endswith(v, F.lit(x)) for x in rest]), F.rtrim(v, F.lit(chars))).otherwise(v))


def stripped_long(c: Column) -> Column:
    """stripped, for texts that may be long."""
    return ends_trimmed(F.ltrim(c, F.lit(WHITE)))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: in a lambda it would be computed again for every element."""
    return F.transform(F.array(value), use)[0]


def last_of_each(pairs: Column, key: str, value: str) -> Column:
    """Of pairs with the same key the last value, at the first one's place. By sorting, so that a million pairs are no trouble."""
    one = lambda i, p: F.struct(p[key].alias("k"), i.alias("i"), p[value].alias("v"))

    def settled(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["k"].eqNullSafe(F.get(s, b)["k"]), F.lit(False))
        first = F.filter(s, lambda x, i: (i == 0) | ~same(i, i - 1))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | ~same(i, i + 1))
        placed = F.array_sort(F.zip_with(first, last, lambda a, b: F.struct(a["i"].alias("i"), a["k"].alias("k"), b["v"].alias("v"))))
        return F.transform(placed, lambda x: F.struct(x["k"].alias(key), x["v"].alias(value)))

    return let(F.array_sort(F.transform(pairs, lambda p, i: one(i, p))), settled)


def first_of_each(pairs: Column, key: str, value: str) -> Column:
    """The first of the pairs with the same key, in their order. By sorting, as last_of_each."""

    def settled(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | ~F.coalesce(F.get(s, i - 1)["k"].eqNullSafe(x["k"]), F.lit(False)))
        placed = F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), x["v"].alias("v"))))
        return F.transform(placed, lambda x: F.struct(x["k"].alias(key), x["v"].alias(value)))

    return let(F.array_sort(F.transform(pairs, lambda p, i: F.struct(p[key].alias("k"), i.alias("i"), p[value].alias("v")))), settled)


def runs_after(pieces: Column, opens, between: str = "") -> Column:
    """An array of structs (head, rest): each piece for which opens(piece) is true, and what follows it up to the next such piece, joined by between. What stands before the first is left out."""

    def of(p: Column, at: Column) -> Column:
        rest = lambda a, b: F.array_join(F.slice(p, a + 2, b - a - 1), between)
        return F.transform(at, lambda a, j: F.struct(F.get(p, a).alias("head"), rest(a, F.coalesce(F.get(at, j + 1), F.size(p))).alias("rest")))

    places = lambda p: F.filter(F.transform(p, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull())
    return let(pieces, lambda p: let(places(p), lambda at: of(p, at)))


def present(c: Column) -> Column:
    """The stripped value, or null if it is empty or says nothing."""
    v = stripped(c)
    return F.when(~F.lower(v).isin(catalog.NON_INFORMATIVE), v)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[present(c) for c in cs])


def basename(c: Column) -> Column:
    """The last part of a path with either slash; trailing slashes don't count."""
    return F.regexp_extract(F.rtrim(F.regexp_replace(c, r"[\\/]+$", "")), r"([^\\/]*)$", 1)


def unescape(c: Column) -> Column:
    """Backslash escapes of a quoted value undone."""
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r'\\([\\"])', "$1")).otherwise(c)


def format_value(c: Column) -> Column:
    """A cell as a value of key=value text: whole floats without .0, quoted and escaped if it has white space; null and blank give null."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"^(-?\d+)\.0$", "$1")
    quoted = F.concat(F.lit('"'), F.regexp_replace(s, r'([\\"])', r"\\$1"), F.lit('"'))
    return F.when((s == "") | s.isNull(), F.lit(None)).when(s.rlike(r"\s"), quoted).otherwise(s)


def registry_path(c: Column) -> Column:
    """One spelling of a registry path: hive shortened (the longest spelling first, once), single backslashes, no noise segments, upper case. Null for blank."""
    p = F.regexp_replace(F.translate(F.trim(c), "/", "\\"), r"\\{2,}", r"\\")
    spellings = sorted(((a, k) for k, names in catalog.HIVES.items() for a in names), key=lambda x: -len(x[0]))
    hit = lambda a: rf"(?i)(?<![A-Za-z0-9_]){re.escape(a)}(?![A-Za-z0-9_])"
    chosen = reduce(lambda rest, ak: F.when(p.rlike(hit(ak[0])), F.concat(F.regexp_extract(p, rf"(?is)^(.*?){hit(ak[0])}", 1), F.lit(ak[1]), F.regexp_extract(p, rf"(?is)^.*?{hit(ak[0])}(.*)$", 1))).otherwise(rest), reversed(spellings), p)
    segments = F.filter(F.split(F.upper(chosen), r"\\"), lambda s: (F.trim(s) != "") & ~s.isin([n.upper() for n in catalog.NOISE_SEGMENTS]))
    for pattern, name in catalog.SEGMENT_PATTERNS:
        segments = F.transform(segments, _renamed(pattern, name.upper()))
    return F.nullif(F.trim(F.array_join(segments, "\\")), F.lit(""))


def asset_path(c: Column) -> Column:
    """A registry path as assets are compared: its one spelling, where HKU and HKCU are the same hive and a user's security id behind it is left out, so that each user's key is one asset."""
    p = F.regexp_replace(registry_path(c), r"^HKU(?=\\|$)", "HKCU")
    return F.regexp_replace(p, r"^(HK[A-Z]+)\\S-1-[0-9-]++(?:_CLASSES)?(?=\\|$)", "$1")


def _renamed(pattern: str, name: str):
    return lambda s: F.when(s.rlike(f"(?i)^{pattern}$"), name).otherwise(s)


def looks_like_registry(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^\\?(hklm|hkcu|hkcr|hku|hkcc|hkey_[a-z_]+|\\?registry\\(machine|user))(:|\\|$)")


def path_covers(pattern: Column, path: Column) -> Column:
    """Whether path is pattern or lies below it; a bare hive covers nothing."""
    return F.contains(pattern, F.lit("\\")) & ((path == pattern) | F.startswith(path, F.concat(pattern, F.lit("\\"))))


def polarity(c: Column) -> Column:
    """Whether a text tells of a control at work, of one broken, of both or of neither."""
    any_of = lambda ps: F.coalesce(c.rlike("(?i)" + "|".join(ps)), F.lit(False))
    on, off = any_of(catalog.ENFORCING), any_of(catalog.BREAKING)
    return F.when(on & off, "ambiguous").when(on, "enforcing").when(off, "breaking").otherwise("neutral")


# Techniques that impair defences.
IMPAIRING = r"^(T1562|T1685|T1686)"


def evidence_allowed(technique: Column, polarity_: Column) -> Column:
    """Techniques that impair defences take evidence of broken controls alone."""
    return ~technique.rlike(IMPAIRING) | (polarity_ == "breaking")


def needs_broken_control(technique: str) -> bool:
    """evidence_allowed's condition for a name that is known beforehand."""
    return re.match(IMPAIRING, technique) is not None


def mask_value(c: Column) -> Column:
    """A mask in hex or decimal as a number; null if it is neither."""
    h = F.regexp_extract(F.trim(c), r"^0[xX]([0-9A-Fa-f]{1,15})$", 1)
    return F.coalesce(F.when(h != "", F.conv(h, 16, 10).cast("bigint")), F.regexp_extract(F.trim(c), r"^(\d{1,18})$", 1).try_cast("bigint"))


def mask_bits(mask: Column, family: str) -> Column:
    """The bits of a numeric mask as an array of structs of name and class, standard rights last."""
    known = [*catalog.MASKS.get(family, []), *(catalog.MASKS["standard"] if family != "standard" else [])]
    table = F.array(*[F.struct(F.lit(b).cast("bigint").alias("bit"), F.lit(n).alias("name"), F.lit(k).alias("kind")) for b, n, k in known])
    return F.filter(table, lambda t: mask.bitwiseAND(t["bit"]) == t["bit"])


def name_tokens(c: Column) -> Column:
    """The words of a right's name in lower case, sorted, once each: what is in brackets and alternatives behind a slash don't count; words end at blanks, _ and -, and before a capital after a small letter."""
    plain = F.substring_index(F.regexp_replace(c, r"\([^)]*+\)", " "), "/", 1)
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(plain, "([a-z0-9])(?=[A-Z])", "$1 ")), r"[\s_\-]++"), lambda w: w != "")))


def known_bits(family: str | None) -> list[tuple[int, str, str]]:
    """Bits of a family and the standard rights; of all families for None. A name stands once."""
    rows = [*catalog.MASKS.get(family, []), *catalog.MASKS["standard"]] if family else [r for f in catalog.MASKS.values() for r in f]
    return list({n: (b, n, k) for b, n, k in rows}.values())


def access_bit(name: Column, family: str | None) -> Column:
    """Struct (name, kind) of the bit that a right's name means: the only one whose words are the same, else the only one whose words contain all of its words. Null if several might be meant, or none."""
    split = lambda n: sorted({w for w in n.lower().split("_") if w})
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.array(*map(F.lit, split(n))).alias("words")) for _, n, k in known_bits(family)])
    alias = F.create_map(*[F.lit(x) for kv in catalog.ACCESS_ALIASES.items() for x in kv])[F.lower(F.regexp_replace(name, r"[\s_\-]++", ""))]

    def meant(words: Column) -> Column:
        equal = F.filter(table, lambda b: b["words"] == words)
        larger = F.filter(table, lambda b: (F.size(words) < F.size(b["words"])) & (F.size(F.array_except(words, b["words"])) == 0))
        found = F.when(F.size(equal) == 1, equal[0]).when((F.size(words) > 0) & (F.size(larger) == 1), larger[0])
        return F.coalesce(F.get(F.filter(table, lambda b: b["name"] == alias), F.lit(0)), found)

    one = let(name_tokens(name), meant)
    return F.when(one.isNotNull(), F.struct(one["name"].alias("name"), one["kind"].alias("kind")))


def access_class(bits: Column) -> Column:
    """write if any bit writes, else read if any reads, else unknown."""
    return F.when(F.exists(bits, lambda b: b["kind"] == "write"), "write").when(F.size(bits) > 0, "read").otherwise("unknown")


def estimated_tokens(c: Column) -> Column:
    """1.3 a word, half-way cases to the even number, 1 at least."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(F.round(words * 1.3, 6), 0).cast("int"))


def evidence_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def hundredths(c: Column) -> Column:
    """How many hundredths a double of 0 or more prints with two places, by its exact binary value with half to even: 0.605 lies just below the half, and is 60. A decimal rounding would take it for the half."""
    half, mask = 30, (1 << 30) - 1

    def of(x: Column) -> Column:
        bits = ((x - F.floor(x)) * float(1 << 60)).cast("bigint")  # exact, as a fraction that can lie near a half has no bit below 2^-60
        low = bits.bitwiseAND(F.lit(mask).cast("bigint")) * 100
        high = F.shiftright(bits, half) * 100 + F.shiftright(low, half)
        n, rest = F.shiftright(high, half), F.shiftleft(high.bitwiseAND(F.lit(mask).cast("bigint")), half) + low.bitwiseAND(F.lit(mask).cast("bigint"))
        up = (rest > (1 << 59)) | ((rest == (1 << 59)) & (n % 2 == 1))
        return F.floor(x).cast("bigint") * 100 + n + up.cast("bigint")

    return let(c.cast("double"), of)


def quoted_share(quote: Column, text: Column) -> Column:
    """Share of the quote's words of over three letters that the text contains; 1 without such words."""
    words = F.filter(F.split(F.lower(quote), r"\s+"), lambda w: F.length(w) > 3)
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(hit / F.size(words))


def ip_number(c: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    m = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    parts = [F.regexp_extract(F.trim(c), m, i).try_cast("int") for i in range(1, 5)]
    fine = reduce(lambda a, b: a & b, [p.between(0, 255) for p in parts])
    return F.when(fine, sum(p.cast("bigint") * (1 << s) for p, s in zip(parts, (24, 16, 8, 0), strict=True)))


# IPv4 blocks that are not public, as first address and prefix length.
_RESERVED = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def is_public_ip(c: Column) -> Column:
    """Whether an IPv4 address is routed publicly; false for what is no address."""
    n = ip_number(c)
    blocks = [(int.from_bytes(bytes(map(int, a.split("."))), "big"), p) for a, p in _RESERVED]
    inside = reduce(lambda x, y: x | y, [n.between(a, a + (1 << (32 - p)) - 1) for a, p in blocks])
    return F.coalesce(~inside, F.lit(False))


def shortened(c: Column, most: int = 200) -> Column:
    """At most so many characters, cut at the last blank, with an ellipsis if cut."""
    head = F.regexp_replace(F.substring(c, 1, most), r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, r"[.,;: ]+$", ""), F.lit("...")))


# Spellings of registry roots.
_ROOT = re.compile(r"(?i)(hkey_[a-z_]+|hk(lm|cu|cr|cc|u))(:?\\|$)|\\registry\\")
_WORDS = re.compile(r"""("[^"]*"|'[^']*'|[^\s"']+)(\s*)""")
# Verbs that take a file after the path.
_TWO_ARGUMENTS = {"save", "restore", "load", "export", "copy", "compare"}


def registry_paths_of(line: str | None) -> list[str]:
    """Registry paths in a command line, quoted ones first, once each; bare hives are none.

    A quoted word is a path as it stands. Another path takes the words after it too, up to one that can't belong to it: a
    quoted word, a flag, the beginning of another path, or a file's name. After a verb with two arguments, the last word of a path that ends the line is the other argument.
    """
    words = [m[1] for m in _WORDS.finditer(line or "")]
    two = any(re.fullmatch(r"(?i)(.*[\\/])?reg(\.exe)?", a) and b.lower() in _TWO_ARGUMENTS for a, b in zip(words, words[1:], strict=False))
    quoted, bare, i = [], [], 0
    while i < len(words):
        w, i = words[i], i + 1
        if w[0] in "\"'":
            quoted += [w[1:-1]] * bool(_ROOT.match(w[1:-1]))
        elif _ROOT.match(w):
            path = [w]
            while i < len(words) and not _ends_path(words[i]):
                path.append(words[i])
                i += 1
            bare.append(" ".join(path[:-1] if two and i == len(words) and len(path) > 1 else path))
    return list(dict.fromkeys(p for p in map(_tidy, quoted + bare) if "\\" in p.strip("\\")))


def _ends_path(word: str) -> bool:
    flag = word[0] in "-/" and word[1:2].isalpha() or word[0] in "\"'"
    another = _ROOT.match(word) or word.startswith("\\\\") or word[1:2] == ":" and word[2:3] in ("\\", "/")
    stem, dot, ending = word.rpartition(".")
    return bool(flag or another or (dot and stem and "\\" not in word and ending.isalnum() and len(ending) <= 5))


def _tidy(path: str) -> str:
    hive, rest = path.split("\\", 1) if "\\" in path else (path, "")
    return f"{hive.rstrip(':')}\\{rest}".rstrip(",;)").rstrip("\\ ")


def command_registry_paths(c: Column) -> Column:
    """registry_paths_of each command line, as an array; none for null. Words and quotes need a scan with state, so lines go to Python in Arrow batches."""
    return _registry_paths(c)


@F.pandas_udf(ArrayType(StringType()))
def _registry_paths(lines: pd.Series) -> pd.Series:
    return lines.map(registry_paths_of)


def trusted_folder(path: Column) -> Column:
    """Whether a program's folder, its drive aside, is trusted or below a trusted one; a name without folder is not."""
    folder = F.lower(F.regexp_replace(F.regexp_extract(F.translate(F.trim(path), '/"', "\\"), r"^(.*)\\[^\\]*$", 1), r"^[A-Za-z]:", ""))
    inside = [(folder == t.lower()) | F.startswith(folder, F.lit(t.lower() + "\\")) for t in catalog.TRUSTED]
    return F.coalesce(reduce(lambda a, b: a | b, inside), F.lit(False))
