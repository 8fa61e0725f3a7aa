"""Technique rules as data: thousands of rules of a table over all rows, without an expression for each.

A pattern's required literals, one of which every match contains, are taken from its parse tree. A task builds one automaton a
field out of all rules' literals; a row's values are read once each, the literals found name the candidate rules, ids rule out most of these, and only
the patterns of the rest are tried. A pattern that is one literal, or one word, is settled where the automaton finds it; another is searched once a row, however many rules have it. Rules without a literal are candidates by their ids. The result is that of rules.hits.

A rule whose one condition is one word needs no automaton: a row's words are looked up once each, and what else such rules ask for is told once a row for all that
ask for the same.
"""

from __future__ import annotations

import functools
import pickle
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.text import looks_like_registry, polarity, registry_path

#: Rules that one pass over the rows tests; their table is sent to each task. More rules take more passes.
RULES_A_PASS = 50_000
#: Rules of one word that the same pass tests beside these; a task keeps some 200 bytes of each.
WORDS_A_PASS = 1_000_000
#: Letters of the shortest literal that is looked for.
LETTERS = 3
SCHEMA = "technique string, name string, tactic string, required array<string>, forbidden array<string>, conditions array<array<struct<field:string,must:string,must_not:string>>>, min_events int, level string"

_FOLD = {c: c + 32 for c in range(65, 91)}
#: Bytes of words in lower case and as they are; all others are blanks, those of letters beyond ASCII too.
_WORDS = {fold: bytes(ord(chr(b).lower() if fold else chr(b)) if b < 128 and (chr(b).isalnum() or b == 95) else 32 for b in range(256)) for fold in (True, False)}
_ONE_WORD = re.compile(r"(\(\?i\))?\\b([A-Za-z0-9_]+)\\b")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def fold(text: str) -> str:
    """A-Z in lower case; other letters stay, as patterns without regard to case mean A-Z alone."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def compiled(pattern: str) -> re.Pattern:
    """A pattern with classes, bounds and case of ASCII. One that can't be read is an error."""
    try:
        return re.compile(pattern, re.ASCII)
    except re.error as e:
        raise ValueError(f"{pattern}: {e}") from e


@functools.lru_cache(256)
def _parsed(pattern: str):
    from re import _parser as parser

    return parser.parse(pattern, re.ASCII)


def literals(pattern: str | None) -> frozenset[str] | None:
    """Folded literals one of which is in every text that matches; None if there are none of LETTERS letters."""
    if not pattern:
        return None
    from re import _constants as c

    def better(a, b):
        return a if b is None or a is not None and min(map(len, a)) >= min(map(len, b)) else b

    def of(parsed) -> frozenset[str] | None:
        best, run = None, ""
        for op, arg in [*parsed, (None, None)]:
            if op is c.LITERAL and arg < 128:
                run += chr(arg)
                continue
            if len(run) >= LETTERS:
                best = better(frozenset([fold(run)]), best)
            run = ""
            found = None
            if op is c.SUBPATTERN:
                found = of(arg[-1])
            elif op is c.ATOMIC_GROUP:
                found = of(arg)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
                found = of(arg[2])
            elif op is c.BRANCH:
                sides = [of(x) for x in arg[1]]
                found = frozenset().union(*sides) if all(s is not None for s in sides) else None
            best = better(found, best) if found is not None else best
        return best

    return of(_parsed(pattern))


class Plain(NamedTuple):
    """A pattern that is one literal, with or without a word's bounds at its ends."""

    literal: str
    before: bool
    after: bool
    any_case: bool

    def at(self, text: str, end: int) -> bool:
        """Whether it matches where its folded literal ends, the last letter being at end."""
        begin = end + 1 - len(self.literal)
        if not self.any_case and not text.startswith(self.literal, begin):
            return False
        if self.before and (begin > 0 and text[begin - 1] in _WORD) == (self.literal[0] in _WORD):
            return False
        return not self.after or (end + 1 < len(text) and text[end + 1] in _WORD) != (self.literal[-1] in _WORD)


def plain(pattern: str | None) -> Plain | None:
    """The pattern as a literal of LETTERS letters or more; None if it is more than that."""
    if not pattern:
        return None
    from re import _constants as c

    parsed = _parsed(pattern)
    if parsed.state.flags & ~(re.ASCII | re.IGNORECASE):
        return None
    ops = list(parsed)
    bound = (c.AT, c.AT_BOUNDARY)
    before, after = ops[:1] == [bound], ops[-1:] == [bound]
    inside = ops[before : len(ops) - after]
    if len(inside) < LETTERS or any(op is not c.LITERAL or arg > 127 for op, arg in inside):
        return None
    return Plain("".join(chr(arg) for _, arg in inside), before, after, bool(parsed.state.flags & re.IGNORECASE))


def from_table(table: DataFrame) -> Iterator[list]:
    """Rules of a table of SCHEMA, in the order of its rows, in lists of RULES_A_PASS at most. A null array is empty, a null min_events 1, a null level high."""
    from tracewright.operators.rules import Condition, Rule

    held, same = [], {}
    one = lambda x: same.setdefault(x, x)  # noqa: E731  # what many rules share is kept once
    for r in table.toLocalIterator():
        conditions = tuple(tuple(Condition(one(c.field), c.must, one(c.must_not)) for c in group) for group in r.conditions or [])
        held.append(Rule(one(r.technique), r.name, one(r.tactic), one(tuple(r.required or ())), one(tuple(r.forbidden or ())), conditions, r.min_events or 1, one(r.level or "high")))
        if len(held) == RULES_A_PASS:
            yield held
            held = []
    if held:
        yield held


def one_word(rule) -> tuple[str, bool] | None:
    """(word, any case) of a rule whose one condition asks for this word in a field's value, folded if in any case; None for another rule."""
    if len(rule.conditions) != 1 or len(rule.conditions[0]) != 1:
        return None
    c = rule.conditions[0][0]
    m = _ONE_WORD.fullmatch(c.must or "")
    return (fold(m[2]) if m[1] else m[2], bool(m[1])) if m and not c.on_paths else None


class Words:
    """Rules of one word each, ready for rows. kinds: (field, any case, required, forbidden, must_not), all that they ask for besides; rules: words, and kind and place of each."""

    def __init__(self, kinds: list[tuple], words: list[str], kind_of: array, places: array):
        self.kinds = [(field, frozenset(required), frozenset(forbidden), compiled(no) if no else None) for field, _, required, forbidden, no in kinds]
        self.kind_of, self.places = kind_of, places
        # a word's rule by its index; of a word of several rules, the complement of its index in several
        self.known: dict[tuple[str, bool], dict[bytes, int]] = defaultdict(dict)
        self.several: list[list[int]] = []
        for i, w in enumerate(words):
            known = self.known[kinds[kind_of[i]][:2]]
            before = known.setdefault(w.encode(), i)
            if before < 0:
                self.several[~before].append(i)
            elif before != i:
                self.several.append([before, i])
                known[w.encode()] = ~(len(self.several) - 1)

    def hits(self, event_id: str | None, fields: dict) -> list[int]:
        """Places of the rules that a row matches, in no order."""
        out: list[int] = []
        asked: dict[int, bool] = {}
        kind_of, places = self.kind_of, self.places
        for (field, any_case), known in self.known.items():
            text = fields.get(field)
            if not text:
                continue
            found = set(map(known.get, text.encode("utf-8", "surrogatepass").translate(_WORDS[any_case]).split()))
            found.discard(None)
            for x in found if not self.several else (y for x in found for y in (self.several[~x] if x < 0 else (x,))):
                k = kind_of[x]
                if k not in asked:
                    asked[k] = self._holds(k, event_id, text)
                if asked[k]:
                    out.append(places[x])
        return out

    def _holds(self, k: int, event_id: str | None, text: str) -> bool:
        _, required, forbidden, no = self.kinds[k]
        return (not required or event_id in required) and event_id not in forbidden and not (no and no.search(text))


class Book:
    """Rules ready for rows of (event id, fields, registry spellings)."""

    def __init__(self, rules: list):
        self.rules = rules
        self.by_id: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.patterns: dict[str, re.Pattern] = {}
        self.plain: dict[str, Plain] = {}
        by_field: dict[str, dict[str, tuple[list, dict]]] = defaultdict(lambda: defaultdict(lambda: ([], {})))
        for i, r in enumerate(rules):
            # the group of conditions whose literals are longest stands for the rule
            groups = [{(c.field, x) for c in group for x in literals(c.must)} for group in r.conditions if all(literals(c.must) is not None for c in group)]
            if groups:
                chosen = max(groups, key=lambda g: min(len(x) for _, x in g))
                alone = [c for group in r.conditions if len(group) == 1 and (c := group[0]).must and self._plain(c.must) and {(c.field, fold(self.plain[c.must].literal))} == chosen]
                for field, x in chosen:
                    # where one plain pattern decides, its own match makes a candidate, not its literal alone
                    (by_field[field][x][1].setdefault(alone[0].must, []) if alone else by_field[field][x][0]).append(i)
            elif r.required:
                for e in r.required:
                    self.by_id[e].append(i)
            else:
                self.always.append(i)
            for c in (c for group in r.conditions for c in group):
                for p in (c.must, c.must_not):
                    if p and self._plain(p):
                        by_field[c.field][fold(self.plain[p].literal)][1].setdefault(p, [])
        self.automata = {f: _automaton({w: (tuple(found), tuple((p, self.plain[p], tuple(own)) for p, own in plains.items())) for w, (found, plains) in words.items()}) for f, words in by_field.items()}
        self.needed = [(frozenset(r.required), frozenset(r.forbidden)) for r in rules]

    def _plain(self, p: str) -> Plain | None:
        if p not in self.plain:
            self.plain[p] = plain(p)
        return self.plain[p]

    def pattern(self, p: str) -> re.Pattern:
        if p not in self.patterns:
            self.patterns[p] = compiled(p)
        return self.patterns[p]

    def hits(self, event_id: str | None, fields: dict, paths: dict) -> list[int]:
        """The rules that a row matches, in their order."""
        candidates = {*self.always, *self.by_id.get(event_id, ())}
        # what is known of a pattern in a field's text or path; each is looked for once a row, and a plain one where the automaton found its literal
        seen: dict = {}
        for field, automaton in self.automata.items():
            for kind, text in ((0, fields.get(field)), (1, paths.get(field))):
                if text:
                    for end, (found, plains) in automaton.iter(fold(text)):
                        if found:
                            candidates.update(found)
                        for p, how, own in plains:
                            if (kind, field, p) not in seen and how.at(text, end):
                                seen[kind, field, p] = True
                                candidates.update(own)
        return sorted(i for i in candidates if self._ids(i, event_id) and all(any(self._holds(c, fields, paths, seen) for c in group) for group in self.rules[i].conditions))

    def _ids(self, i: int, event_id: str | None) -> bool:
        required, forbidden = self.needed[i]
        return (not required or event_id in required) and event_id not in forbidden

    def _found(self, kind: int, field: str, p: str, text: str, seen: dict) -> bool:
        key = kind, field, p
        if key not in seen:
            seen[key] = False if self.plain[p] else bool(self.pattern(p).search(text))
        return seen[key]

    def _holds(self, c, fields: dict, paths: dict, seen: dict) -> bool:
        texts = [(0, fields.get(c.field) or "")]
        if c.on_paths and paths.get(c.field):
            texts.append((1, paths[c.field]))
        either = lambda p: any(self._found(kind, c.field, p, t, seen) for kind, t in texts)
        return (not c.must or either(c.must)) and not (c.must_not and either(c.must_not))


def _automaton(words: dict[str, tuple]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, found in words.items():
        a.add_word(w, found)
    a.make_automaton()
    return a


#: What a worker made last of a pass's rules, by a key of the pass: its next tasks of the same pass take it again.
_LAST: dict[str, tuple] = {}


def _ready(key: str, shared) -> tuple[Words | None, Book | None, list[int]]:
    if key not in _LAST:
        _LAST.clear()
        words, rest, places = pickle.loads(shared.value)
        _LAST[key] = Words(*words) if words else None, Book(rest) if rest else None, places
    return _LAST[key]


def _passes(rules: list) -> Iterator[bytes]:
    """Each pass's rules as bytes: the words of those of one word, and the others with their places."""
    words, rest = [], []
    for i, r in enumerate(rules):
        w = one_word(r)
        if w:
            words.append((i, *w))
        else:
            rest.append(i)
    for n in range(max(1, -(-len(words) // WORDS_A_PASS), -(-len(rest) // RULES_A_PASS))):
        kinds: dict[tuple, int] = {}
        mine, kind_of, places = [], array("i"), array("i")
        for i, w, any_case in words[n * WORDS_A_PASS : (n + 1) * WORDS_A_PASS]:
            r = rules[i]
            c = r.conditions[0][0]
            kind_of.append(kinds.setdefault((c.field, any_case, tuple(r.required), tuple(r.forbidden), c.must_not), len(kinds)))
            mine.append(w)
            places.append(i)
        own = rest[n * RULES_A_PASS : (n + 1) * RULES_A_PASS]
        yield pickle.dumps(((list(kinds), mine, kind_of, places) if mine else None, [rules[i] for i in own], own), 5)


def by_row(rows: DataFrame, rules: list, event_id: Column, with_polarity: bool = True) -> DataFrame:
    """(row, polarity, rules array<int>) of rows(row, fields): the places of the rules that each row matches, as one array a pass; rows that match none are left out. Patterns are checked before any row is read.

    Rules are sent to each worker once. More than WORDS_A_PASS of one word, or RULES_A_PASS others, take several passes. Without polarity it is null, and no text is searched for it."""
    named, on_paths, checked = set(), set(), set()
    for c in (c for r in rules for group in r.conditions for c in group):
        named.add(c.field)
        if c.on_paths:
            on_paths.add(c.field)
        for p in (c.must, c.must_not):
            if p and p not in checked and not _ONE_WORD.fullmatch(p):
                checked.add(p)
                compiled(p)
    spelt = F.array_compact(F.array(*[F.when(looks_like_registry(F.col("fields")[f]), F.struct(F.lit(f).alias("key"), registry_path(F.col("fields")[f]).alias("value"))) for f in sorted(on_paths)])) if on_paths else F.array().cast("array<struct<key:string,value:string>>")
    told = F.map_filter("fields", lambda k, _: k.isin(sorted(named))) if len(named) <= 200 else F.col("fields")
    source = F.coalesce(F.nullif(F.col("fields")["Message"], F.lit("")), F.array_join(F.map_values("fields"), " "))
    asked = rows.select("row", (polarity(source) if with_polarity else F.lit(None).cast("string")).alias("polarity"), event_id.alias("_id"), told.alias("fields"), F.map_from_entries(spelt).alias("paths"))
    out = None
    for part in _passes(rules):
        one = asked.mapInArrow(_tester(rows.sparkSession.sparkContext.broadcast(part)), f"row {rows.schema['row'].dataType.simpleString()}, polarity string, rules array<int>")
        out = one if out is None else out.unionByName(one)
    return out


def hits(rows: DataFrame, rules: list, event_id: Column, with_polarity: bool = True) -> DataFrame:
    """(row, rule, polarity): by_row with a row for each rule."""
    return by_row(rows, rules, event_id, with_polarity).select("row", "polarity", F.explode("rules").alias("rule"))


def _tester(shared):
    key = uuid.uuid4().hex

    def run(batches):
        words, book, places = _ready(key, shared)
        for batch in batches:
            ids, maps, spellings = (batch.column(i).to_pylist() for i in (2, 3, 4))
            at, found, ends = [], array("i"), array("i", [0])
            for n, (e, m, s) in enumerate(zip(ids, maps, spellings, strict=True)):
                fields = dict(m or ())
                mine = words.hits(e, fields) if words else []
                if book:
                    mine += [places[i] for i in book.hits(e, fields, dict(s or ()))]
                if mine:
                    at.append(n)
                    found.extend(mine)
                    ends.append(len(found))
            take = pa.array(at, pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists], ["row", "polarity", "rules"])

    return run
