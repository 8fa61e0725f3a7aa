"""Rules as data against rules compiled into the plan."""

import pickle
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import rulebook, rules
from tracewright.operators.rules import Condition, Rule

FIELDS = ["Message", "process.name", "process.command_line", "object.name"]


def test_literals():
    assert rulebook.literals(r"(?i)(disabled|turned off|Stopped)") == {"disabled", "turned off", "stopped"}
    assert rulebook.literals(r"(?i)audit polic(y|ies).{0,40}changed") == {"audit polic"}
    assert rulebook.literals(r"(?:foo)?bar+x*") is None or rulebook.literals(r"(?:foo)?bar+x*") == {"bar"}
    assert rulebook.literals(r"ab|cde") is None and rulebook.literals(r"[abc]+") is None and rulebook.literals(None) is None
    assert rulebook.literals(r"(?:schtasks){1,2}\\b") == {"schtasks"} and rulebook.literals("größer") is None


def _same(spark, rows, book):
    df = spark.createDataFrame(rows, "row bigint, fields map<string,string>").repartition(3)
    number = rules.event_number(F.col("fields"))
    key = lambda r: (r.row, r.rule, r.polarity)
    compiled = sorted(map(key, rules.hits(df, book).collect()))
    assert len(book) <= rules.COMPILED
    assert sorted(map(key, rulebook.hits(df, book, number).collect())) == compiled
    return compiled


def test_catalogue_equal_to_compiled(spark):
    """All rules of the catalogue and of reviews, on rows made of pieces that they look for."""
    book = rules.catalogue() + rules.review_catalogue()
    rng = random.Random(4)
    ids = sorted({i for r in book for i in (*r.required, *r.forbidden)})
    names = sorted({c.field for r in book for g in r.conditions for c in g})
    pieces = sorted({x for r in book for g in r.conditions for c in g for p in (c.must, c.must_not) for x in rulebook.literals(p) or ()}) + ["HKLM\\\\SAM\\\\x", "\\\\REGISTRY\\\\MACHINE\\\\SYSTEM\\\\ControlSet001\\\\Control\\\\Lsa", "was blocked", "deleted", "Größe", "\u212a\u0130", "C:\\Windows\\System32\\cmd.exe"]
    rows = [(i, {"EventID": rng.choice(ids), **{f: " ".join(rng.choices(pieces, k=rng.randint(1, 4))).title() if rng.random() < 0.3 else " ".join(rng.choices(pieces, k=rng.randint(1, 3))) for f in rng.sample(names, min(len(names), 5))}}) for i in range(1500)]
    rows += [(2000, {}), (2001, None), (2002, {"Message": None, "EventID": "4688"})]
    assert len(_same(spark, rows, book)) > 200


def test_random_rules(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gam", "delta9", "x.y", "ab"]

    def condition():
        p = rng.choice(["(?i){}", r"\b{}\b", "{}.{{0,3}}{}", "(?:{}|{})", "^{}", "[a-c]+", "(?i){}$"]).format(*(rng.choice(words).replace(".", r"\.") for _ in range(2)))
        return Condition(rng.choice(FIELDS), rng.choice([p, p, None]), rng.choice([None, None, rng.choice(words)]))

    book = []
    while len(book) < 150:
        groups = tuple(tuple(condition() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 2)))
        required = tuple(rng.sample("1234", rng.randint(0, 2)))
        if groups or required:
            book.append(Rule("T", "n", "t", required, tuple(rng.sample("45", rng.randint(0, 1))), groups))
    rows = [(i, {"EventID": rng.choice("12345"), **{f: " ".join(rng.choices([*words, "ALPHA", "Beta"], k=3)) for f in rng.sample(FIELDS, 3)}}) for i in range(400)]
    assert len(_same(spark, rows, book)) > 200


def test_passes_and_table(spark, monkeypatch):
    """Rules in several passes keep their places; rules come from a table; a pattern that can't be read is an error before any row is read."""
    condition = lambda w: [[("Message", w, None)]]
    df = spark.createDataFrame([("T%d" % i, "n", "t", None, None, condition(f"word{i}x"), None, None) for i in range(300)], rulebook.SCHEMA).coalesce(1)
    monkeypatch.setattr(rulebook, "RULES_A_PASS", 64)
    parts = list(rulebook.from_table(df))
    assert [len(p) for p in parts] == [64, 64, 64, 64, 44]
    book = [r for p in parts for r in p]
    rows = spark.createDataFrame([(i, {"Message": f"a word{i}x and Word{i + 1}x"}) for i in range(299)], "row bigint, fields map<string,string>")
    assert sorted((r.row, r.rule) for r in rules.hits(rows, book).collect()) == [(i, i) for i in range(299)]
    with pytest.raises(ValueError):
        rulebook.hits(rows, [Rule("T", "n", "t", (), (), ((Condition("Message", "(a"),),))], F.lit(None).cast("string"))


def test_plain_patterns():
    assert rulebook.plain(r"(?i)\bAb_9\b") == ("Ab_9", True, True, True) and rulebook.plain("a b-c") == ("a b-c", False, False, False)
    assert all(rulebook.plain(p) is None for p in (None, "", "ab", r"(?i)\bab", "ab[cd]", r"abc\B", "^abc", "abc|abd", "größe", "(?m)abc", "abc$", r"\b"))
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcABC_ -é\u212a", k=rng.randint(0, 12))) for _ in range(300)]
    patterns = [f"{i}{a}{''.join(rng.choices('abcABC_ -', k=3))}{z}" for i in ("", "(?i)") for a in ("", r"\b") for z in ("", r"\b") for _ in range(60)]
    book = rulebook.Book([Rule("T", p, "t", (), (), ((Condition("Message", p),),)) for p in patterns])
    met = 0
    for t in texts:
        want = [i for i, p in enumerate(patterns) if rulebook.compiled(p).search(t)]
        met += len(want)
        assert book.hits(None, {"Message": t}, {}) == want
    assert met > 100


def test_many_words_in_long_texts_search_no_text_again(monkeypatch):
    """A word is settled where the automaton finds it; a pattern that many rules share is searched once a row."""
    searched = []
    real = rulebook.compiled

    class Counted:
        def __init__(self, p):
            self.p, self.re = p, real(p)

        def search(self, t):
            searched.append(self.p)
            return self.re.search(t)

    monkeypatch.setattr(rulebook, "compiled", Counted)
    words = [f"word{i:03d}" for i in range(500)]
    book = rulebook.Book([Rule("T", w, "t", (), (), ((Condition("Message", rf"(?i)\b{w}\b", r"(?i)\b(?:the|les)\b"),),)) for w in words])
    text = " ".join(words[::2]) + " " + "x".join(words)
    assert book.hits(None, {"Message": text}, {}) == [*range(0, 500, 2)]
    assert book.hits(None, {"Message": text + " The"}, {}) == []
    assert searched == [r"(?i)\b(?:the|les)\b"] * 2


def test_words_are_looked_up_as_patterns_match(spark):
    """Rules of one word against their patterns: cases, bounds of ASCII, ids, barred texts, several rules of one word."""
    rng = random.Random(7)
    words, ids = ["ab", "Ab", "a_1", "9", "the", "Key", "word"], ["1", "2", None]
    book = []
    for _ in range(120):
        must = rng.choice(["(?i)", ""]) + rf"\b{rng.choice(words)}\b"
        condition = Condition(rng.choice(FIELDS[:2]), must, rng.choice([None, None, r"(?i)\b(?:the|les)\b", "x"]))
        book.append(Rule("T", "n", "t", tuple(rng.sample("12", rng.randint(0, 1))), tuple(rng.sample("23", rng.randint(0, 1))), ((condition,),)))
    assert all(map(rulebook.one_word, book))
    assert [rulebook.one_word(Rule("T", "n", "t", (), (), c)) for c in (((Condition("f", r"\bab"),),), ((Condition("f", r"\ba b\b"),),), ((Condition("f", r"\bab\b"), Condition("f", "x")),), ((Condition("f", r"\bab\b", "HKLM\\\\x"),),), ((Condition("f", None, "ab"),),))] == [None] * 5
    rows = [(i, {"EventID": rng.choice(ids), **{f: "".join(rng.choices([*words, " ", " ", ".", "-", "\n", "THE", "x"], k=rng.randint(0, 9))) for f in FIELDS[:2]}}) for i in range(500)]
    rows += [(900, {}), (901, None), (902, {"Message": None, "EventID": "1"})]
    assert len(_same(spark, rows, book)) > 500
    (part,) = rulebook._passes(book)
    ready = rulebook.Words(*pickle.loads(part)[0])
    for _ in range(2000):  # letters beyond ASCII are no part of a word
        e, t = rng.choice(ids), "".join(rng.choices([*words, " ", "é", "\u212aey", "\u0130", "\U0001f600", "\ud800", "THE"], k=rng.randint(0, 6)))
        holds = lambda c: c.field == "Message" and rulebook.compiled(c.must).search(t) and not (c.must_not and rulebook.compiled(c.must_not).search(t))
        want = [i for i, r in enumerate(book) if (not r.required or e in r.required) and e not in r.forbidden and holds(r.conditions[0][0])]
        assert sorted(ready.hits(e, {"Message": t, "process.name": None})) == want


def _words(n):
    return [Rule("W-%d" % (i % 3), f"word{i}", "t", (), (), ((Condition("Message", rf"(?i)\bword{i}\b"),),), 1 + i % 2) for i in range(n)]


def test_many_words_take_one_pass_and_no_polarity(spark, monkeypatch):
    """Rules of one word take no pass of their own, and no text is searched for polarity that no rule asks for."""
    monkeypatch.setattr(rulebook, "RULES_A_PASS", 64)
    rows = spark.createDataFrame([(i, {"Message": f"a word{i} and Word{i + 1}, word{i + 2}x"}) for i in range(300)], "row bigint, fields map<string,string>")
    plan = lambda book: rules.allowed_hits(rows, book)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(_words(300)).count("MapInArrow") == 1 and "RLIKE" not in plan(_words(300)) and "RLIKE" in plan([*_words(300), Rule("T1562", "n", "t", ("1",))])
    assert sorted((r.row, r.rule) for r in rules.hits(rows, _words(300)).collect()) == sorted((i, j) for i in range(300) for j in (i, i + 1) if j < 300)
    monkeypatch.setattr(rulebook, "WORDS_A_PASS", 128)
    assert plan(_words(300)).count("MapInArrow") == 3
    assert sorted((r.row, r.rule) for r in rules.hits(rows, _words(300)).collect()) == sorted((i, j) for i in range(300) for j in (i, i + 1) if j < 300)


@pytest.mark.parametrize("by", [[], ["who"], ["who", "day"]])
def test_findings_of_many_rules_are_those_of_few(spark, monkeypatch, by):
    """The same findings whether rules are compiled or data: least numbers by group, polarity where it counts, repeated rows, several passes."""
    rng = random.Random(8)
    book = _words(30) + [Rule(rng.choice(["W-1", "T1562", "T1562"]), f"r{i}", "t", (), ("4",), ((Condition("Message", rng.choice(["(?i)word2.", "was [bd]", "a word"])),),), rng.randint(1, 4), rng.choice(rules.LEVELS)) for i in range(12)]
    text = lambda: " ".join(rng.choices([f"word{i}" for i in range(30)] + ["was disabled", "was blocked", "a"], k=rng.randint(0, 6)))
    rows = spark.createDataFrame([(rng.randint(0, 150), rng.choice(["x", "y", None]), rng.randint(1, 2), {"EventID": rng.choice("1234"), "Message": text()}) for _ in range(200)], "row bigint, who string, day int, fields map<string,string>").repartition(3)
    found = lambda: sorted(map(repr, rules.findings(rows, book, by).collect()))
    few = found()
    monkeypatch.setattr(rules, "COMPILED", 5)
    monkeypatch.setattr(rulebook, "RULES_A_PASS", 7)
    monkeypatch.setattr(rulebook, "WORDS_A_PASS", 11)
    assert few == found() and len(few) >= 4
