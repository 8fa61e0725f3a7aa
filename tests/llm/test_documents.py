"""Sharding, mixing, fingerprints, licences, toxicity, language, tokens and search against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import DOCS, prose
from tracewright.llm import bpe, fingerprints, language, licenses, mixing, sharding, topk, toxicity
from tracewright.llm.registry import QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 90)), "en", rng.choice(["a", "b", "b", "b", "b", "é", None]), 0) for i in range(400)]
    rows += [(500 + i, rows[i % 7][1], "en", "b", 0) for i in range(100)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def brute_capacity(sizes, shards):
    best = None
    for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        at = [0, *cut, len(sizes)]
        most = max(sum(sizes[a:b]) for a, b in itertools.pairwise(at))
        best = most if best is None else min(best, most)
    return best


def test_capacity_is_smallest():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(0, 30, rng.integers(1, 9))
        shards = int(rng.integers(1, 5))
        c = sharding.capacity(sizes, shards)
        assert c == brute_capacity(sizes.tolist(), shards)
        starts = [*sharding.cuts(sizes, shards), len(sizes)]
        assert starts[0] == 0 and sorted(starts) == starts
        assert max(sizes[a:b].sum() for a, b in itertools.pairwise(starts)) <= c


def test_shards(docs):
    rows = sharding.sharded(docs, 8).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    by_text, slots, sizes = {}, {}, {}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * min(sizes.values())


def test_ranges_close_in_on_the_capacity():
    """Many groups in few ranges, without Spark: the stretches looked at stay few, and the capacity is that over all groups."""
    rng = np.random.default_rng(5)
    for n in (3_000, 60_000):
        place = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        size = (rng.pareto(1.2, n) * 500 + 16).astype(np.int64)

        def summed(keep, bits):
            first, at = np.unique((place[keep] >> (64 - bits)) << (64 - bits), return_index=True)
            return sharding.Ranges(first, np.add.reduceat(size[keep], at), np.diff(np.r_[at, keep.sum()]) == 1)

        ranges, bits, rounds = summed(np.ones(n, bool), 8), 8, 0
        while (open_ := ranges.open_ranges(40)[1]).any():
            bits, rounds = min(64, bits + 8), rounds + 1
            edge = np.flatnonzero(np.diff(np.r_[0, open_.astype(np.int8), 0])).reshape(-1, 2)
            assert len(edge) <= 320 and rounds <= 8
            ends = np.r_[ranges.first[1:], np.iinfo(np.int64).max]
            keep = np.any([(place >= ranges.first[a]) & ((place < ends[b - 1]) | (b == len(ends))) for a, b in edge], 0)
            ranges = ranges.refined(open_, summed(keep, bits))
        assert sharding.capacity(ranges.size, 40) == sharding.capacity(size, 40)


def test_shards_are_minimax(spark, docs, monkeypatch):
    """The largest shard is the smallest over all groups in the order of their hashes, whatever the ranges looked at."""
    from pyspark.sql import functions as F

    for n, copies, bits in ((5, 1, 16), (40, 60, 16), (400, 1, 16), (400, 40, 4)):
        monkeypatch.setattr(sharding, "BITS", bits)
        some = docs.where(F.col("doc_id") < n)
        some = some.unionByName(docs.where("doc_id = 3").select("*").crossJoin(spark.range(copies)).drop("id"))
        groups = some.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 16).alias("s")).orderBy("h").collect()
        best = sharding.capacity(np.array([g.s for g in groups]), 8)
        assert best == max(r.s for r in sharding.sharded(some, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect())


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {s: rng.choice([0, 1, 5, 50, 1000, 20000]) for s in [*"abcdefg", None, "Z", "é"]}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("bucket", [20_000, 10])
def test_mix(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = mixing.mixed(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    sums, target, longest = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(text[r.doc_id].split())
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sums[s] = sums.get(s, 0) + r.taken
        target[s] = r.target
        longest[s] = max(longest.get(s, 0), r.size)
    assert all(abs(sums[s] - target[s]) <= 2 * longest[s] for s in sums)
    assert sum(sums.values()) <= sum(r.size for r in rows)
    assert sorted(mixing.mixed(docs.repartition(3)).collect()) == sorted(rows)
    mix = {}
    for r in mixing.mixture(docs).collect():
        mix[r.doc_id] = mix.get(r.doc_id, 0) + len(r.text.split())
    assert {r.doc_id: r.taken for r in rows if r.taken} == {i: n for i, n in mix.items() if n}


def shingle_set(t):
    """All shingles of a text, as the sketches' docstring defines them."""
    w = t.lower().split()
    return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + n]) for n in fingerprints.LENGTHS for i in range(len(w) - n + 1)}


def _kept(spark, texts):
    """For each text the hashes of its shingles that lie in the fraction, by Spark's hash but none of the operator's code."""
    from pyspark.sql import functions as F

    of = sorted({s for t in texts for s in shingle_set(t)})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(of)], "i int, w array<string>").select("i", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    chain = F.lit(None).cast("bigint")
    for n in (1, *fingerprints.LENGTHS):
        chain = F.when(F.size("w") == n, F.xxhash64(*[F.get("w", F.lit(j)) for j in range(n)])).otherwise(chain)
    h = {of[r.i]: r.h for r in df.select("i", chain.alias("h")).collect()}
    limit = -(1 << 63) + (1 << 64) // fingerprints.SCALE
    return lambda t: {h[s] for s in shingle_set(t) if h[s] < limit}


@pytest.mark.parametrize("hot", [False, True])
def test_fingerprints(spark, docs, monkeypatch, hot):
    """Against plain shingle sets; a doc_id that a third of the rows have is many blocks too."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, 301).otherwise(F.col("doc_id"))) if hot else docs
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id", h, "text").collect()]
    got = fingerprints.fingerprints(docs).collect()
    want = []
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    edited = lambda t, after: t[: len(t) - len(t) // 4] + after[: len(t) // 4]
    pairs = [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]
    kept = _kept(spark, [x for _, t, after in pairs for x in (t, edited(t, after))])
    for i, t, after in pairs:
        a, b, c = kept(t), kept(edited(t, after)), kept(after)
        want.append((i, len(t), hashlib.sha256(edited(t, after).encode()).hexdigest(), 8 * len(a), 8 * len(b), round(like(a, b), 9), round(like(a, c), 9), round(len(a & c) / len(a), 9) if a else -1.0))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint), len(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9), -1.0 if r.contained_in_next is None else round(r.contained_in_next, 9)) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        if not hot:
            by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(len(r.fingerprint) for r in got) < sum(len(t.encode()) for _, t in rows)


def test_sketches_merge(spark):
    """By the query's own scale, a merged sketch is exactly the hashes of the union's shingles below the limit, and an empty one says nothing."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(prose(rng, 1 + i // 2), prose(rng, 40)) for i in range(40)]
    t = spark.createDataFrame(rows, "a string, b string")
    of = lambda c, scale: fingerprints.sketch(F.col(c), scale)
    limit = -(1 << 63) + (1 << 64) // fingerprints.SCALE
    some = 0
    own = fingerprints.SCALE
    for r in t.select(of("a", own).alias("x"), of("b", own).alias("y"), of("a", 1).alias("p"), of("b", 1).alias("q")).withColumn("m", fingerprints.merged(F.array("x", "y"))).withColumn("c", fingerprints.containment(F.col("x"), F.col("m"))).collect():
        low = lambda *s: sorted(h for h in set().union(*s) if h < limit)
        assert (r.x, r.y, r.m) == (low(r.p), low(r.q), low(r.p, r.q))
        assert r.c == (1.0 if r.x else None)
        some += bool(r.x)
    assert 0 < some < 40


def test_errors_of_fingerprints(spark):
    """Estimates against the whole shingle sets: mean errors by size, and containment between a page and a book."""
    rng = random.Random(8)
    sizes = [10] * 60 + [40] * 60 + [150] * 60 + [800] * 20
    texts = [prose(rng, n) for n in sizes]
    texts += [texts[-1] + " " + prose(rng, 6000)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    errors = {}
    for i, t in enumerate(texts[:-1]):
        after = texts[i + 1]
        q = len(t) // 4
        a, b, c = shingle_set(t), shingle_set(t[: len(t) - q] + after[:q]), shingle_set(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        errors.setdefault(sizes[i], []).append(max(abs(got[i].near_edited - like(a, b)), abs(got[i].near_next - like(a, c))))
    assert {n: sum(e) / len(e) < most for (n, e), most in zip(sorted(errors.items()), (0.25, 0.12, 0.06, 0.03), strict=True)} == dict.fromkeys(errors, True), errors
    assert got[len(sizes) - 1].contained_in_next == 1.0


def test_licenses(spark):
    import re

    rng = random.Random(6)
    line = licenses.TEMPLATES["gpl-3.0"]
    cut = " ".join(line.split()[:-2])
    texts = {1: f"{prose(rng, 30)}\n{line}\n{prose(rng, 9)}", 2: licenses.TEMPLATES["mit-permission"].replace(" to ", "\nto "), 3: cut, 4: prose(rng, 50), 5: line.upper() + "!", 6: "", 7: None, 8: f"{line} {prose(rng, 40)}", 9: "License"}

    def bigrams(t):
        w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        return set(zip(w, w[1:]))

    want = {}
    for i, t in texts.items():
        units = [] if t is None else [*t.split("\n"), *([t] if "\n" in t else []), *(p for p in re.split(r"\n[ \t\r]*\n", t) if "\n" in p.strip(" "))]
        for name, template in licenses.TEMPLATES.items():
            b = bigrams(template)
            dice = [2 * len(a & b) / (len(a) + len(b)) for u in units if (a := bigrams(u))]
            if max(dice, default=0) >= licenses.THRESHOLD:
                want[i, name] = round(max(dice), 9)
    got = {(r.doc_id, r.license): round(r.dice, 9) for r in licenses.matches(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == want and (1, "gpl-3.0") in got and (2, "mit-permission") in got and 8 not in {i for i, _ in got}


def test_templates_from_a_table(spark):
    known = spark.createDataFrame([("own", "You may read this text on Sundays only."), ("other", "Nobody may read this other text at all.")], "license string, text string")
    texts = [(1, "Intro\nYou may read this text on sundays only!\nEnd"), (2, licenses.TEMPLATES["mit"]), (3, None)]
    got = [tuple(r) for r in licenses.matches(spark.createDataFrame(texts, "doc_id bigint, text string"), known=known).collect()]
    assert got == [(1, "own", "line", 3, 1.0)]


def test_licenses_of_documents(spark):
    """The five kinds of licence lines that the test tables' documents hold, each among prose."""
    rng = random.Random(7)
    kinds = {"gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "all-rights-reserved-short": "All rights reserved.", "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.", "mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0."}
    rows = [(i, f"{prose(rng, 30)}\n{line}\n{prose(rng, 30)}") for i, line in enumerate(kinds.values())]
    got = {(r.doc_id, r.license): r.dice for r in licenses.matches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: got.get((i, k)) for i, k in enumerate(kinds)} == dict.fromkeys(kinds, 1.0)


def test_folding():
    assert toxicity.folded("You 1D10T, l0ser$ and іdiot ｉｄｉｏｔ") == ["you", "idiot", "loser", "and", "idiot", "idiot"]
    assert toxicity.folded("room 101 costs $50") == ["room", "101", "costs", "50"]
    assert toxicity.folded(None) == []


def test_exceptions_and_length():
    m = toxicity.Model({"=trash": (20, 0), "=idiot": (20, 0)}, -2.0, toxicity.DEFAULT)
    assert m.features("put it in the trash can")[0] == 0
    assert m.score("you idiot") > m.score("you idiot " + "fine words here " * 200) > m.score("fine words")
    assert m.score("") == m.score(None) == m.score("fine")


def naive_features(model, text, exceptions=toxicity.EXCEPTIONS):
    """Heaviest entries by looking at every word, and exceptions word by word."""
    words, hits = toxicity.folded(text), {}
    spared = {i + k for i in range(len(words)) for p in exceptions for k in range(len(p.split())) if words[i : i + len(p.split())] == p.split()}
    for i, w in enumerate(words):
        found = [model.weight(t, o) for e, (t, o) in model.lexicon.items() if t >= toxicity.LEAST_TOXIC and (w == e[1:] if e[0] == "=" else w.startswith(e))]
        if i not in spared and max(found, default=0) > 0:
            hits[i] = max(found)
    return [max(hits.values(), default=0.0), np.log1p(sum(hits.values())), np.log((len(hits) + 0.5) / (len(words) + 20.0)) if hits else -8.0]


def test_features_equal_a_naive_matcher():
    rng = random.Random(11)
    words = "idiot trash can bag bin clown fish class idiotic proof light moron mor morning the of a".split()
    model = toxicity.Model({"=idiot": (20, 0), "idio": (9, 1), "=trash": (30, 2), "clown": (8, 0), "=moron": (5, 0), "moro": (2, 0), "=of": (3, 900)}, -2.0, toxicity.DEFAULT)
    for n in [0, 1, 2, 5, 30, 200] * 10:
        text = " ".join(rng.choice(words) for _ in range(n))
        assert model.features(text) == pytest.approx(naive_features(model, text))


def test_exceptions_take_linear_time():
    import time

    model = toxicity.Model({"=trash": (20, 0)}, -2.0, toxicity.DEFAULT)
    began = time.time()
    assert model.features("trash can " * 100_000)[0] == 0
    assert time.time() - began < 10


def test_entry_weights_equal_plain_counts(spark):
    """The learnt lexicon's counts, by a plain loop over the labelled rows."""
    rng = random.Random(13)
    rows = [(i, f"{prose(rng, 20)} {'blorg snark' if i % 4 == 0 else ''}") for i in range(120)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = {}
    for i in learnt:
        for w in set(toxicity.folded(rows[i][1])):
            for e in ["=" + w, *(w[:k] for k in toxicity.PREFIXES if k <= len(w))]:
                counts.setdefault(e, [0, 0])[i % 4 != 0] += 1
    own = {e: c for e, c in model.lexicon.items() if e.lstrip("=") not in toxicity.SEEDS}
    assert own and all(tuple(counts[e]) == c for e, c in own.items()) and "blor" in own and "snar" in own
    base = np.log((sum(i % 4 == 0 for i in learnt) + 0.5) / (sum(i % 4 != 0 for i in learnt) + 1.0))
    assert model.base == pytest.approx(base)


def test_toxicity(spark, write):
    rng = random.Random(9)
    insults = ["blorgface", "idiot"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = prose(rng, 60).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(bad)))
    d = write(documents=(rows, DOCS), labels=(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, d).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert all((r.score >= 0.7) == r.predicted and 0 <= r.score <= 1 for r in got.values())


def test_language(spark, write):
    rng = random.Random(9)
    parts = {"en": "the and of ing th er with", "de": "der die und sch ung keit ß", "fr": "le la eau ç é que ux", "es": "el los ción ñ que ado"}
    rows = [(i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(2)) for _ in range(40)), lang if i % 9 else None, "a", 0) for i in range(600) for lang in [rng.choice(list(parts))]]
    truth = {r[0]: next(k for k in parts if k == r[2]) if r[2] else None for r in rows}
    rows += [(900, None, "en", "a", 0), (901, "12 !", "en", "a", 0), (902, "", None, "a", 0)]
    d = write(documents=(rows, DOCS))
    got = {r.doc_id: r for r in QUERIES["op6_language"](spark, d).collect()}
    held = [i for i in truth if got[i].held_out and truth[i]]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_votes_equal_a_plain_loop():
    """The family with the highest machine, then a vote of every pair of its languages."""
    rng = random.Random(3)
    parts = {"en": "the and of ing", "de": "der und sch ung", "nl": "het een van ij", "fr": "la eau que ux", "es": "el los que ado", "xx": "zz qq kx"}
    texts = [(" ".join("".join(rng.choice(parts[lang].split()) for _ in range(2)) for _ in range(8)), lang) for _ in range(300) for lang in [rng.choice(list(parts))]]
    x = np.array([language.features(t) for t, _ in texts])
    model = language.Model(x[:200], [lang for _, lang in texts[:200]])
    got, scores = model.predict(x)
    for v, lang, score in zip(np.c_[x, np.ones(len(x), np.float32)], got, scores, strict=True):
        family = model.families[max(range(len(model.families)), key=lambda k: float(v @ model.tops[k]))]
        members = model.members[family]
        votes = {m: [0, 0.0] for m in members}
        for i, j, w in model.pairs[family]:
            d = float(v @ w)
            votes[members[i if d >= 0 else j]][0] += 1
            votes[members[i]][1] += d
            votes[members[j]][1] -= d
        assert votes[lang] == max(votes.values()) and 0 <= score <= 1
    assert np.mean([a == b for a, (_, b) in zip(got[200:], texts[200:], strict=True)]) > 0.95


def test_no_letter_means_no_language():
    assert all(language.features(t) is None for t in (None, "", "½ ² ① 12 !", "٣٤ _"))
    assert all(language.features(t) is not None for t in ("a", "é", "ß½", "日本", "12 я"))


TEXTS = ["", " ", "a", "Hello world, it's 1234!", "  two  blanks \n\n\nlines\t", "<|endoftext|>x<|endoftext|>", "é日本語\U0001f600‍", "a" * 5000, "ab" * 900 + " " * 300, "ÀÁÂ'S we'LL've", "   x"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    reference = Tokenizer.from_file(path)
    reference.no_truncation()
    reference.no_padding()
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aethin \n'.é1😀Ġ") for _ in range(rng.randint(1, 200))) for _ in range(300)] + [prose(rng, 200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), path, True).collect()}
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(spark.createDataFrame(rows, "doc_id bigint, text string"), path), path).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in rows}


@pytest.mark.parametrize(("candidates", "chunk"), [(32_768, 64), (70, 2)])
def test_topk(spark, monkeypatch, candidates, chunk):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 12)).round(1)
    v[50:200] = v[0]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(700, [0.0] * 12, 0), (800, [1.0], 0), (900, [2.0], 0)] + [(250, v[0].tolist(), 0)] * 3
    got = {}
    e = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    for r in topk.top(e, e.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, np.floor(np.float32(x).astype(np.float64) * 1024).astype(np.int64)) for i, x, _ in rows]
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-int(q @ x), j) for j, x in whole if i != j and len(x) == len(q))[:10]
            assert sorted(got[i]) == [(n, j, -s) for n, (s, j) in enumerate(best, 1)]


def test_bounds_leave_few():
    """After the rounds few candidates are left, and what is left holds the best."""
    rng = np.random.default_rng(4)
    rows = np.floor(1024 * (v := rng.normal(size=(3000, 64))) / np.linalg.norm(v, axis=1)[:, None])
    ids, scores = np.arange(3000), rows @ rows[:20].T
    rows = rows.astype(np.int64)
    seeds = np.array([topk.kth(np.delete(scores[:700, x], x), 10) for x in range(20)])
    found, resolved = topk.Lists(rows, ids).top(rows[:20], ids[:20], seeds, 10)
    assert resolved < 0.05 * 20 * 3000
    for x in range(20):
        best = sorted((-int(s), i) for i, s in enumerate(scores[:, x].tolist()) if i != x)[:10]
        assert [(i, s) for q, i, s in found if q == x] == [(i, -s) for s, i in best]


@pytest.mark.parametrize("size", [1e5, 3e6, 1e9, 3e9, 1e15])
def test_topk_of_large_components(spark, size):
    """Whole numbers are exact beyond 2^53, and scores beyond 64 bits keep their order."""
    rng = np.random.default_rng(11)
    rows = np.floor(rng.normal(size=(300, 64)) * size).astype(np.int64)
    rows[50:60] = rows[40:50]  # equal scores
    rows[60:70] = rows[40:50]
    rows[60:70, 0] += 1  # scores that differ in the last digits
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, v array<bigint>").repartition(3)
    got = {}
    for r in topk.top(df, df.where("vec_id in (0, 45, 100)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 45, 100):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q].tolist(), r.tolist(), strict=True)), i) for i, r in enumerate(rows) if i != q)[:10]
        assert got[q] == [(i, topk.fitting(-s)) for s, i in scores]


def test_many_templates_are_joined(spark, monkeypatch):
    """Beyond LIMIT templates meet units by their rarest bigrams: the same matches as when all are broadcast."""
    rng = random.Random(12)
    texts = dict(licenses.TEMPLATES)
    changed = [t if rng.random() < 0.3 else " ".join(w for w in t.split() if rng.random() < 0.93) for t in texts.values() for _ in range(4)]
    docs = [(i, "prose here\n" * rng.randint(0, 3) + t + rng.choice(["", "\nmore prose", "\n\n" + rng.choice(changed)])) for i, t in enumerate(changed)] + [(900, None), (901, ""), (902, "one"), (None, texts["mit"]), (3, texts["mit"])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    known = spark.createDataFrame(sorted(texts.items()) + [("empty", ""), ("none", None), ("word", "word")], "license string, text string")
    key = lambda r: (str(r.doc_id), r.license, r.unit, r.n_units, round(r.dice, 9))
    want = sorted(map(key, licenses.matches(df).collect()))
    monkeypatch.setattr(licenses, "LIMIT", 5)
    assert sorted(map(key, licenses.matches(df, known=known).collect())) == want and len(want) > 60
    assert licenses.matches(df, known=known.where("false")).collect() == []
