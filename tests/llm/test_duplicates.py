"""Near duplicates and repeated passages against brute force."""

import random

import numpy as np
import pytest

from tests.llm.conftest import DOCS, prose
from tracewright.llm import minhash, passages
from tracewright.llm.words import Words


def words_of(text):
    return (text or "").encode().lower().split()


def test_words_are_ascii_words():
    texts = ["", "A b\tc", " x\x0by\n", "É é z", "a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = Words(np.frombuffer(data, np.uint8), offsets)
    assert np.diff(w.at).tolist() == [len(words_of(t)) for t in texts]
    flat = [x for t in texts for x in words_of(t)]
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert [data[s:e].lower() for s, e in zip(w.start, w.end)] == flat


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n, base_words=150):
    """Copies of one text with edits of all sizes, so that links lie on both sides of the threshold."""
    base = prose(rng, base_words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 1_000_000), (5, 80, 1_000_000), (3, 85, 2_000)])
def test_components(spark, monkeypatch, size, percent, block):
    """With small blocks the cluster becomes a grid of groups, and links between blocks count too."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(size + percent)
    texts = [*near_copies(rng, 60), *near_copies(rng, 5, 20), *[prose(rng, 80) for _ in range(30)], "", None, "a b", "a  B", "one"]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    want = brute_components(rows, size, percent)
    got = minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_walk_links_all_components():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(80)]
    at = np.r_[0, np.cumsum([len(s) for s in sets])]
    links = minhash.walk(list(range(80)), np.concatenate(sets), at, 50)
    label = list(range(80))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))
        label[find(a)] = find(b)
    for a in range(80):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b])):
                assert find(a) == find(b)


def test_dedup_keeps_one_of_each(spark, odd_rows):
    kept = minhash.dedup(spark.createDataFrame(odd_rows, DOCS)).collect()
    ids = [r.doc_id for r in kept]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {3, 4, 5, 6, 9, 11, 12} <= set(ids) and 2 not in ids and 8 not in ids
    assert ids.count(None) == 2


def brute_cover(rows):
    first, cover = {}, {}
    for i, t in sorted(rows):
        w, n = words_of(t), passages.LEAST
        c = [False] * len(w)
        for k in range(len(w) - n + 1):
            at = first.setdefault(tuple(w[k : k + n]), i)
            if at != i:
                c[k : k + n] = [True] * n
        cover[i] = c
    return cover


def check_repeats(docs, rows):
    want = brute_cover(rows)
    got = {i: [False] * len(c) for i, c in want.items()}
    for r in passages.repeats(docs).collect():
        assert r.other_doc_id < r.doc_id and r.end - r.start >= passages.LEAST
        got[r.doc_id][r.start : r.end] = [True] * (r.end - r.start)
    assert got == want


@pytest.mark.parametrize("batch", [10_000, 16])
def test_repeats(spark, batch):
    """Passages of 45 to 120 words in random places, copies, and runs of one word, two and three; with small batches most grams lie on both sides of a cut."""
    rng = random.Random(5)
    shared = [prose(rng, n).split() for n in (45, 49, 50, 51, 60, 120)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randint(0, 300)).split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        if i % 5 == 0:
            w += ["same"] * rng.randint(40, 200) + prose(rng, rng.randint(0, 60)).split() * (i % 2) + ["a", "b", "c"][: i % 3 + 1] * rng.randint(1, 60)
        rows.append((i, " ".join(w)))
    tail = prose(rng, 45)
    rows += [(70 + i, f"{prose(rng, 3)} {'run ' * (9 * i + 14)} {tail} {prose(rng, i)}") for i in range(12)]
    rows += [(100 + i, t) for i, t in rows[:5]] + [(200, ""), (201, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_a_passage_in_a_third_of_documents(spark):
    """Near copies of one passage, edited in places, so that many suffixes of one gram differ on either side."""
    rng = random.Random(6)
    base, rows = prose(rng, 150).split(), []
    for i in range(900):
        w = prose(rng, rng.randint(5, 60)).split()
        if i % 3 == 0:
            p = list(base)
            for _ in range(rng.randint(0, 3)):
                p[rng.randrange(len(p))] = prose(rng, 1)
            w[2:2] = p[rng.randint(0, 40) :]
        rows.append((i, " ".join(w)))
    check_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)


def test_without_repeats(spark):
    rng = random.Random(8)
    p = prose(rng, 70)
    rows = [(1, f"Start here. {p} and on"), (2, f"é x\n{p}\n the end"), (3, p), (4, None), (5, ""), (6, "short")]
    out = {r.doc_id: (r.text, r.n_chars) for r in passages.without_repeats(spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, n_chars bigint")).collect()}
    assert out[1][0] == rows[0][1]
    assert out[2] == ("é x\n\n the end", len("é x\n\n the end"))
    assert 3 not in out and {4, 5, 6} <= set(out)


def test_repeated_ids_with_unlike_texts(spark):
    """Of a repeated doc_id, each text has its own fate; for components they count as linked."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"), (2, c, "z"), (2, c, "y"), (2, None, "x"), (None, a, "x"), (4, a + " end", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = sorted((r.doc_id or 0, r.text or "", r.lang) for r in minhash.dedup(docs).collect())
    assert kept == sorted([(1, a, "x"), (2, b, "x"), (2, c, "y"), (2, "", "x"), (0, a, "x")])
    got = sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id or 0, r.kept) for r in minhash.components(docs).collect())
    assert got == sorted([(1, True, 1, True), *[(2, True, 1, False)] * 4, (3, True, 1, False), (2, False, 2, True), (0, True, 0, True), (4, True, 1, False)])
