"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """Every document scored for every item, straight from the definition."""
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        wanted = set(TERM.findall(text.translate(LOWER)))
        scores = []
        for (doc, c), size in zip(held, lengths, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def answers(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in wand.search(d, q, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Größe", "İx", "naïve", "a\x00b", "９"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 40)))) for i in range(600)]
    docs += [(3, docs[4][1]), (None, docs[4][1]), (None, docs[4][1]), (700, None), (701, ""), (702, "...  \n"), (703, docs[4][1].upper()), (704, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(20, None), (21, ""), (22, "!!"), (23, "unknownterm"), (1, docs[4][1]), (24, "w1"), (24, "w1"), (25, docs[4][1])]
    return docs, items


def test_equal_to_scoring_all(spark, corpus, monkeypatch):
    docs, items = corpus
    want = plain(docs, items)
    assert answers(spark, docs, items) == want
    assert answers(spark, docs, items, k=3) == plain(docs, items, 3)
    monkeypatch.setattr(wand, "QUERIES", 4)  # several passes
    assert answers(spark, docs, items) == want


def test_random_lists():
    """Random lists of frequent and rare terms; a threshold that no document reaches."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(5, 60, 400)
        lists = [np.flatnonzero(rng.random(400) < p) for p in (0.5, 0.2, 0.05, 0.01)]
        doc, term = np.concatenate(lists), np.repeat(np.arange(4), [len(x) for x in lists])
        order = np.lexsort((term, doc))
        doc, term, times = doc[order], term[order], rng.integers(1, 9, len(doc))
        at = np.searchsorted(doc, np.arange(401))
        shard = wand.Shard(pa.array(rng.permutation(400)), n, term.astype(np.int32), times, at, (400, int(n.sum())), 4)
        weight = np.array([1, 20, 300, 4000])
        best, score = shard.search(np.arange(4), weight, 10, 0)
        m = 10 + 90 * n * 400 // n.sum()
        full = np.zeros(400, np.int64)
        np.add.at(full, doc, weight[term] * (10**9 * times // (1000 * times + 8 * m[doc])))
        ids = shard.ids.to_numpy()[best]
        assert score.tolist() == sorted(full.tolist(), reverse=True)[: len(score)]
        assert len(ids) == 10
        none, _ = shard.search(np.arange(4), weight, 10, int(score[0]) + 1)
        assert len(none) == 0


def test_blocks_are_passed_over():
    """A heavy term in a few neighbouring documents: the light term's blocks elsewhere stay shut."""
    import pyarrow as pa

    n = np.full(4000, 20)
    lists = [np.arange(4000), np.arange(100, 130)]
    doc, term = np.concatenate(lists), np.repeat([0, 1], [4000, 30])
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    shard = wand.Shard(pa.array(range(4000)), n, term.astype(np.int32), np.ones(len(doc), np.int64), np.searchsorted(doc, np.arange(4001)), (4000, 80_000), 2)
    best, _ = shard.search(np.arange(2), np.array([1, 5000]), 10, 0)
    assert best.tolist() == list(range(100, 110))
    assert shard.opened < shard.seen / 5


def test_boundaries_are_best(monkeypatch):
    """The sum that dynamic programming minimises equals the least over all ways to cut."""
    monkeypatch.setattr(wand, "BLOCK", 4)
    monkeypatch.setattr(wand, "OPENING", 7)
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(0, 9, 3)
        at = np.r_[0, np.cumsum(sizes)]
        v = rng.integers(0, 20, at[-1])
        start = wand.boundaries(v, at)
        cost = lambda a, b: 7 + v[a:b].max() * (b - a) - v[a:b].sum()
        got = sum(cost(a, b) for a, b in zip(start[:-1], start[1:], strict=True))
        want = 0
        for a, b in zip(at[:-1], at[1:], strict=True):
            best = {a: 0}
            for e in range(a + 1, b + 1):
                best[e] = min(best[s] + cost(s, e) for s in range(max(a, e - 4), e))
            want += best[b]
        assert got == want and set(at[:-1][sizes > 0]) <= set(start)
