"""Every query on an empty table, on odd rows and on columns with clashing names."""

import pytest

from tests.llm.conftest import DOCS
from tracewright.llm.registry import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"
ITEMS = "item_id bigint, text string"
NAMES = sorted(QUERIES)


def _tables(rows, labels, vectors, items):
    return {"documents": (rows, DOCS), "labels": (labels, "doc_id bigint, quality int, toxic int"), "embeddings": (vectors, VECTORS), "benchmark": (items, ITEMS)}


@pytest.fixture(scope="module")
def empty(write):
    return write(**_tables([], [], [], []))


@pytest.fixture(scope="module")
def odd(write, odd_rows):
    return write(**_tables(odd_rows, [(1, 1, 0), (2, None, 1), (None, 0, 1), (6, 1, None), (1, 1, 0)], [(0, None, 1), (100, [1.0, None], 1), (None, [1.0, 2.0], 1), (200, [1.0, 2.0], None), (1, [float("nan"), 1.0], 1), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [], 1)], [(1, odd_rows[0][1]), (1, odd_rows[0][1]), (2, None), (3, ""), (None, "one the"), (4, "!!")]))


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd(spark, odd, odd_rows, name):
    rows = QUERIES[name](spark, odd).collect()
    if name in ("op1_toxicity", "op3_minmax_dedup", "op4_minimax_shards", "op6_language", "op7_scaled_sketches", "op9_mix_sources", "op10_bpe_trie", "op11_piece_chunks", "op13_pair_alignment"):
        assert len(rows) == len(odd_rows)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)


def test_values_of_odd_rows(spark, odd, odd_rows):
    """Null, empty, blank, repeated and long texts have the values that the docstrings give them."""
    by = lambda name: {(r.doc_id, i): r for i, r in enumerate(sorted(QUERIES[name](spark, odd).collect(), key=str))}
    of = lambda rows, i: [r for (k, _), r in rows.items() if k == i]
    text = {}
    for i, t, *_ in odd_rows:
        text.setdefault(i, []).append(t or "")
    near = by("op3_minmax_dedup")
    assert [r.component_id for r in of(near, 1) + of(near, 2) + of(near, 7) + of(near, 8)] == [1, 1, 1, 7, 7]
    assert all(r.kept and r.n_shingles == 0 and r.component_id == i for i in (3, 4, 5) for r in of(near, i)) and all(r.kept and r.component_id is None for r in of(near, None))
    assert of(near, 9)[0].n_shingles == of(near, 6)[0].n_shingles == 1 and of(near, 10)[0].n_shingles == 1
    words = lambda t: len(t.encode().split())
    for name, value in (("op4_minimax_shards", lambda r: r.size - 16), ("op9_mix_sources", lambda r: r.size), ("op7_scaled_sketches", lambda r: r.n_chars)):
        got = by(name)
        for i, ts in text.items():
            want = sorted(len(t.encode()) if "op4" in name else words(t) if "op9" in name else len(t) for t in ts)
            assert sorted(value(r) for r in of(got, i)) == want, (name, i)
    langs = by("op6_language")
    assert all(of(langs, i)[0].lang_pred == "und" and of(langs, i)[0].score == 0 for i in (3, 4, 5, 11))
    tokens = by("op10_bpe_trie")
    assert of(tokens, 3)[0].n_tokens == of(tokens, 4)[0].n_tokens == 0 and of(tokens, 10)[0].n_tokens > 300
    pieces = by("op11_piece_chunks")
    assert of(pieces, 3)[0].n_tokens == of(pieces, 4)[0].n_tokens == 2 and of(pieces, 10)[0].n_tokens > 300 and of(pieces, 3)[0].decoded_sha256 == of(tokens, 3)[0].decoded_sha256
    aligned = by("op13_pair_alignment")
    for i in (3, 4):
        r = of(aligned, i)[0]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "")
    assert len({(r.n_links, r.groups_sha256) for r in of(aligned, 1) + of(aligned, 2)}) == 1 and of(aligned, 9)[0].n_b == of(pieces, 9)[0].n_tokens - 2
    ranked = sorted((str(r.item_id), r["rank"], r.doc_id, r.score) for r in QUERIES["op12_block_max_search"](spark, odd).collect())
    mine = [r for r in ranked if r[0] == "1"]
    assert [r[2] for r in mine[:4]] == [1, 1, 2, None] and len({r[3] for r in mine[:4]}) == 1 and [r[1] for r in mine] == list(range(1, len(mine) + 1))
    assert {r[0] for r in ranked} == {"1", "None"}
    toxic = by("op1_toxicity")
    assert of(toxic, 3)[0].score == of(toxic, 4)[0].score == of(toxic, 5)[0].score == min(r.score for r in toxic.values())
    best = sorted((r.query_id, r["rank"], r.vec_id) for r in QUERIES["op5_nra_topk"](spark, odd).collect())
    assert best == [(200, 1, 2), (200, 2, 2)]


def test_extra_columns(spark, write, odd_rows):
    """Columns named as those that operators make for themselves change nothing."""
    extra = ", n bigint, rep bigint, key bigint, block int, h bigint, k string, size bigint, text_key bigint, score double, predicted int, component bigint, target double, bands array<bigint>, toxic int, _id bigint, cell int"
    rows = [(*r, 7, 7, 7, 7, 7, "7", 7, 7, 7.0, 7, 7, 7.0, [7], 7, 7, 7) for r in odd_rows]
    labels = ([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    items = ([(1, odd_rows[0][1])], ITEMS)
    wide = write(documents=(rows, DOCS + extra), labels=labels, benchmark=items)
    slim = write(documents=(odd_rows, DOCS), labels=labels, benchmark=items)
    for name in NAMES:
        if name not in ("op5_nra_topk", "pipeline"):
            a, b = ([sorted(map(str, QUERIES[name](spark, d).collect()))] for d in (wide, slim))
            assert a == b, name


def test_pipeline_keeps_extra_columns(spark, write, odd_rows):
    import corpus_pipeline

    d = write(documents=([(*r, 7, 7.0, 8) for r in odd_rows], DOCS + ", rep bigint, score double, h bigint"), labels=([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert all(r.rep == 7 and r.h == 8 for r in out.collect())
