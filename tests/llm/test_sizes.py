"""Very long texts and rows that are repeated very often."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import DOCS, prose
from tracewright.llm import alignment, bpe, fingerprints, language, licenses, mixing, pieces, toxicity, wand


@pytest.fixture(scope="module")
def long_text():
    """Some megabytes: words, a stretch without a blank, a licence line in the middle."""
    rng = random.Random(21)
    words = prose(rng, 2_000).split()
    many = lambda n: " ".join(rng.choices(words, k=n))
    return many(250_000) + "\n" + licenses.TEMPLATES["mit"] + "\n" + "x" * 300_000 + "\n" + many(250_000)


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    return spark.createDataFrame([(1, long_text), (2, "short text"), (3, None)], "doc_id bigint, text string")


def test_tokens_of_a_long_text(spark, long_docs, long_text):
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(bpe.vocabulary()).encode(long_text, add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary()).encode(long_text, add_bos=True, add_eos=True)
    for made, want, back in ((bpe.digests(long_docs, bpe.vocabulary()), a, long_text), (pieces.digests(long_docs, pieces.vocabulary()), b, long_text)):
        (r,) = made.where("doc_id = 1").collect()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    (r,) = alignment.align(long_docs, bpe.vocabulary(), pieces.vocabulary()).where("doc_id = 1").collect()
    assert r.n_b == len(b) - 2 and r.n_links >= max(r.n_a, r.n_b) > r.n_groups > 400_000


def test_scores_of_a_long_text(spark, long_docs, long_text):
    model = toxicity.Model({"=idiot": (30, 0)}, -2.0, toxicity.DEFAULT)
    got = {r.doc_id: r.score for r in toxicity.scored(long_docs, model).collect()}
    assert 0 <= got[1] <= 1 and got[1] == pytest.approx(got[2], abs=0.05)
    docs = spark.createDataFrame([(i, prose(random.Random(i), 30), "en" if i % 2 else "fr") for i in range(40)], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.lang_pred in ("en", "fr") for r in language.predicted(long_docs, language.train(docs)).collect()} == {1: True, 2: True, 3: False}
    assert [(r.doc_id, r.license, r.unit) for r in licenses.matches(long_docs).collect()] == [(1, "mit", "line")]
    word = long_text.split()[0]
    (r,) = wand.search(long_docs, spark.createDataFrame([(7, word)], "item_id bigint, text string")).collect()
    assert (r.item_id, r["rank"], r.doc_id) == (7, 1, 1)


def test_a_row_that_is_repeated_very_often(spark):
    """Twenty thousand equal rows among a hundred others."""
    rng = random.Random(22)
    same = prose(rng, 60)
    rows = [(5, same, "en", "a", 1)] * 20_000 + [(100 + i, prose(rng, 40), "en", rng.choice("abc"), 1) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).repartition(8)
    got = fingerprints.fingerprints(docs.select("doc_id", "text")).where("doc_id = 5").groupBy("near_next").count().collect()
    assert sum(r["count"] for r in got) == 20_000 and max(r["count"] for r in got if r.near_next == 1.0) == 19_999
    mixed = mixing.mixed(docs).groupBy("doc_id").agg({"taken": "sum", "size": "sum"}).collect()
    assert len(mixed) == 101 and all(0 <= r["sum(taken)"] <= 3 * r["sum(size)"] for r in mixed)
    assert {r.doc_id: r.n_tokens for r in pieces.digests(docs, pieces.vocabulary()).where("doc_id = 5").distinct().collect()}.keys() == {5}
    best = wand.search(docs, spark.createDataFrame([(1, same)], "item_id bigint, text string")).collect()
    assert [r.doc_id for r in best] == [5] * 10 and [r["rank"] for r in sorted(best, key=lambda r: r["rank"])] == list(range(1, 11))
