"""SentencePiece encoding and decoding against the library, on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import chunks, pieces
from tracewright.llm.merging import Merges

LETTERS = "abcdefghij  \n\t.,<>/0123456789éüß▁漢字한\U0001f600\x00\x1c 　'\"ーAЖ́"


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())


def _texts(n=1500):
    rng = random.Random(1)
    odd = ["", None, " ", "  ", "▁", "<s> </s> <unk> <0x41>", "a" * 5000, "hello world" * 3000, "  " * 100 + "x", "\n\n \n b", "漢字" * 3000, "\x00"]
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + odd


def test_equal_to_library(spark, library):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    ids = {r.doc_id: r.ids for r in pieces.encoded(df, pieces.vocabulary(), ends=True).collect()}
    digests = {r.doc_id: r for r in pieces.digests(df, pieces.vocabulary()).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids[i] == want, t
        assert digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(df, pieces.vocabulary()), pieces.vocabulary()).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_decode_of_any_ids(library):
    rng, c = random.Random(2), pieces.coder(pieces.vocabulary())
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 8))]
        assert c.decode(ids) == library.decode(ids)


def test_small_tables_change_nothing(library, monkeypatch):
    """A table that starts anew after every slice, and slices of a few texts, give the same ids."""
    monkeypatch.setattr(chunks, "KEEP", 3)
    monkeypatch.setattr(chunks, "SLICE", 200)
    texts, c = _texts(300), pieces.coder(pieces.vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [np.frombuffer(data, "<i4")[a // 4 : b // 4].tolist() for _, data, edges in pieces._ids(c, [batch]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert got == library.encode([t or "" for t in texts])


def test_merges_against_plain_loop():
    """Random tables of pairs, sequences shorter and longer than those merged together."""
    rng = random.Random(3)
    for _ in range(30):
        pairs = {(rng.randrange(12), rng.randrange(12)): (rng.randrange(40), rng.randrange(12)) for _ in range(40)}
        m = Merges(*(np.array(x) for x in zip(*((a, b, r, n) for (a, b), (r, n) in pairs.items()), strict=True)))
        rows = [[rng.randrange(6) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 20, 64, 65, 90]))] for _ in range(40)]
        at = np.cumsum([0] + [len(x) for x in rows])
        ids, ends = m(np.array(sum(rows, []), np.int32), at)
        for k, x in enumerate(rows):
            while (found := min(((pairs[p][0], i) for i, p in enumerate(zip(x, x[1:], strict=False)) if p in pairs), default=None)) is not None:
                i = found[1]
                x = [*x[:i], pairs[x[i], x[i + 1]][1], *x[i + 2 :]]
            assert ids[ends[k] : ends[k + 1]].tolist() == x


def test_model_is_checked(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(open(pieces.vocabulary(), "rb").read())
    model.pieces[500].piece = "a▁b"
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceCoder(str(tmp_path / "m"))
