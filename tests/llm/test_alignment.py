"""Alignment against the two libraries and plain loops over bytes."""

import hashlib
import random
from collections import Counter

import pytest

from tests.llm.test_pieces import _texts
from tracewright.llm import alignment, bpe, chunks, pieces
from tracewright.workspace import materialize


def plain(texts):
    """Straight from the definition, with the libraries' tokens."""
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())
    letters = bpe.byte_letters()
    rows = []
    for t in texts:
        ta, tb = [], []
        if t:
            ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(t) for p in [b.id_to_piece(i)]]
            if not b"".join(x for _, x in ta) == b"".join(x for _, x in tb) == (" " + t).encode():
                ta, tb = [], []
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        sa, sb = spans
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if start <= s < e) for side in (sa, sb)))
            start = e
        links = Counter()
        for ia, s, e in sa:
            for ib, s2, e2 in sb:
                if s < e2 and s2 < e:
                    links[ia, ib] += 1
        rows.append((len(sa), len(sb), ";".join(groups), len(ends), links))
    total = sum((r[4] for r in rows), Counter())
    best = {}
    for (_, ib), n in total.items():
        best[ib] = max(n, best.get(ib, 0))
    return total, [(n, m, g, sum(c.values()), sum(c[p] for p in c if total[p] == best[p[1]]), sum(c[p] * total[p] for p in c), hashlib.sha256(text.encode()).hexdigest() if n else "") for n, m, text, g, c in rows]


TEXTS = [t if t is None or len(t) < 3000 else t[:700] for t in _texts(500)] + ["a <|endoftext|> b", "a\n \n b \n\n  c", "x  y", "é b", "a\x1c b", " lead", "the the the", "the the the", "don't  we'll"]


@pytest.fixture(scope="module")
def want():
    return plain(TEXTS)


def test_equal_to_plain(spark, want):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(df, bpe.vocabulary(), pieces.vocabulary()).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == want[1][i], t


def test_shards_hold_all_counts(spark, want, monkeypatch):
    """Small tables and slices, many tasks, many shards: each pair once, in order, with its whole count."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").repartition(5)
    parts = materialize(alignment.pair_counts(df, bpe.vocabulary(), pieces.vocabulary()), "parts")
    made = alignment.count_shards(parts.repartition(7)).collect()
    folder = made[0].path.rsplit("/", 1)[0]
    counts = alignment.Counts(folder, [(r.path, r.first, r.n) for r in made])
    import numpy as np

    keys = np.array(sorted(b << 32 | a for a, b in want[0]), np.int64)
    assert sum(r.n for r in made) == len(keys)
    assert counts.of(keys).tolist() == [want[0][k & 0xFFFFFFFF, k >> 32] for k in keys.tolist()]
    with pytest.raises(ValueError):
        counts.of(np.array([1], np.int64))


def test_tables_that_start_anew(want, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(chunks, "KEEP", 5)
    monkeypatch.setattr(chunks, "SLICE", 300)
    a = alignment.aligner(bpe.vocabulary(), pieces.vocabulary())
    table, total = chunks.Table(a.make), Counter()
    for _, numbers, _ in alignment._cut([pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], ["d", "t"])], table, alignment.starts(a.b)):
        at = np.r_[0, np.cumsum(table.column("n_links"))]
        keys = table.column("keys")
        for i in numbers.tolist():
            total.update(keys[at[i] : at[i + 1]].tolist())
        if table.full():
            table.start_anew()
    assert total == {b << 32 | x: n for (x, b), n in want[0].items()}


def test_segments_are_apart():
    """Encoding the segments of random texts one by one gives what encoding the whole gives."""
    tokenizers = pytest.importorskip("tokenizers")
    import pyarrow as pa

    whole = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    whole.encode_special_tokens = True
    a = alignment.aligner(bpe.vocabulary(), pieces.vocabulary())
    rng = random.Random(9)
    alpha = "abAZ .'s\n\t  　  \x1c\x1f\x85é漢1٣!"
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(1, 30))) for _ in range(6000)]
    parts, at = chunks.cut(chunks.marked(pa.array(texts, pa.string())), alignment.starts(a.b))
    ids, ends = a.encode(parts)
    for i, t in enumerate(texts):
        assert ids[ends[at[i]] : ends[at[i + 1]]].tolist() == whole.encode(" " + t, add_special_tokens=False).ids, repr(t)
