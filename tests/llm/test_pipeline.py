"""The stages one by one against brute force over what the stage before kept."""

import random

import corpus_pipeline
from tests.llm.conftest import DOCS, prose
from tests.llm.test_duplicates import brute_components, brute_cover
from tracewright.workspace import materialize


def test_stages(spark, write):
    rng = random.Random(12)
    passage = prose(rng, 80)
    rows, labels = [], []
    for i in range(200):
        w = prose(rng, 70).split()
        if i % 10 == 0:
            w[5:5] = ["idiot", "moron"]
        if i % 9 == 1:
            w[3:3] = passage.split()
        rows.append((i, " ".join(w), "en", "ab"[i % 2], 0))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(300 + i, rows[i][1] + " end", "en", "a", 0) for i in range(1, 9)]
    d = write(documents=(rows, DOCS), labels=(labels, "doc_id bigint, quality int, toxic int"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], d), name))
    texts = [{r.doc_id: r.text for r in x.collect()} if "text" in x.columns else None for x in out]
    assert not [i for i in texts[1] if i < 200 and i % 10 == 0] and len(texts[1]) == 188
    want = {i for i, (_, c) in brute_components(list(texts[1].items()), 5, 80).items() if i == c}
    assert set(texts[2]) == want
    cover = brute_cover(texts[2].items())
    for i, t in texts[2].items():
        assert texts[3][i].split() == [w for w, gone in zip(t.split(), cover[i]) if not gone]
    assert set(texts[4]) <= set(texts[3]) and len(texts[4]) > 0.5 * len(texts[3])
    assert out[5].count() == out[4].count()
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, out[5].collect()))
