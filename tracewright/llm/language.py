"""Language by hierarchical discrimination: first the family, then linear support vector machines between each two of its languages.

Features are hashed byte trigrams of the whole lower-cased text with everything but letters as one blank, square roots of
counts scaled to length one. Families come from a fixed table; a language outside it is a family of its own. The family is the
one whose one-versus-rest machine answers highest; within it every pair of languages votes, and margins settle ties.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.memory import trimmed

#: Documents fitted on at most, shared evenly among languages: in each the first by a hash of doc_id.
FIT_ROWS = 4_000
#: Hashed trigrams; a power of two.
SIZE = 2_048

# Families of languages.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "sl", "cs", "sk", "pl", "mk"],
    "turkic": ["tr", "az", "kk", "uz"],
    "uralic": ["fi", "et", "hu"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Anything but letters, of ASCII texts and of others: Python's own word characters include signs such as ½ and ².
_OTHER, _OTHERS = re.compile(r"[^a-z]+"), regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def features(text: str | None) -> np.ndarray | None:
    """The text's vector; None if it is null or has no letter."""
    if not text or not _LETTER.search(text):
        return None
    words = (_OTHER if text.isascii() else _OTHERS).sub(" ", text.lower())
    b = np.frombuffer(f"  {words} ".encode(), np.uint8).astype(np.uint32)
    code = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) * np.uint32(2654435761)
    v = np.sqrt(np.bincount(code >> np.uint32(33 - SIZE.bit_length()), minlength=SIZE).astype(np.float32))
    return v / np.linalg.norm(v)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """A linear machine with squared hinge loss, last the intercept, by accelerated gradient steps. y: 1 and -1, whose classes weigh the same."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (1 / c + 2 * 2.0)
    w = np.zeros(x.shape[1], np.float32)
    at = w.copy()
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ at))
        new = at - step * (at / c - 2 * x.T @ (weight * slack * y))
        at, w = new + t / (t + 3) * (new - w), new
    return w


class Model:
    """families: names; tops: a machine each; pairs: {family: [(i, j, machine)]} between its languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        family = np.array([_FAMILY.get(a, a) for a in langs])
        langs = np.array(langs)
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(langs[family == f].tolist())) for f in self.families}
        one = len(self.families) == 1
        self.tops = np.zeros((len(self.families), SIZE + 1), np.float32) if one else np.array([svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families])
        self.pairs = {f: [(i, j, svm(x[some := np.isin(langs, [m[i], m[j]])], np.where(langs[some] == m[i], 1, -1).astype(np.float32))) for i in range(len(m)) for j in range(i + 1, len(m))] for f, m in self.members.items()}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of some vectors; a score is the product of both steps' logistic margins."""
        x = np.c_[x, np.ones(len(x), np.float32)]
        tops = x @ self.tops.T
        best = tops.argmax(1)
        rest = np.sort(tops, 1)
        sure = 1 / (1 + np.exp(-3 * (rest[:, -1] - rest[:, -2]))) if tops.shape[1] > 1 else np.ones(len(x))
        out, scores = [""] * len(x), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            m = self.members[f]
            votes, margins = np.zeros((len(rows), len(m))), np.zeros((len(rows), len(m)))
            for i, j, w in self.pairs[f]:
                d = x[rows] @ w
                votes[:, i] += d >= 0
                votes[:, j] += d < 0
                margins[:, i] += d
                margins[:, j] -= d
            win = np.lexsort((margins, votes), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
            for r, w in zip(rows.tolist(), win.tolist(), strict=True):
                out[r] = m[w]
            margin = margins[np.arange(len(rows)), win] / max(1, len(m) - 1)
            scores[rows] = sure[rows] * (1 / (1 + np.exp(-3 * margin)) if len(m) > 1 else 1)
        return out, scores


def train(docs: DataFrame) -> Model | None:
    """Learns from documents with a language whose crc32(doc_id) mod 4 is not 2; None if there are none.

    The rows chosen are FIT_ROWS at most, so their ids can be broadcast to the texts and their vectors come to the driver (32 MB); of a doc_id's texts one stands for all.
    """
    of = docs.where("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.xxhash64("doc_id").alias("_h"))
    # as many languages as rows at most, the commonest, so the counts can be broadcast
    counts = of.groupBy("_lang").agg(F.count("*").alias("_all")).orderBy(F.col("_all").desc(), "_lang").limit(FIT_ROWS)
    most = max(1, FIT_ROWS // max(1, counts.count()))
    # a language's hashes are thinned out to some more rows than are wanted, before they are ordered
    thin = of.join(F.broadcast(counts), "_lang").where(F.pmod("_h", F.lit(1 << 30)) * F.col("_all") <= 2 * most * (1 << 30))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_id"))
    chosen = thin.withColumn("_n", first).where(F.col("_n") <= most).select("_id", "_lang").distinct()

    def run(batches):
        for batch in batches:
            made = [(i, lang, v.tobytes()) for i, t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if (v := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], batch.column(0).type), pa.array([x[1] for x in made], pa.string()), pa.array([x[2] for x in made], pa.binary())], ["id", "lang", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    met = docs.where("lang is not null").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("_id", "text", "lang")
    rows = sorted(map(tuple, met.mapInArrow(trimmed(run), f"id {kind}, lang string, v binary").groupBy("id", "lang").agg(F.min("v").alias("v")).select("lang", "v").collect()))
    return Model(np.array([np.frombuffer(v, np.float32) for _, v in rows]), [lang for lang, _ in rows]) if rows else None


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) with lang_pred and score. Null texts, texts without a letter, and all without a model are und with score 0."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                made = [features(t.as_py()) for t in part.column(1)]
                some = [i for i, v in enumerate(made) if v is not None and model is not None]
                langs, scores = ["und"] * len(made), np.zeros(len(made))
                if some:
                    found, sure = model.predict(np.array([made[i] for i in some]))
                    scores[some] = sure
                    for i, lang in zip(some, found, strict=True):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id bigint, lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return predicted(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
