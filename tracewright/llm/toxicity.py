"""Toxicity from a weighted lexicon that Aho-Corasick finds in folded text, normalised by length, with exception phrases.

Folding writes look-alike letters of other scripts as Latin ones and digits or signs inside a word as the letters they
stand for, lower-cases, and leaves words of letters and digits with one blank between. A lexicon entry is a whole word or
a word's beginning; a word counts by its heaviest entry, unless an exception phrase covers it.

Entries beyond a short seed list are learnt: for whole words and their beginnings, how many (document, word) pairs toxic
and other labelled documents have. The weight is the log odds over the base rate. The score is a
logistic function of the heaviest entry, the sum of weights and the hits by length; it is fitted on the same rows with each
row's own counts taken out, so that an entry seen in one document alone doesn't speak for it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.memory import trimmed

#: Labelled rows that the lexicon and the score are learnt from at most, the first by a hash of doc_id.
FIT_ROWS = 20_000
#: Toxic pairs and log odds that a learnt entry needs. So the lexicon is as large as FIT_ROWS rows make it.
LEAST_TOXIC, LEAST_WEIGHT = 3, 2.0
PREFIXES = range(4, 11)
THRESHOLD = 0.7

# Common English insults that start the lexicon.
SEEDS = "idiot moron stupid imbecile loser scum trash pathetic worthless disgusting clown dumbass asshole bastard bitch retard jerk scumbag vermin subhuman".split()
# Phrases in which such words mean no insult.
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "clown fish", "class clown", "trash collection", "sore loser award", "idiot proof", "idiot light"]
# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_FOLD = str.maketrans(LOOK_ALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {c: None for c in "­​‌‍⁠﻿"})
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_SIGNS = re.compile(r"(?<=[^\W\d_])[01345780@$!|]+(?=[^\W\d_])|(?<![^\s(\"'])[@$10345](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)


def folded(text: str | None) -> list[str]:
    """The folded words of a text; none for null or empty."""
    t = (text or "").lower()
    if not t.isascii() and _ODD.search(t):
        t = t.translate(_FOLD)
    return _WORD.findall(_SIGNS.sub(lambda m: m[0].translate(_SUBSTITUTE), t))


def entry_counts(docs: DataFrame) -> DataFrame:
    """(entry, toxic, other) over docs(text, toxic): entry is a word with "=" before it or a word's beginning."""

    def run(batches):
        for batch in (b.slice(i, 1_000) for b in batches for i in range(0, b.num_rows, 1_000)):
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else other).update(set(folded(text)))
            words = list(toxic | other)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], ["word", "toxic", "other"])

    words = docs.select("text", "toxic").mapInArrow(trimmed(run), "word string, toxic bigint, other bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    starts = [F.when(F.char_length("word") >= n, F.expr(f"left(word, {n})")) for n in PREFIXES]
    return words.select(F.explode(F.array_compact(F.array(F.concat(F.lit("="), "word"), *starts))).alias("entry"), "toxic", "other").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def uncovered(hits: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that begin in none of the spans, by one sweep over both in order."""
    out, spans, reach = {}, iter(sorted(spared)), -1
    span = next(spans, None)
    for at in sorted(hits):
        while span and span[0] <= at:
            reach = max(reach, span[1])
            span = next(spans, None)
        if at >= reach:
            out[at] = hits[at]
    return out


class Model:
    """The lexicon {entry: (toxic, other)}, the base log odds and the coefficients of the score."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], base: float, coefficients: list[float]):
        self.lexicon, self.base, self.coefficients = lexicon, base, coefficients
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def weight(self, toxic: int, other: int) -> float:
        return math.log((toxic + 0.5) / (other + 1.0)) - self.base

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, (toxic, other) in self.lexicon.items():
                pattern = f" {entry[1:]} " if entry[0] == "=" else f" {entry}"
                a.add_word(pattern, (len(pattern), toxic, other))
            for phrase in EXCEPTIONS:
                a.add_word(f" {phrase} ", (len(phrase) + 2, -1, phrase.count(" ")))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None, label: int | None = None) -> list[float]:
        """Heaviest entry, log of the sum of weights, log of hits by length; a label takes the row's own counts out."""
        words = folded(text)
        line = f" {' '.join(words)} "
        own = (0, 0) if label is None else (label, 1 - label)
        hits, spared = {}, []
        for end, (length, toxic, other) in self.automaton().iter(line):
            start = end - length + 1
            if toxic < 0:
                spared.append((start, end))
            elif toxic - own[0] >= LEAST_TOXIC:
                w = self.weight(toxic - own[0], max(0, other - own[1]))
                if w > hits.get(start, 0.0):
                    hits[start] = w
        if spared and hits:
            hits = uncovered(hits, spared)
        return [max(hits.values(), default=0.0), math.log1p(sum(hits.values())), math.log((len(hits) + 0.5) / (len(words) + 20.0)) if hits else -8.0]

    def score(self, text: str | None) -> float:
        x = self.features(text)
        z = self.coefficients[-1] + sum(c * v for c, v in zip(self.coefficients, x, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Of a model with too few labels: the heaviest entry decides.
DEFAULT = [1.0, 0.5, 0.3, -3.0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients and last the intercept, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w * np.r_[np.ones(len(w) - 1), 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[np.full(len(w) - 1, ridge), 1e-6])
        w -= np.linalg.solve(h, g)
    return w


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, text, toxic) of at most FIT_ROWS labels whose crc32(doc_id) mod 3 is not 1, a row for each text of their documents. The labels chosen are that few, so they can be broadcast to the texts."""
    of = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    chosen = of.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(FIT_ROWS)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = math.log((toxic + 0.5) / (n - toxic + 1.0)) if n else -2.0
    weight = F.log((F.col("toxic") + 0.5) / (F.col("other") + 1.0)) - base
    counted = entry_counts(rows).where((F.col("toxic") >= LEAST_TOXIC) & (weight >= LEAST_WEIGHT))
    learnt = {e: (t, o) for e, t, o in counted.orderBy("entry").collect()}
    for w in SEEDS:
        t, o = learnt.get(f"={w}", (0, 0))
        learnt[f"={w}"] = (t + 20, o)
    model = Model(learnt, base, DEFAULT)
    kept = {}
    for entry, counts in learnt.items():  # an entry no heavier than one of its beginnings never counts
        word = entry.lstrip("=")
        shorter = [learnt[word[:k]] for k in PREFIXES if k < len(word) + (entry[0] == "=") and word[:k] in learnt]
        if all(model.weight(*counts) > model.weight(*s) for s in shorter):
            kept[entry] = counts
    model = Model(kept, base, DEFAULT)
    if min(toxic, n - toxic) < 5:
        return model

    def run(batches):
        for batch in batches:
            rows = [[*model.features(t, y), float(y)] for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.float64()) for c in np.array(rows).reshape(-1, 4).T]], ["id", "a", "b", "c", "y"])

    # of a label's texts one stands for all, so that no more rows come here than labels were chosen
    kind = rows.schema["_id"].dataType.simpleString()
    told = rows.mapInArrow(trimmed(run), f"id {kind}, a double, b double, c double, y double").groupBy("id", "y").agg(F.min(F.struct("a", "b", "c")).alias("x"))
    xy = np.array([tuple(r) for r in told.select("x.a", "x.b", "x.c", "y").collect()])
    xy = xy[np.lexsort(xy.T)]
    model.coefficients = logistic(xy[:, :3], xy[:, 3]).tolist()
    return model


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score (0 to 1) and a prediction (1 from THRESHOLD on), which take the place of columns of those names. Null and empty texts have no hit and get the lowest score; other columns stay as they are."""
    kept = docs.drop(score, predicted)
    columns = [*kept.columns, score, predicted]
    schema = kept.withColumns({score: F.lit(0.0), predicted: F.lit(0)}).schema

    def run(batches):
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], columns)

    return kept.mapInArrow(trimmed(run), schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    return scored(docs, model, "_score", "_predicted").where("_predicted = 0").select(*docs.columns)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
