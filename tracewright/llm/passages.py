"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser positions: of every WINDOW consecutive GRAM-word hashes the
smallest is selected, so the words of a window of LEAST words alone decide, and any passage of LEAST words contains a selected
position, the same one in each of its copies. Then:

1. Copies of a whole text form a class; the copy with the smallest doc_id stands for it.
2. Each selected suffix sends its gram's hash, document and position. Grams of one document drop out.
3. The suffixes that remain carry their words around the position (hashes, bounded): LEAST to the right
   from it, LEAST - GRAM to the left. That suffices, since a longer passage has further selected positions.
4. Suffixes are sorted by gram and the words to the right, over as many tasks as they need: ranges of that order cut
   a frequent gram by its next words and then by document. In that order, and in the order of the words to the left, each is compared with its
   neighbours and with the earliest suffix of its gram nearby. The match is extended left and right; from LEAST words on it is a repeat.
5. Windows of LEAST words that the suffix was selected for and that no neighbour matched are left open: a suffix that is
   no neighbour, or lies beyond the end of a range, may have them. They are checked exactly, by the least document of each such window.
6. Repeats that touch are joined by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.memory import trimmed
from tracewright.llm.words import U, mix, slices
from tracewright.operators.graph import frequent, spread_join
from tracewright.workspace import discard, materialize

#: Words of the shortest passage that counts, of a gram, and grams that a window holds.
LEAST, GRAM = 50, 12
WINDOW = LEAST - GRAM + 1
WORD_COUNT = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"
WHITE = " \t\n\v\f\r"
COMPARED = "doc_id bigint, text_key bigint, start int, end int, other_doc_id bigint, window bigint"
_MULTIPLY = U(0xD1342543DE82EF95)


def select(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, word position within it, gram hash, low, high) of every minimiser of the documents whose word hashes lie at at[d]:at[d+1].

    low and high are the least and the most words that a window selecting it has before it. A window selects the leftmost of its equal smallest
    grams, but the last of a run of one gram that it begins with, so that a word repeated a thousand times
    gives few suffixes. Where that run fills the window, all such windows in a row have the same words, and each WINDOW-th selects its first gram, and the last.
    """
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) + (np.zeros(0, np.int32),) * 2
    g = np.zeros(n, U)
    for j in range(GRAM):
        g = g * _MULTIPLY + h[j : j + n]
    g = mix(g)
    lo, span = g.copy(), 1  # least over windows by doubling
    where = np.arange(n)
    while span < WINDOW:
        step = min(span, WINDOW - span)
        other, there = lo[step:], where[step:]
        lo, where = lo[: len(other)], where[: len(other)]
        less = other < lo
        lo, where = np.where(less, other, lo), np.where(less, there, where)
        span += step
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    last = np.flatnonzero(np.r_[g[1:] != g[:-1], True])
    end = last[np.searchsorted(last, where)]  # of the run of one gram
    first = np.arange(len(where))
    run = (where == first) & (end > where)
    full = run & (end >= where + WINDOW - 1)
    where = np.where(run & ~full, end, where)
    keep = doc[: len(where)] == doc[LEAST - 1 : LEAST - 1 + len(where)]
    same = np.flatnonzero(full & keep)
    if len(same):
        fresh = np.r_[True, same[1:] != same[:-1] + 1]
        place = np.arange(len(same)) - np.maximum.accumulate(np.where(fresh, np.arange(len(same)), 0))
        keep[same[(place % WINDOW > 0) & ~np.r_[fresh[1:], True]]] = False
    first, where = first[keep], where[keep]
    if not len(where):
        return select(h[:0], at)
    order = np.lexsort((first, where))
    first, where = first[order], where[order]
    cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    pos = where[cut]
    low, high = np.minimum.reduceat(where - first, cut), np.maximum.reduceat(where - first, cut)
    return doc[pos], pos - at[doc[pos]], g[pos], low.astype(np.int32), high.astype(np.int32)


def suffixes(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, text_key, pos, low, high) of every minimiser of docs(doc_id, text_key, text)."""

    def run(batches):
        for batch in batches:
            for a, b, w in slices(batch.column(2)):
                doc, pos, gram, low, high = select(w.hash, w.at)
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos.astype(np.int32)), pa.array(low), pa.array(high)], ["gram", "doc_id", "text_key", "pos", "low", "high"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(trimmed(run), "gram bigint, doc_id bigint, text_key bigint, pos int, low int, high int")


def _around(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words from each position on, and before it from the nearest on; 0 beyond the text."""
    v = np.maximum((h >> U(32)).astype(np.uint32), 1)
    padded = np.r_[np.zeros(LEAST, np.uint32), v, np.zeros(LEAST, np.uint32)]
    p = pos[:, None] + LEAST
    return padded[p + np.arange(LEAST)], padded[p - 1 - np.arange(LEAST - GRAM)]


def contexts(found: DataFrame) -> DataFrame:
    """(gram, doc_id, text_key, pos, low, high, right, left) of the marks of found(doc_id, text_key, text, marks), marks being structs of gram, pos, low and high."""
    names = ["gram", "doc_id", "text_key", "pos", "low", "high", "right", "left"]

    def run(batches):
        for batch in batches:
            for a, b, w in slices(batch.column(2)):
                marks = batch.column(3).slice(a, b - a)
                row, flat = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False)), marks.flatten()
                pos = flat.field("pos").to_numpy(zero_copy_only=False)
                first = np.searchsorted(row, np.arange(b - a + 1))
                right = np.zeros((len(pos), LEAST), np.uint32)
                left = np.zeros((len(pos), LEAST - GRAM), np.uint32)
                for d in range(b - a):
                    s = slice(first[d], first[d + 1])
                    right[s], left[s] = _around(w.hash[w.at[d] : w.at[d + 1]], pos[s])
                for c in range(0, len(pos), 20_000):
                    s = slice(c, c + 20_000)
                    rows = pa.array(row[s] + a)
                    blobs = [pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, x.nbytes + 1, 4 * x.shape[1], dtype=np.int32)), pa.py_buffer(x.astype(">u4").tobytes())]) for x in (right[s], left[s])]
                    own = [flat.field(k).slice(c, 20_000) for k in ("gram", "pos", "low", "high")]
                    yield pa.RecordBatch.from_arrays([own[0], batch.column(0).take(rows), batch.column(1).take(rows), *own[1:], *blobs], names)

    return found.select("doc_id", "text_key", "text", "marks").mapInArrow(trimmed(run), "gram bigint, doc_id bigint, text_key bigint, pos int, low int, high int, right binary, left binary")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    same = (x == y) & (x != 0)
    return np.where(same.all(1), x.shape[1], (~same).argmax(1))


def _compare(batches):
    """Repeats and open windows of a sorted partition. A batch is a stretch of the order; its first and last gram may go on beyond it."""
    for batch in batches:
        if batch.num_rows:
            yield from _stretch(batch).to_batches()


def _stretch(t: pa.RecordBatch) -> pa.Table:
    n = t.num_rows
    column = lambda k: t.column(t.schema.get_field_index(k))
    gram, doc, key, pos, low, high = (column(k).to_numpy(zero_copy_only=False) for k in ("gram", "doc_id", "text_key", "pos", "low", "high"))
    group = np.r_[0, np.cumsum(gram[1:] != gram[:-1])]
    before = np.frombuffer(b"".join(column("left").to_pylist()), ">u4").reshape(n, -1)
    right, left = np.frombuffer(b"".join(column("right").to_pylist()), ">u4").reshape(n, -1).astype(np.uint32), before.astype(np.uint32)
    by_left = np.argsort(np.ascontiguousarray(before).view(f"S{before.shape[1] * 4}").ravel(), kind="stable")
    by_left = by_left[np.argsort(group[by_left], kind="stable")]
    earliest = np.lexsort((pos, doc, group))
    pairs = np.concatenate([np.c_[np.arange(n - 1), np.arange(1, n)], np.c_[by_left[:-1], by_left[1:]], np.c_[np.arange(n), earliest[np.searchsorted(group[earliest], group)]]])
    pairs = pairs[(group[pairs[:, 0]] == group[pairs[:, 1]]) & (doc[pairs[:, 0]] != doc[pairs[:, 1]])]
    later = doc[pairs[:, 0]] > doc[pairs[:, 1]]
    i, j = np.unique(np.where(later[:, None], pairs, pairs[:, ::-1]), axis=0).T
    r, l = _common(right[i], right[j]), _common(left[i], left[j])
    hit = r + l >= LEAST
    i, j, r, l = i[hit], j[hit], r[hit], l[hit]
    repeats = _joined(doc[i], key[i], pos[i] - l, pos[i] + r, doc[j])
    # of a gram with two suffixes both were compared
    alone = (np.bincount(group)[group] == 2) & (group > 0) & (group < group[-1])
    places = LEAST - GRAM + 1
    some = np.flatnonzero(~alone)
    matched = np.zeros((n, places + 1), np.int32)  # by words before the position
    np.add.at(matched, (i, np.maximum(0, LEAST - r)), 1)
    np.add.at(matched, (i, l + 1), -1)
    before = np.arange(places)
    row, words = np.nonzero((matched.cumsum(1)[some, :places] == 0) & (before >= low[some, None]) & (before <= high[some, None]))
    around = np.concatenate([left[some][:, ::-1], right[some]], 1)
    v = np.zeros((len(some), places), U)
    for k in range(LEAST):
        v = v * _MULTIPLY + around[:, k : k + places]
    window, row = mix(v[row, places - 1 - words]), some[row]
    start = (pos[row] - words).astype(np.int32)
    found = pa.table({"doc_id": doc[row], "text_key": key[row], "start": start, "end": start + np.int32(LEAST), "other_doc_id": pa.nulls(len(row), pa.int64()), "window": window.view(np.int64)})
    return pa.concat_tables([repeats.append_column("window", pa.nulls(repeats.num_rows, pa.int64())), found])


def _joined(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> pa.Table:
    """Spans of one document that touch as one, with the smallest other document."""
    o = np.lexsort((start, key, doc))
    doc, key, start, end, other = doc[o], key[o], start[o], end[o], other[o]
    text = np.r_[0, np.cumsum((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))] if len(doc) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(end + text * (1 << 40)) - text * (1 << 40)
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] > reach[:-1])]) if len(doc) else np.zeros(0, np.int64)
    ends, others = (np.maximum.reduceat(end, first), np.minimum.reduceat(other, first)) if len(doc) else (end, other)
    return pa.table({"doc_id": doc[first], "text_key": key[first], "start": start[first].astype(np.int32), "end": ends.astype(np.int32), "other_doc_id": others})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, the hash that tells the texts of a repeated doc_id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, other_doc_id): words start to end of the text are a passage of LEAST words or more that an earlier document, other_doc_id, has too.

    Words are runs of other than ASCII white space, A-Z counting as a-z. Passages that touch are one row, with the
    smallest other_doc_id of them. The earliest document of a passage has no row for it, and neither
    have repeats within one document. Of equal texts all but the smallest doc_id's count as
    one passage, if they have LEAST words. Null and empty texts have no rows; nor have rows without doc_id.
    """
    own = keyed(docs).where("doc_id is not null and text is not null")
    classes = materialize(own.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.expr(WORD_COUNT)).alias("words")), "texts")
    grams = materialize(suffixes(own).groupBy("gram", "text_key", "pos").agg(F.min("doc_id").alias("doc_id"), F.min("low").alias("low"), F.max("high").alias("high")), "grams")
    stats = materialize(grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("gram", "n"), "shared")
    marks = (
        spread_join(grams, stats.select("gram"), "gram", "text_key", frequent(stats, "gram")[0])
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("gram", "pos", "low", "high")).alias("marks"))
    )
    around = materialize(contexts(own.join(marks.hint("merge"), ["doc_id", "text_key"])), "around")
    discard(grams)
    order = ["gram", "right", "doc_id", "pos"]
    compared = materialize(around.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(_compare), COMPARED), "compared")
    discard(around)
    open_ = compared.where("window is not null")
    least = materialize(open_.groupBy("window").agg(F.min("doc_id").alias("other"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("other < last").select("window", "other", "n"), "windows")
    checked = spread_join(open_, least.drop("n"), "window", "text_key", frequent(least, "window")[0]).where("other < doc_id").select("doc_id", "text_key", "start", "end", F.col("other").alias("other_doc_id"))
    spans = compared.where("window is null").drop("window").unionByName(checked)
    copies = (
        own.select("doc_id", "text_key")
        .join(classes.where("last > first").select("text_key", "first", "words"), "text_key")
        .where(f"doc_id > first and words >= {LEAST}")
        .select("doc_id", "text_key", F.lit(0).alias("start"), F.col("words").cast("int").alias("end"), F.col("first").alias("other_doc_id"))
    )
    of = Window.partitionBy("doc_id", "text_key")
    before = F.max("end").over(of.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("opens").over(of.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.unionByName(copies)
        .withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
        .withColumn("island", island)
        .groupBy("doc_id", "text_key", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_doc_id").alias("other_doc_id"))
        .drop("island")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the passages that repeats() finds, so that each stands in its first document alone.

    A document that only repeats others is dropped; one that had no words to begin with stays. n_chars, if there
    is such a column, follows the text. Rows without doc_id or text stay as they are.
    """
    cuts = repeats(docs).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    joined = docs.withColumn("_key", F.xxhash64("text")).join(
        cuts.withColumnsRenamed({"doc_id": "_id", "text_key": "_of"}).hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_of")), "left"
    ).drop("_key", "_id", "_of")
    columns = [c for c in joined.columns if c != "text"]

    def run(batches):
        for batch in batches:
            text, cuts = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("_cuts"))
            new = text.to_pylist()
            for a, b, w in slices(text):
                some = cuts.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)
                for d in np.flatnonzero(some).tolist():
                    first, keep, at = w.at[d], [], int(w.offsets[d])
                    for cut in cuts[a + d].as_py():
                        keep.append(w.bytes[at : w.start[first + cut["start"]]].tobytes())
                        at = int(w.end[first + cut["end"] - 1])
                    keep.append(w.bytes[at : w.offsets[d + 1]].tobytes())
                    new[a + d] = b"".join(keep).decode()
            keep = pa.array([c is False or bool(t.strip(WHITE)) for t, c in zip((t or "" for t in new), cuts.is_valid().to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(new, pa.string())], [*columns, "text"]).filter(keep)

    out = joined.select(*columns, "text").mapInArrow(trimmed(run), joined.select(*columns, "text").schema).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document has too: doc_id, start_word, end_word, n_words, other_doc_id."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "other_doc_id")
