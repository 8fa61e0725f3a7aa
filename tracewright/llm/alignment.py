"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

A, a byte-level vocabulary, and B, a piece model, both begin a token at a space that follows a visible character, and at a mark that follows a letter, so a
text falls into segments that are aligned apart; each distinct segment of a task is encoded and aligned once. Links are the
pairs of an A and a B token whose byte ranges overlap. A pair of ids is one 64-bit key, B's id above A's.

First pass: np.unique counts a task's keys. The counts are sorted over the cluster by ranges of keys; each task sums runs of
equal keys and leaves a shard, two arrays of sorted keys and counts, in the shared folder. Second pass: tasks map the shards into memory
and look their keys up by binary search.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tracewright.llm import bpe, chunks, pieces
from tracewright.llm.memory import trimmed
from tracewright.llm.merging import Merges
from tracewright.llm.words import text_arrays
from tracewright.workspace import materialize, shared_dir

COLUMNS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_LOW = (1 << 32) - 1
# The last two bytes of white space beyond ASCII.
_WIDE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), (0x81, 0x9F), *[(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)]]


def before_words(data: np.ndarray) -> np.ndarray:
    """Where a space follows a byte that ends no white space: there both tokenizers begin a token, whatever comes before or after."""
    out = data == 32
    last = data[:-1]
    blank = (last == 32) | (last >= 9) & (last <= 13) | (last >= 28) & (last <= 31)
    for a, b in _WIDE:
        hit = last == b
        hit[1:] &= data[:-2] == a
        blank |= hit
    out[1:] &= ~blank
    return out


def starts(c: pieces.PieceCoder):
    """Where segments begin. A's words end where letters end, and none begins within white space but at its last blank; B's pieces may say more."""
    return (lambda data: before_words(data) | chunks.beside_letters(data)) if c.letters_apart else before_words


class Aligner:
    """Tokens, groups and links of segments for one pair of vocabularies. Special tokens of A are plain text."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        of = bpe.byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        joins = []
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(of[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            joins.append((raw[a], raw[b], n, raw[a + b]))
        self.merges = Merges(*(np.array(x, np.int64) for x in zip(*joins, strict=True)))
        self.byte_id = np.array([raw[bytes([b])] for b in range(256)], np.int32)
        self.size = np.zeros(max(raw.values()) + 1, np.int64)
        for k, v in raw.items():
            self.size[v] = len(k)
        self.find = regex.compile(bpe.PATTERN).findall
        self.b = pieces.coder(path_b)
        self.digits = pa.array([b"%d," % i for i in range(max(len(self.size), len(self.b.names)))], pa.large_binary())

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of each segment, flat, and where each begins (one entry more)."""
        data, edges = text_arrays(parts)
        data, edges = data[edges[0] : edges[-1]], edges - edges[0]
        found = [self.find(x.decode()) for x in parts.to_pylist()]
        lead = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        ends = lead[np.cumsum([0, *map(len, itertools.chain.from_iterable(found))])]
        ids, at = self.merges(self.byte_id[data], ends)
        return ids, at[np.cumsum([0, *map(len, found)])]

    def make(self, parts: pa.Array, look=None) -> dict:
        """For a table of segments: the keys of all links and how many a segment has; with look, which gives counts and whether they are their B id's highest, all that the result has of a segment."""
        a_ids, a_at = self.encode(parts)
        b_ids, b_at = self.b.segment(parts)
        a_end, b_end = np.cumsum(self.size[a_ids]), np.cumsum(self.b.size[b_ids])
        if len(a_ids) and a_end[-1] != b_end[-1]:
            raise ValueError("the tokens of the two vocabularies don't cover the same bytes")
        low = np.searchsorted(b_end, a_end - self.size[a_ids], "right")
        high = np.searchsorted(b_end - self.b.size[b_ids], a_end, "left")
        n = high - low
        at = np.r_[0, np.cumsum(n)][a_at]
        b = np.repeat(low - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())
        keys = b_ids[b].astype(np.int64) << 32 | np.repeat(a_ids, n)
        if look is None:
            return {"keys": keys, "n_links": np.diff(at)}
        count, best = look(keys)
        common = a_end[np.isin(a_end, b_end, assume_unique=True)]
        of_a, of_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][at])
        _, edges = text_arrays(parts)
        groups = np.diff(np.searchsorted(common, edges - edges[0], "right"))
        # a1,a2|b1;: tokens of a group in order, A's before B's, each with the sign that follows it
        kind = np.r_[of_a * 2, of_b * 2 + 1]
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        text, cuts = text_arrays(self.digits.take(pa.array(np.r_[a_ids, b_ids][order])))
        text = text[cuts[0] : cuts[-1]].copy()
        last = np.r_[kind[1:] != kind[:-1], True] if len(kind) else np.zeros(0, bool)
        text[(cuts[1:] - cuts[0] - 1)[last]] = np.where(kind[last] % 2, ord(";"), ord("|"))
        return {
            "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": groups, "n_links": np.diff(at), "n_best": sums(best), "count_sum": sums(count),
            "text": chunks.binary(text, (cuts - cuts[0])[(a_at + b_at)]),
        }


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a Python worker and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _cut(batches, table, where=before_words):
    """(rows of doc_id, numbers of all segments, where each text's begin) by slices. Texts that B can't give back (they hold its marker) have no segments."""
    for batch in batches:
        for row, texts in chunks.slices(batch.column(1)):
            keys = batch.column(0).slice(row, len(texts))
            texts = texts.cast(pa.large_string()).fill_null("")
            texts = chunks.marked(pc.if_else(pc.match_substring(texts, pieces.MARKER), pa.scalar("", pa.large_string()), texts))
            parts, at = chunks.cut(texts, where)
            yield keys, table.numbers(parts), at


def _runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and the sums of their counts."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, n): how many links of a task's texts have the key; a key comes once or more from each task."""

    def run(batches):
        a = aligner(path_a, path_b)
        table, often = chunks.Table(a.make), np.zeros(0, np.int64)

        def flush():
            keys, links = table.column("keys"), table.column("n_links")
            distinct, back = np.unique(keys, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            np.add.at(n, back, np.repeat(often, links))
            for i in range(0, len(distinct), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(distinct[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["key", "n"])

        for _, numbers, _ in _cut(batches, table, starts(a.b)):
            more = np.bincount(numbers, minlength=table.n)
            more[: len(often)] += often
            often = more
            if table.full():
                yield from flush()
                table.start_anew()
                often = np.zeros(0, np.int64)
        if table.n:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "key bigint, n bigint")


def _shared_uri(spark) -> str:
    """The shared folder with its store's name, so that pyarrow opens what Spark means by it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return f"file:///{uri.removeprefix('file:').lstrip('/')}" if uri.startswith("file:") else uri


def count_shards(counts: DataFrame) -> DataFrame:
    """(path, first, n, ids, most): sorted counts of all keys, a shard a range of keys, left in the shared folder as <path>.keys and <path>.counts; ids and most: the highest count of each B id in it.

    counts(key, n) should be a written table, as ranges are sampled from it. Only shards whose row was returned belong to the result; a task that ran twice leaves files that none reads.
    """
    folder = f"{_shared_uri(counts.sparkSession)}/pair-counts-{uuid.uuid4().hex}"

    def run(batches):
        place, top = fs.FileSystem.from_uri(folder)
        place.create_dir(top)
        name = f"{top}/{uuid.uuid4().hex}"
        first, n, ids, most = None, 0, [], []
        held_k, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        with place.open_output_stream(f"{name}.keys") as keys_to, place.open_output_stream(f"{name}.counts") as counts_to:
            for batch in itertools.chain(batches, [None]):
                if batch is None:
                    k, c, end = held_k, held_n, len(held_k)
                else:
                    k, c = _runs(np.r_[held_k, batch.column(0).to_numpy()], np.r_[held_n, batch.column(1).to_numpy()])
                    end = max(0, len(k) - 1)  # the last key may go on in the next batch
                held_k, held_n = k[end:], c[end:]
                if end:
                    first = int(k[0]) if first is None else first
                    keys_to.write(k[:end].tobytes())
                    counts_to.write(c[:end].tobytes())
                    n += end
                    start = np.flatnonzero(np.r_[True, np.diff(k[:end] >> 32) > 0])
                    ids += (k[start] >> 32).tolist()
                    most += np.maximum.reduceat(c[:end], start).tolist()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([n]), pa.array([ids], pa.list_(pa.int32())), pa.array([most], pa.list_(pa.int64()))], ["path", "first", "n", "ids", "most"])
        else:
            for x in (".keys", ".counts"):
                place.delete_file(name + x)

    made = counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "path string, first bigint, n bigint, ids array<int>, most array<bigint>")
    out = materialize(made, "count-shards")
    out._folder = folder
    return out


class Counts:
    """Look-up in shards; each is mapped into memory when a key of its range first comes."""

    def __init__(self, folder: str, shards: list[tuple[str, int, int]]):
        self.place = fs.FileSystem.from_uri(folder)[0]
        self.shards = sorted(shards, key=lambda s: s[1])
        self.first = np.array([s[1] for s in self.shards], np.int64)
        self.mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _map(self, path: str) -> np.ndarray:
        if isinstance(self.place, fs.LocalFileSystem):
            return np.memmap(path, np.int64, "r")
        with self.place.open_input_stream(path) as f, tempfile.TemporaryFile() as own:  # gone from the disk when unmapped
            shutil.copyfileobj(f, own)
            own.flush()
            return np.memmap(own, np.int64, "r")

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct keys, all of which must be there."""
        out = np.empty(len(keys), np.int64)
        shard = np.searchsorted(self.first, keys, "right") - 1
        for i in np.unique(shard).tolist():
            if i not in self.mapped:
                self.mapped[i] = tuple(self._map(self.shards[i][0] + x) for x in (".keys", ".counts"))
            mine = shard == i
            known, counts = self.mapped[i]
            at = np.searchsorted(known, keys[mine])
            if not np.array_equal(known[np.minimum(at, len(known) - 1)], keys[mine]):
                raise ValueError("a key has no count: the texts are not those that were counted")
            out[mine] = counts[at]
        return out


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row's text, as one token list of each vocabulary aligned by bytes.

    Null and empty texts, and those with B's marker in them, have no tokens: zeros and an empty digest. A repeated row stands and counts as often as it occurs; a null
    doc_id stays null; other columns play no part. docs is read twice and must be the same both times. The shared folder must be one that pyarrow opens too
    (a mounted path, HDFS, S3, GCS). Pairs of ids are as many as the vocabularies allow at most, whatever the corpus, and only B's own ids (some ten thousands) come to the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = count_shards(materialize(pair_counts(docs, path_a, path_b), "pair-parts"))
    shards = [(r.path, r.first, r.n) for r in made.select("path", "first", "n").collect()]
    highest = {r.b: r.most for r in made.select(F.explode(F.arrays_zip("ids", "most")).alias("x")).groupBy(F.col("x.ids").alias("b")).agg(F.max("x.most").alias("most")).collect()}
    top = np.zeros(max(highest, default=0) + 1, np.int64)
    top[list(highest)] = list(highest.values())
    folder, shared = made._folder, spark.sparkContext.broadcast((shards, top))

    def run(batches):
        a = aligner(path_a, path_b)
        shards, top = shared.value
        counts = Counts(folder, shards)

        def look(keys):
            distinct, back = np.unique(keys, return_inverse=True)
            n = counts.of(distinct)
            return n[back], (n == top[distinct >> 32])[back]

        table = chunks.Table(lambda parts: a.make(parts, look))
        for keys, numbers, at in _cut(batches, table, starts(a.b)):
            if len(numbers):
                text, cuts = chunks.joined(table.column("text"), numbers, at)
                sums = [np.diff(np.r_[0, np.cumsum(table.column(x)[numbers])][at]) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
            else:
                text, cuts, sums = memoryview(b""), np.zeros(len(at), np.int64), [np.zeros(len(keys), np.int64)] * 6
            digest = [hashlib.sha256(text[a:b]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist(), strict=True)]  # without the last ;
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x.astype(np.int64)) for x in sums], pa.array(digest, pa.string())], [c.split()[0] for c in COLUMNS.split(", ")])
            if table.full():
                table.start_anew()

    return docs.mapInArrow(trimmed(run), COLUMNS)


def op13_pair_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens by the byte-level vocabulary and the piece model, aligned."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), bpe.vocabulary(), pieces.vocabulary())
