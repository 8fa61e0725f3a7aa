"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

A text's pieces (pre-tokens) repeat, and different pieces share beginnings. The distinct pieces of a batch are inserted
into a trie by sorting: the path that a piece shares with the one before it is the part of the trie already walked. A
depth-first walk gives every node its last token, that is the last token of the encoding of the bytes from the root to it. It is the longest vocabulary token
that ends there and may follow the last token of the node where it begins; two tokens may follow each other if encoding
their joined bytes gives just these two. So encodings of shared beginnings are made once, and the whole encoding is read back from a
leaf through its last tokens. The outcome equals merging by rank.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.memory import trimmed

#: Pieces whose encodings a task keeps at most; and pairs of tokens.
KEEP = 300_000
#: Pieces longer than this are not kept from batch to batch.
LONG = 64

# The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Coder:
    """Encoder and decoder of one vocabulary file with its merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.special = special
        self.bytes_of = {v: k for k, v in raw.items()} | {v: k.encode() for k, v in special.items()}
        self.rank, self.parts = {}, {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = (m.split(" ") if isinstance(m, str) else m)
            a, b = bytes(of[c] for c in a), bytes(of[c] for c in b)
            if (raw[a], raw[b]) not in self.rank:
                self.rank[raw[a], raw[b]] = (n, raw[a + b])
        # a token that merging its own bytes doesn't give is never the last one
        self.vocab = {k: v for k, v in raw.items() if self.merged(list(k), raw) == [v]}
        self.longest: dict[bytes, int] = {}  # token that ends in these three bytes
        for k in self.vocab:
            self.longest[k[-3:]] = max(len(k), self.longest.get(k[-3:], 2))
        self.byte_id = [raw[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def merged(self, data: list[int], raw: dict[bytes, int]) -> list[int]:
        """Merging by rank, for the few bytes of one or two tokens."""
        ids = [raw[bytes([b])] for b in data]
        while len(ids) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i : i + 2] = [new]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 3 * KEEP:
                self.pairs.clear()
            data = self.bytes_of[a] + self.bytes_of[b]
            ids = [self.byte_id[x] for x in data]
            cut = len(self.bytes_of[a])
            found = self.pairs[key] = self._apart(ids, cut)
        return found

    def _apart(self, ids: list[int], cut: int) -> bool:
        """Whether merging by rank never joins the bytes before cut with those after it."""
        ends = list(range(1, len(ids) + 1))
        while len(ids) > 1:
            best = None
            for i in range(len(ids) - 1):
                r = self.rank.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best = (r[0], i, r[1])
            if best is None:
                break
            _, i, new = best
            if ends[i] == cut:
                return False
            ids[i : i + 2] = [new]
            del ends[i]
        return True

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The encoding of distinct pieces as little-endian 32-bit ids, by the walk over their trie."""
        vocab, longest, may_follow, pairs = self.vocab, self.longest, self.may_follow, self.pairs
        out, before = {}, b""
        last, size = [0], [0]  # of the path's nodes by depth: last token and its length
        for data, piece in sorted((p.encode(), p) for p in pieces):
            n = len(data)
            depth = 0
            shared = min(n, len(before))
            if data[:shared] == before[:shared]:
                depth = shared
            else:
                while data[depth] == before[depth]:
                    depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            for end in range(depth + 1, n + 1):
                for start in range(max(0, end - longest.get(data[max(0, end - 3) : end], 2)), end):
                    token = vocab.get(data[start:end])
                    if token is not None:
                        if start == 0:
                            break
                        ok = pairs.get(last[start] << 32 | token)
                        if ok is None:
                            ok = may_follow(last[start], token)
                        if ok:
                            break
                last.append(token)
                size.append(end - start)
            ids = []
            at = n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[piece] = struct.pack(f"<{len(ids)}I", *ids)
            before = data
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        find, special = self.pattern.findall, self.special
        split = []
        for t in texts:
            parts = self.split_special.split(t) if self.split_special and any(s in t for s in special) else [t]
            split.append([x for i, p in enumerate(parts) for x in ([p] if i % 2 else find(p))] if len(parts) > 1 else find(t))
        kept = self.kept
        if len(kept) >= KEEP:
            kept.clear()
        new = set()
        for pieces in split:
            new.update(pieces)
        new.difference_update(kept, special)
        made = self.encode_pieces(list(new))
        kept.update((p, x) for p, x in made.items() if len(p) <= LONG)
        for s, i in special.items():
            kept[s] = struct.pack("<I", i)
        look = {**made, **{s: kept[s] for s in special}} if any(len(p) > LONG for p in made) else None
        out = []
        for pieces in split:
            if look is None:
                out.append(b"".join(map(kept.__getitem__, pieces)))
            else:
                out.append(b"".join([kept[p] if p in kept else look[p] for p in pieces]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids given as little-endian 32-bit integers; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a Python worker and vocabulary file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the ids of the whole text as an array; null and empty texts have none. The vocabulary file at path must be there on every executor, as the library that reads it is."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            for a, texts in _portions(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), _lists(c.encode_batch(texts))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null array is an empty text."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id bigint, text string")


def _portions(batch: pa.RecordBatch, most: int = 4_000_000):
    """(first row, texts) of some million characters each."""
    first, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def digests(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids: what encoding and then decoding each whole text gives. Null texts count as empty; other columns play no part."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            for a, texts in _portions(batch):
                packed = c.encode_batch(texts)
                columns = {
                    "doc_id": batch.column(0).slice(a, len(texts)),
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(c.decode(p).encode()).hexdigest() for p in packed], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = _lists(packed)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def vocabulary() -> str:
    """The path of the public byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe_trie(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
