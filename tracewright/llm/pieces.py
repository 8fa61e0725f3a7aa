"""SentencePiece encoding and decoding by a table of distinct chunks (BPE models with byte fallback).

Spaces are written as markers, and no piece of the vocabulary has a marker after another character. So a text falls
into chunks (markers and what follows up to the next marker, marks behind a word apart) that are encoded apart: each distinct chunk of a task is
segmented once, and a text's ids are joined from the table by the positions of its chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewright.llm import chunks
from tracewright.llm.memory import trimmed
from tracewright.llm.merging import Merges
from tracewright.llm.words import text_arrays

# The marker that stands for a space, the model's kinds of pieces, and what an unknown piece decodes to.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT = " ⁇ "
#: The symbol of a character that no piece has; no pair knows it.
STRANGE = 1 << 29


class PieceCoder:
    """Encoder and decoder of one model file. ValueError for models that aren't BPE, that change texts beyond marking spaces, whose pieces cross markers, or that lack byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        train, norm = model.trainer_spec, model.normalizer_spec
        if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte pieces that keep texts as they are, with a marker before the first word")
        kinds = [p.type for p in model.pieces]
        if USER in kinds or UNUSED in kinds:
            raise ValueError("models with pieces of the user's own are not supported")
        self.kind = np.array(kinds)
        self.begin, self.end = train.bos_id, train.eos_id
        self.names = [p.piece for p in model.pieces]
        surface = [bytes([int(p.piece[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else p.piece.replace(MARKER, " ").encode() for p, k in zip(model.pieces, kinds, strict=True)]
        self.surface = pa.array(surface, pa.large_binary())
        self.size = np.array([len(x) for x in surface])
        self.byte_id = np.zeros(256, np.int32)
        for i, (x, k) in enumerate(zip(surface, kinds, strict=True)):
            if k == BYTE:
                self.byte_id[x[0]] = i
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARKER in p.lstrip(MARKER) for p in normal):
            raise ValueError("a piece crosses a marker")
        #: Whether no piece has a letter before a mark or line end, or behind a line end, so that chunks may end there too.
        self.letters_apart = not any("\n" in p or chunks.beside_letters(np.frombuffer(p.encode(), np.uint8)).any() for p in normal)
        # every character of a piece is a symbol; those that are no pieces themselves get ids behind the vocabulary
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbol[c] = len(self.names) + len(symbol) - len(normal)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.symbol_of[32] = self.symbol_of[ord(MARKER)]
        order = np.argsort(np.array([-p.score for p in model.pieces]), kind="stable")
        rank = np.empty(len(order), np.int64)
        score = np.array([p.score for p in model.pieces])[order]
        rank[order] = np.r_[0, np.cumsum(np.diff(score) != 0)]  # equal scores have equal ranks
        pairs = [(symbol[p[:k]], symbol[p[k:]], rank[i], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.merges = Merges(*(np.array(x, np.int64) for x in zip(*pairs, strict=True))) if pairs else Merges(*(np.zeros(0, np.int64),) * 4)

    def segment(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each part, a run of UTF-8 with spaces for markers, flat, and where each begins (one entry more)."""
        data, edges = text_arrays(parts)
        data = data[edges[0] : edges[-1]]
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(lead, edges - edges[0])
        symbol = self.symbol_of[code]
        other = symbol < 0
        symbol[other] = STRANGE
        ids, ends = self.merges(symbol, at)
        return self._bytes(ids, ends, code[other]) if (ids >= len(self.names)).any() else (ids, ends)

    def _bytes(self, ids, ends, strange):
        """Byte pieces for symbols that are no pieces: strange characters in their order, and single characters that only occur inside pieces."""
        away = ids == STRANGE
        inner = (ids >= len(self.names)) & ~away
        text = np.full(len(ids), None, object)
        text[away] = [chr(c) for c in strange.tolist()]
        if inner.any():
            letter = {int(self.symbol_of[c]): chr(c) for c in np.flatnonzero(self.symbol_of >= len(self.names))}
            text[inner] = [letter[i] for i in ids[inner].tolist()]
        odd = np.flatnonzero(away | inner)
        raw = [t.encode() for t in text[odd].tolist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(b) for b in raw]
        to = np.r_[0, np.cumsum(n)]
        out = np.empty(to[-1], np.int32)
        plain = np.ones(len(ids), bool)
        plain[odd] = False
        out[to[:-1][plain]] = ids[plain]
        flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        out[np.repeat(to[odd] - np.r_[0, np.cumsum(n[odd])[:-1]], n[odd]) + np.arange(len(flat))] = flat
        return out, to[ends]

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Where chunks begin: at markers, and beside letters where the vocabulary allows it, so that a word is one chunk with and without a mark behind it."""
        out = chunks.before_spaces(data)
        return out | chunks.beside_letters(data) if self.letters_apart else out

    def table(self) -> chunks.Table:
        def make(parts):
            ids, ends = self.segment(parts)
            return {"ids": chunks.binary(ids.astype("<u4").view(np.uint8), ends * 4)}

        return chunks.Table(make)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: control pieces are nothing, runs of byte pieces are UTF-8 in which each wrong byte becomes U+FFFD, the first marker goes."""
        out, run, marked = [], bytearray(), False
        flush = lambda: (out.append(_utf8(bytes(run))), run.clear())
        for i in ids:
            if self.kind[i] == BYTE:
                run += bytes(self.surface[i].as_py())
                continue
            if run:
                flush()
            if self.kind[i] == UNKNOWN:
                out.append(UNKNOWN_TEXT)
            elif self.kind[i] != CONTROL:
                name = self.names[i]
                if not marked and not any(out) and name.startswith(MARKER):
                    name, marked = name[1:], True
                out.append(name.replace(MARKER, " "))
        if run:
            flush()
        return "".join(out)


def _utf8(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder a Python worker and model file."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def _ids(c: PieceCoder, batches):
    """(rows of doc_id, ids of all their texts as bytes, where each text's begin) by slices of texts. A marker in a text is a space."""
    table = c.table()
    for batch in batches:
        for row, texts in chunks.slices(batch.column(1)):
            texts = pc.replace_substring(chunks.marked(texts), MARKER, " ")
            if table.full():
                table.start_anew()
            parts, at = chunks.cut(texts, c.starts)
            data, edges = chunks.joined(table.column("ids"), numbers, at) if len(numbers := table.numbers(parts)) else (memoryview(b""), np.zeros(len(texts) + 1, np.int64))
            yield batch.column(0).slice(row, len(texts)), data, edges


def encoded(docs: DataFrame, path: str, ends: bool = False) -> DataFrame:
    """(doc_id, ids) with the ids of the whole text as an array, with begin and end ids if asked for; null and empty texts have none but these. The model file must be there on every executor, as the library that reads it is."""

    def run(batches):
        c = coder(path)
        for keys, data, edges in _ids(c, batches):
            flat, at = np.frombuffer(data, "<i4"), edges // 4
            if ends:
                to = at + 2 * np.arange(len(at))
                wide = np.empty(to[-1], np.int32)
                wide[np.arange(len(flat)) + np.repeat(2 * np.arange(len(at) - 1) + 1, np.diff(at))] = flat
                wide[to[:-1]], wide[to[1:] - 1] = c.begin, c.end
                flat, at = wide, to
            yield pa.RecordBatch.from_arrays([keys, pa.LargeListArray.from_arrays(pa.array(at), pa.array(flat)).cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null array is an empty text."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(trimmed(run), "doc_id bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding each whole text with begin and end ids and then decoding gives.

    Null texts count as empty: two ids, and the empty text again. A repeated row stands as often as it occurs; a null doc_id stays null; other columns play no part.
    """

    def run(batches):
        c = coder(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (c.begin, c.end))
        for keys, data, edges in _ids(c, batches):
            ids = np.frombuffer(data, "<i4")
            text, cuts = chunks.joined(c.surface, ids, edges // 4) if len(ids) else (memoryview(b""), np.zeros(len(edges), np.int64))
            n, ids_hash, text_hash = [], [], []
            for a, b, s, t in zip(edges[:-1].tolist(), edges[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                h = hashlib.sha256(begin)
                h.update(data[a:b])
                h.update(end)
                n.append((b - a) // 4 + 2)
                ids_hash.append(h.hexdigest())
                text_hash.append(hashlib.sha256(text[s + (t > s) : t]).hexdigest())  # without the marker before the first word
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    """The path of the public piece model."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_piece_chunks(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
