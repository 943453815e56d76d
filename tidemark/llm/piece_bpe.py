"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white-space markers with the other characters up to the next marker. No piece has a marker behind
another character, so no merge crosses a chunk's border: each distinct chunk is segmented once, and a text's ids are
those of its chunks, joined back by position.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import small_batches
from tidemark.llm._text import lean

MARK = "▁"
#: Chunks that a task's table holds before it starts anew, and characters that are encoded at once.
HELD, SLICE_CHARS = 300_000, 1 << 20

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Kinds of pieces in a model file. Fixed values of the format.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _each_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("tidemark-each-byte", _each_byte)


def load_model(path: str) -> dict:
    """Pieces, scores, kinds and special ids of a model file (bounded by the file); only models whose pieces keep
    markers in front, that take texts as they are and fall back to bytes can be read by chunks: else a ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    found = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        found.ParseFromString(file.read())
    train, norm = found.trainer_spec, found.normalizer_spec
    pieces = [(p.piece, p.score, p.type) for p in found.pieces]
    across = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind == _NORMAL)
    kinds = {kind for _, _, kind in pieces} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.remove_extra_whitespaces or norm.precompiled_charsmap or found.denormalizer_spec.precompiled_charsmap)
    if across or not kinds or not plain or train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path} is no byte-pair model whose pieces stay between white-space markers")
    return {"pieces": pieces, "begin": train.bos_id, "end": train.eos_id}


class PieceBpe:
    """Segmenter and decoder of one model; made once in each worker."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.begin, self.end = model["begin"], model["end"]
        self.normal = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind == _NORMAL}
        self.bytes = [0] * 256
        said = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
                said.append(bytes([int(p[3:5], 16)]))
            else:
                said.append({_NORMAL: p.replace(MARK, " "), _UNKNOWN: " ⁇ ", _CONTROL: ""}[kind].encode())
        self.flat = np.frombuffer(b"".join(said), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(x) for x in said])])
        self.silent = np.array([kind == _CONTROL for _, _, kind in pieces])
        self.marked = np.array([kind == _NORMAL and p.startswith(MARK) for p, _, kind in pieces])

    def segment(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers: the best-scored neighbours are joined again and
        again, leftmost first among equals; characters without a piece become their bytes."""
        known, n = self.normal, len(chunk)
        if (whole := known.get(chunk)) and n == 1:
            return whole[1].to_bytes(4, "little")
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n  # a symbol of size 0 is gone
        queue = [(found[0], i, 2) for i in range(n - 1) if (found := known.get(chunk[i : i + 2]))]
        heapify(queue)
        while queue:
            _, i, length = heappop(queue)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != length:
                continue  # one of the two has been joined to something else meanwhile
            size[i], size[j] = length, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := known.get(chunk[i : k + size[k]]):
                    heappush(queue, (found[0], i, length + size[k]))
            if (h := before[i]) >= 0 and (found := known.get(chunk[h : i + length])):
                heappush(queue, (found[0], h, size[h] + length))
        out, i = array("I"), 0
        while i < n:
            piece = chunk[i : i + size[i]]
            if found := known.get(piece):
                out.append(found[1])
            else:
                out.extend([self.bytes[b] for b in piece.encode()])
            i = after[i]
        return out.tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; a marker's space in front of it is taken off, bytes that are no character become U+FFFD."""
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        raw = gather(self.flat, self.off, ids)
        text = raw.tobytes().decode("utf-8", "tidemark-each-byte")
        return text[1:] if self.marked[ids[0]] else text


def gather(flat: np.ndarray, off: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat[off[c] : off[c + 1]] of every code, one after the other."""
    sizes = off[codes + 1] - off[codes]
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    return flat[np.arange(n) + np.repeat(off[codes] - total + sizes, sizes)]


class _Codes(dict):
    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        return code


class ChunkTable:
    """Ids of texts by a table of their distinct chunks, each of which is segmented once.

    The table grows over the texts that it is given and starts anew at HELD chunks (a single text may have more).
    """

    def __init__(self, own: PieceBpe):
        self.own, self.codes = own, _Codes()
        self.pieces, self.sizes = [], array("I")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        if len(self.codes) >= HELD:
            self.codes, self.pieces, self.sizes = _Codes(), [], array("I")
        counts, codes = [0], array("I")
        for text in texts:
            if text:
                codes.extend(map(self.codes.__getitem__, _CHUNK.findall(MARK + text.replace(" ", MARK))))
            counts.append(len(codes))
        for chunk in itertools.islice(self.codes, len(self.pieces), None):
            self.pieces.append(ids := self.own.segment(chunk))
            self.sizes.append(len(ids) // 4)
        flat = np.frombuffer(b"".join(self.pieces), "<i4")
        off = np.concatenate([[0], np.cumsum(np.frombuffer(self.sizes, np.uint32), dtype=np.int64)])
        places = np.frombuffer(codes, np.uint32).astype(np.int64)  # where each chunk of the texts stands in the table
        return [gather(flat, off, places[a:b]) for a, b in itertools.pairwise(counts)]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about SLICE_CHARS characters."""
    first, texts, chars = 0, [], 0
    for i, text in enumerate(batch.column(1)):
        texts.append(text.as_py() or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS:
            yield first, texts
            first, texts, chars = i + 1, [], 0
    if texts:
        yield first, texts


_loaded: dict[str, PieceBpe] = {}


def _worker(model) -> PieceBpe:
    key = model.value["key"]
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceBpe(model.value)
    return _loaded[key]


def _shipped(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(load_model(path) | {"key": path})


def _encoded(model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, PieceBpe, list[np.ndarray]]]:
    """Rows' ids and their texts' ids with begin and end around them, by one chunk table a task."""
    own = _worker(model)
    table, first, last = ChunkTable(own), np.array([own.begin], "<i4"), np.array([own.end], "<i4")
    for batch in batches:
        for at, texts in _groups(batch):
            yield batch.column(0).slice(at, len(texts)), own, [np.concatenate([first, ids, last]) for ids in table.encode(texts)]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array<int>) of every row: the ids of the whole text with the begin and end ids around them.

    A null text encodes like an empty one, to these two. Null and repeated ids are kept, a row each; further columns
    may have any name and are left out. An empty table gives none.

    A task keeps a table of the distinct chunks it has met (of HELD at most, then a new one), segments each once and
    joins ids back by the chunks' places. Nothing is shuffled: a table of the whole corpus' chunks would be, with a row
    for each chunk and block of texts, and that costs more than segmenting a rare chunk in several tasks.
    """
    model = _shipped(df, path)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, ids in _encoded(model, batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(ids_of), "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for (null ids: an empty one); a column of that name is replaced."""
    model = _shipped(df, path)

    @F.pandas_udf("string")
    def text_of(ids):
        import pandas as pd

        own = _worker(model)
        return pd.Series([own.decode(np.asarray(x if x is not None else [], np.int64)) for x in ids])

    return df.withColumn(text_col, text_of(ids_col))


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian 32-bit) and of the text decoded from them.

    One row for each of ``df``; nulls, repeated ids, further columns and empty tables as in :func:`encode`.
    """
    model = _shipped(df, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own, found in _encoded(model, batches):
            counts = pa.array([len(ids) for ids in found], pa.int64())
            first = pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids in found], pa.string())
            second = pa.array([hashlib.sha256(own.decode(ids).encode()).hexdigest() for ids in found], pa.string())
            yield pa.RecordBatch.from_arrays([keys, counts, first, second], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
