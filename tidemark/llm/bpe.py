"""Byte-pair encoding with word ends: merges by a priority queue of ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import small_batches
from tidemark.llm._text import give_back, kept, lean

#: Bytes of a worker's caches of encoded pieces and of parts of pieces, about (twice as many at most are held), and
#: characters of the longest one that is kept.
PIECE_BYTES, PART_BYTES, CACHE_CHARS = 24 << 20, 2 << 20, 64
_ENTRY_BYTES = 220  # of an entry, besides its characters and ids

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_GAP = regex.compile(r"\p{White_Space}+")
#: Characters that str.split() takes for white space and Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARKS = ".,;:!?"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


def load_model(path: str) -> dict:
    """What tasks need of a tokenizer file: vocabulary, ranked merges and special tokens (bounded by the file)."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model = found["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "end": model.get("end_of_word_suffix") or "", "special": {t["content"]: t["id"] for t in found["added_tokens"]}}


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class _Recent(dict):
    """Values by key, made when first asked for. When it is full, what it held is kept aside and moves back if asked for.

    Words with a mark behind them aren't kept: they are put together from the word and the mark, which are.
    """

    def __init__(self, make, size: int):
        self.make, self.size, self.older, self.held = make, size, {}, 0

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > CACHE_CHARS or key[-1] in _MARKS and key[:-1].isalpha():
                return found
        self.held += _ENTRY_BYTES + 2 * len(key) + len(found)
        if self.held > self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = found
        return found


class WordBpe:
    """Encoder and decoder for one tokenizer file; made once in each worker."""

    def __init__(self, model: dict):
        self.vocab, self.end, self.special = model["vocab"], model["end"], model["special"]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = text
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.end] for c in alphabet]
        self.parts, self.pieces = _Recent(self._word, PART_BYTES), _Recent(self._piece, PIECE_BYTES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the lowest-ranked merge again and again, leftmost first among equals.

        An entry of the queue holds rank, merged id and position in one integer. ``offer`` has the entry that stands
        at a position now; any other that comes up for it is stale.
        """
        n, find = len(ids), self.merges.get
        bits = max(20, n.bit_length())
        low, queue, offer = (1 << bits) - 1, [], [-1] * n
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            if (found := find(left << 20 | right)) is not None:
                offer[i] = entry = found << bits | i
                queue.append(entry)
            left = right
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            i = top & low
            if offer[i] != top:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i] = made = top >> bits & 0xFFFFF
            ids[j] = offer[j] = offer[i] = -1
            if k < n:
                before[k] = i
                if (found := find(made << 20 | ids[k])) is not None:
                    offer[i] = entry = found << bits | i
                    heappush(queue, entry)
            h = before[i]
            if h >= 0:
                if (found := find(ids[h] << 20 | made)) is not None:
                    offer[h] = entry = found << bits | h
                    heappush(queue, entry)
                else:
                    offer[h] = -1
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return array("I", self.merge(ids)).tobytes()

    def _letters(self, word: str) -> bytes:
        """Of a folded word of letters; where folding it again leaves it, it is kept as the piece that it is too."""
        return self.pieces[word] if word.isascii() or _folded(word) == word else self.parts[word]

    def _piece(self, piece: str) -> bytes:
        folded = _folded(piece)
        if folded.isalpha():
            return self._word(piece) if folded == piece else self._letters(folded)
        if folded[-1] in _MARKS and folded[:-1].isalpha():
            return self._letters(folded[:-1]) + self.parts[folded[-1]]
        return b"".join([self.parts[word] for word in _WORD.findall(folded)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.split.split(text) if self.split and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.pieces.__getitem__, filter(None, _GAP.split(part)) if _SEPARATORS.search(part) else part.split())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, one after the other with a space between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _worker(model) -> WordBpe:
    """The worker's encoder for a broadcast model; kept over tasks that use it, with its caches."""
    return kept(("bpe", model.value["key"]), lambda: WordBpe(model.value))


def _shipped(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(load_model(path) | {"key": path})


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """``df`` with the text's token ids (array<int>) and their number; a null text encodes like an empty one, to no ids.

    Texts are encoded whole, without adding special tokens; special tokens that stand in a text are recognised.
    The model file is read by the driver and shipped to tasks (its size is fixed by the vocabulary).
    Columns of ``df`` named like the new ones are replaced.
    """
    model = _shipped(df, path)

    @F.arrow_udf("array<int>")
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _worker(model)
        for texts in columns:
            ids = [own.encode(text.as_py() or "") for text in texts]
            off = np.cumsum([0, *[len(x) // 4 for x in ids]])
            yield pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.Array.from_buffers(pa.int32(), int(off[-1]), [None, pa.py_buffer(b"".join(ids))]))
        give_back()

    found = df.withColumn(ids_col, ids_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return found.withColumn(count_col, F.size(ids_col).cast("long"))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null ids decode to an empty text."""
    model = _shipped(df, path)

    @F.arrow_udf("string")
    def text_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _worker(model)
        for ids in columns:
            yield pa.array([own.decode(np.asarray(x.values, "<u4").tobytes()) if x.is_valid else "" for x in ids], pa.string())
        give_back()

    return df.withColumn(text_col, text_of(ids_col))


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian 32-bit) and of the text decoded from them.

    Encodes and decodes each whole text in one pass, so that ids never travel between the JVM and Python.
    """
    model = _shipped(df, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(model)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
