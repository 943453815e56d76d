"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import small_batches
from tidemark.llm._text import lean

#: Labelled documents that the lexicon is learned from at most (half of each label), and its entries at most.
FIT_DOCUMENTS, ENTRIES = 12_000, 20_000
#: An entry is seen in so many toxic documents at least, so many standard deviations above what chance would give,
#: and so much more often than in clean ones (log ratio); the same at every size.
SEEN, SURPRISE, RATIO = 3, 3.0, 1.1
#: Exception phrases that are learned at most, and clean documents that have one at least (no toxic one has it).
PHRASES, CLEAN = 5_000, 3
#: Lengths of word beginnings that may enter the lexicon beside whole words.
STEMS = range(3, 9)
#: Measures of a text's evidence, see :func:`evidence`.
_MEASURES = 4

# Letters of other scripts, and digits, that are read as Latin letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɡ": "g", "ı": "i", "ɑ": "a", "ꜱ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
}
_INVISIBLE = "­​‌‍⁠﻿"
_FOLD = str.maketrans(_LOOKALIKES | {c: " " for c in "\t\n\v\f\r!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»„“”‘’–—…¿¡"} | {c: "" for c in _INVISIBLE})
_FOLD |= str.maketrans({"$": " ", "@": " "})
_MONEY = re.compile(r"(?<=[a-z])[$@](?=[a-z])")


def fold(text: str) -> str:
    """Lower case, lookalike letters and digits as Latin letters, punctuation and white space as spaces, padded."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "$" in text or "@" in text:
        text = _MONEY.sub(lambda m: "s" if m[0] == "$" else "a", text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """Weights by pattern (" word " or the beginning of one, " stem"), exception phrases, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    mean: np.ndarray = field(default_factory=lambda: np.zeros(_MEASURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(_MEASURES))
    slope: np.ndarray = field(default_factory=lambda: np.eye(_MEASURES)[0])
    bias: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for pattern, w in self.weights.items():
            found.add_word(pattern, (len(pattern), w))
        for phrase in self.exceptions:
            folded = f" {' '.join(fold(phrase).split())} "
            if folded.strip():
                found.add_word(folded, (len(folded), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def evidence(text: str, automaton: ahocorasick.Automaton | None) -> list[float]:
    """Weight of the matches (the best one at each word, none inside an exception phrase), plain and against the length.

    The length by itself is no measure: a text without matches counts alike however long it is.
    """
    folded = f" {' '.join(fold(text).split())} "
    words = folded.count(" ")
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded) if automaton else ():
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    total, until, k = [], -1, 0
    spared.sort()
    for start, w in sorted(best.items()) if spared else best.items():
        while k < len(spared) and spared[k][0] <= start:
            until, k = max(until, spared[k][1]), k + 1
        if start >= until:
            total.append(w)
    s = sum(total)
    return [np.log1p(s), s / (1 + words) ** 0.5, 10 * s / (1 + words), max(total, default=0.0)]


def phrases_around(text: str, automaton: ahocorasick.Automaton | None) -> set[str]:
    """Each word in which a match of the lexicon begins, with the word before it and with the word after it."""
    words = fold(text).split()
    if not words or automaton is None:
        return set()
    spaced = f" {' '.join(words)} "
    hit = {end - size + 1 for end, (size, weight) in automaton.iter(spaced) if weight is not None}
    out, at = set(), 0
    for i, word in enumerate(words):
        if at in hit:
            out |= {f"{words[i - 1]} {word}"} if i else set()
            out |= {f"{word} {words[i + 1]}"} if i + 1 < len(words) else set()
        at += len(word) + 1
    return out


def _samples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, documents: int) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    half = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(documents // 2) for c in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    part = F.pmod(F.crc32(F.concat(F.lit("part"), F.col("id").cast("string"))), F.lit(3))
    return rows.join(F.broadcast(half[0].unionByName(half[1])), "id").select("text", "label", (part == 0).alias("later"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] | None = None, documents: int = FIT_DOCUMENTS, entries: int = ENTRIES) -> Lexicon:
    """Learn the lexicon from a bounded sample of labelled documents.

    At most ``documents`` rows, half of each label, in the order of a hash of their ids. On two thirds, words and
    word beginnings are counted by label; those clearly more frequent in toxic documents enter, weighted by their
    log-likelihood ratio (the strongest ``entries``). On the same rows exception phrases are learned, if none are given:
    a matched word with the word before or after it that CLEAN clean documents or more have and no toxic one. On the last
    third the score is calibrated. Without labelled rows the lexicon is empty and every score is the same.
    """
    small_batches(docs.sparkSession)
    rows = _samples(docs, labels, id_col, text_col, label_col, documents)
    counts = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not later:
                    words = set(fold(text or "").split())
                    own = {f" {w[:n]}" for w in words for n in STEMS if len(w) > n} | {f" {w} " for w in words if len(w) > 2}
                    seen[label].update(own)
                    seen[label][""] += 1
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())], schema=counts)

    summed = rows.select("text", "label", "later").mapInArrow(lean(terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    many = rows.where("not later").groupBy("label").count().collect()
    size = {r["label"]: r["count"] for r in many}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    found = Lexicon(exceptions=exceptions or ())
    if toxic and clean:
        share = toxic / (toxic + clean)
        ratio = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
        expected = (F.col("toxic") + F.col("clean")) * share
        surprise = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share) + 0.5)
        chosen = summed.where((F.col("term") != "") & (F.col("toxic") >= SEEN)).select("term", ratio.alias("weight"), surprise.alias("surprise"))
        chosen = chosen.where((F.col("weight") >= RATIO) & (F.col("surprise") >= SURPRISE))
        found.weights = {r["term"]: r["weight"] for r in chosen.orderBy(F.desc("surprise"), "term").limit(entries).collect()}

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = found.automaton()
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[label].update(phrases_around(text or "", automaton))
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())], schema=counts)

    if exceptions is None and found.weights:
        near = rows.where("not later").select("text", "label").mapInArrow(lean(phrases), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        near = near.where((F.col("toxic") == 0) & (F.col("clean") >= CLEAN)).orderBy(F.desc("clean"), "term").limit(PHRASES)
        found.exceptions = tuple(r["term"] for r in near.collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = found.automaton()
        for batch in batches:
            out = [evidence(t or "", automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["label", "x"])

    held = rows.where("later").select("text", "label").mapInArrow(lean(measure), "label int, x array<double>").collect()
    if len({r["label"] for r in held}) == 2:
        x, y = np.array([r["x"] for r in held]), np.array([r["label"] for r in held], float)
        found.mean, found.scale = x.mean(0), x.std(0) + 1e-9
        found.slope, found.bias = _calibrated((x - found.mean) / found.scale, y)
    return found


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below 0 so that more evidence never lowers a score, and bias by logistic regression.

    Newton steps on the penalised likelihood; the measure with the lowest slope leaves until none is negative.
    """
    slope, used = np.zeros(x.shape[1]), np.arange(x.shape[1])
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        theta = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            theta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(theta)), z.T @ (y - p) - 0.5 * theta)
        if not len(used) or theta[:-1].min() >= 0:
            slope[used] = theta[:-1]
            return slope, float(theta[-1])
        used = np.delete(used, theta[:-1].argmin())


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hits, score``: the summed weight of lexicon matches, and the calibrated toxicity from 0 to 1.

    Only the text is read, whole. A null text counts as an empty one. Null ids are kept, repeated rows are scored
    each, an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("hits", pa.float64()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([evidence(t.as_py() or "", automaton) for t in batch.column(1)]).reshape(-1, _MEASURES)
            z = ((x - lexicon.mean) / lexicon.scale) @ lexicon.slope + lexicon.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.expm1(x[:, 0])), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(lean(judge), "doc_id long, hits double, score double")
