"""Spelling variants: words one edit apart, found by asymmetric chunks of words.

One edit leaves one of a word's two halves as it is. So the shorter word of a pair gives its halves, and the other one
the positional grams that can meet them within a shift of one; words that share one are verified.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import discard, materialize, small_batches
from tidemark.llm._text import lean

#: Code points of a word at least, its occurrences at least, one of so many runs that loses a letter, and how many
#: times as frequent a word's form is.
LENGTH, OCCURRENCES, TYPO, RATIO = 7, 2, 31, 10
#: Words that a task counts before it hands its counts on.
HELD = 200_000


def _counter(runs: re.Pattern):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total: dict[str, int] = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: dict[str, int] = {}
                for run in runs.findall((text.as_py() or "").encode().lower().decode()):
                    found[run] = found.get(run, 0) + 1
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % TYPO == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LENGTH:
                            continue
                    total[run] = total.get(run, 0) + n
                if len(total) > HELD:
                    yield out()
                    total = {}
        yield out()

    return count


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the lower-cased runs of letters of LENGTH code points or more with OCCURRENCES or more.

    Where the checksum of id and run is divisible by TYPO, the run loses the letter at the checksum modulo its length.
    A null text has no words; a null id is an empty one; rows that repeat an id count one by one.
    """
    small_batches(docs.sparkSession)
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{LENGTH},}}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(lean(_counter(runs)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def _keys(length: Column, shift: int) -> Column:
    """The keys of a word as the partner of words of ``length`` code points, to which it has ``shift`` more.

    A word of L code points has the halves A and B, and each half two halves of its own. An edit spares a half and one
    half of the other: the key is these two, with L and which they are. ``shift`` 0: the word's own chunks; 1: the
    grams of a word in which one more code point stands somewhere, so that what follows it is moved by one.
    """

    def gram(begin: Column, end: Column, moved: bool) -> Column:
        return F.substring("word", begin + 1 + (shift if moved else 0), end - begin)

    zero, half = F.lit(0), F.floor(length / 2).cast("int")
    a, b = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
    pairs = [
        (gram(zero, half, False), gram(half, b, False)),
        (gram(zero, half, False), gram(b, length, True)),
        (gram(half, length, True), gram(zero, a, False)),
        (gram(half, length, True), gram(a, half, True)),
    ]
    return F.array(*[F.xxhash64(length, F.lit(i), x, y) for i, (x, y) in enumerate(pairs)])


def near_words(found: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` of distinct words that one inserted, deleted or replaced code point tells apart, both
    ways round, from a table of distinct words ``word, n`` that can be read again.

    Candidates share a half and a quarter at places that one edit allows, and are verified by their edit distance.
    No pair is lost, as an edit spares one half and one quarter of the other half.
    """
    size = F.length("word")
    chunks = found.select(F.explode(_keys(size, 0)).alias("key"), "word", "n")
    grams = found.select(F.explode(F.concat(_keys(size, 0), _keys(size - 1, 1))).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    shorter = F.length("word") < F.length("other")
    pairs = chunks.join(grams, "key").where(shorter | ((F.length("word") == F.length("other")) & (F.col("word") < F.col("other"))))
    pairs = pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    there, back = F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.select(F.inline(F.array(there, back)))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word with the more frequent spelling that it is a variant of.

    ``form`` is the most frequent word one edit away (ties: the smallest), if it has RATIO times the word's
    occurrences, else null; ``root`` follows forms to the last one. As occurrences grow by RATIO with each form, chains
    end, and are halved by pointer jumping. Nulls as in :func:`words`; further columns may have any name; an empty
    table gives none.
    """
    found = materialize(words(docs, id_col, text_col), "words")
    best = near_words(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    joined = found.join(best, "word", "left")
    good = -F.col("best.m") >= RATIO * F.col("n")
    chosen = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
    chosen = materialize(chosen, "forms")
    discard(found)
    # Words with a form only; others are their own root.
    hops = materialize(chosen.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, hops = hops, materialize(moved, "roots")
        discard(last)
        if not hops.where("moved").limit(1).count():
            break
    found = chosen.join(hops.select("word", "root"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
