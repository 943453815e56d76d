"""Importance resampling towards a target distribution over hashed word features.

Features are hashed by CRC-32 without a loop over bytes: a checksum is the XOR of what each byte contributes, which
depends on the byte and its distance from the feature's end only, and of a constant of the feature's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import discard, materialize, small_batches
from tidemark.llm._text import lean, slices

#: Buckets of features, words of the longest feature, and bytes from a span's end that the position table covers.
BUCKETS, WORDS, REACH = 10_000, 3, 64

_WORD = np.ones(256, bool)  # what is no ASCII but letters and digits
_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _position_table() -> np.ndarray:
    """[distance from the end, byte]: a byte's contribution to a checksum without start value and final complement."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    table = np.empty((REACH, 256), np.uint32)
    table[0] = one
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ one[table[d - 1] & np.uint32(255)]
    return table


_TABLE = _position_table()
_FLAT = _TABLE.reshape(-1)
#: The checksum of so many zero bytes: what a feature's length contributes.
_LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


def _advance(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Checksums moved on by as many bytes as ``tables`` stands for."""
    out = tables[0][x & np.uint32(255)]
    for j in (1, 2, 3):
        out = out ^ tables[j][(x >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def _contributions(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the bytes' contributions over spans of 1 to REACH bytes."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = (end - start).astype(np.int32)
    first = np.cumsum(size, dtype=np.int32) - size
    place = np.arange(int(first[-1] + size[-1]), dtype=np.int32)
    distance = np.repeat(first + size - 1, size) - place
    byte = data[place + np.repeat((start - first).astype(np.int32), size)]
    return np.bitwise_xor.reduceat(_FLAT[(distance << 8) + byte], first)


def _long(data: np.ndarray) -> int:
    """The contributions of a span of any length: blocks of REACH bytes from its end, folded in pairs."""
    ends = np.arange(len(data), 0, -REACH)
    values = _contributions(data, np.maximum(ends - REACH, 0), ends)
    moved = np.stack([_TABLE[REACH - 1 - j] for j in range(4)])
    while len(values) > 1:
        if len(values) % 2:
            values = np.append(values, np.uint32(0))
        values = values[::2] ^ _advance(moved, values[1::2])
        moved = np.stack([_advance(moved, t) for t in moved])
    return int(values[0])


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start : end] for every span (of one byte at least)."""
    size = end - start
    if not len(size) or int(size.max()) <= REACH:
        return _contributions(data, start, end) ^ _LENGTHS[size]
    out = np.empty(len(size), np.uint32)
    short = size <= REACH
    out[short] = _contributions(data, start[short], end[short]) ^ _LENGTHS[size[short]]
    for i in np.flatnonzero(~short):
        span = data[start[i] : end[i]]
        out[i] = _long(span) ^ zlib.crc32(bytes(len(span)))
    return out


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each; their starts and ends; each row's first word (one more at the end)."""
    inside = _WORD[_LOWER[data]] if len(data) else np.zeros(0, bool)
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    rows = off[:-1][off[1:] > off[:-1]]
    before[rows] = False
    first = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    after[off[1:][off[1:] > off[:-1]] - 1] = False
    last = np.flatnonzero(inside & ~after)
    size = last - first + 1
    end = np.cumsum(size + 1) - 1
    packed = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    packed[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[inside]]
    return packed, end - size, end, np.searchsorted(first, off)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every run of 1 to WORDS words, and the number of words of every row."""
    packed, start, end, bounds = words_of(data, off)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    found, rows = [], []
    for k in range(min(WORDS, len(start))):
        keep = np.flatnonzero(row[: len(row) - k] == row[k:])
        found.append(crc32_spans(packed, start[keep], end[keep + k]) % np.uint32(BUCKETS))
        rows.append(row[keep])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), counts
    return np.concatenate(found), np.concatenate(rows), counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, off in slices(batch.column(0)):
            total += np.bincount(features(data, off)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all whole texts fall into each bucket that has any; null texts have none."""
    small_batches(df.sparkSession)
    found = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_counts), "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """What each bucket says for the target: floor(1000 * ln of the ratio of its smoothed shares).

    One number for each of BUCKETS buckets, however large the tables are.
    """
    s, t = bucket_counts(docs, text_col), bucket_counts(target, text_col)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    rows = both.collect()  # BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    for r in rows:
        counts[:, r["bucket"]] = r["s"], r["t"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; null texts are empty ones, without features."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                bucket, row, words = features(data, off)
                many, weight = np.bincount(row, minlength=hi - lo), np.zeros(hi - lo, np.int64)
                np.add.at(weight, row, gains[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(many.astype(np.int64)), pa.array(weight)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(score), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row: importance resampling without replacement.

    The score is the weight with Gumbel noise of the id's hash. Of the documents with ``least_words`` words or more,
    the ``percent`` with the highest scores (rounded down) are drawn and ranked from 1, ties to the smaller id; the
    others' rank is null. Null texts are empty; rows that repeat an id are drawn apart; the noise of a null id is that
    of an empty one. Further columns may have any name. Empty tables give an empty result, an empty target even shares.

    Ranks come from a sort by range: rows are numbered within each range, and ranges begin at the sum of those before
    (one number a range), so that no task holds more than its range, however many scores are equal.
    """
    scored = weigh(docs, bucket_gains(docs, target, text_col), id_col, text_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = scored.select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("open"))
    scored = materialize(scored, "scored")
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ordered = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered")
    discard(scored)
    per = ordered.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("open").alias("open")).orderBy("range").collect()  # a row a partition
    starts, at = [], 0
    for r in per:
        starts.append((r["range"], at))
        at += r["rows"]
    drawn = sum(r["open"] for r in per) * percent // 100
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "range long, start long"))
    place = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.withColumn("range", F.shiftright("place", 33)).join(starts, "range")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (place <= drawn), place).alias("rank"))
