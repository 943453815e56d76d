"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where the content selects them (minimisers). They are sorted, neighbours are compared, and
matches are extended to the right and to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._spark import discard, fresh, map_rows, materialize, small
from tidemark.llm._text import _BASE, _INVERSE, _power_table, lean, mix, ngrams, slices, spans, word_hashes

#: Words of a passage at least, words that choose an anchor, and gaps that one is chosen from: a passage of
#: LEAST words holds LEAST - GRAM + 1 = WINDOW runs of GRAM words, so one of its anchors is the same in every copy.
LEAST, GRAM = 50, 16
WINDOW = LEAST - GRAM + 1
#: Words beside an anchor that are compared: an anchor within the passage's first WINDOW words reaches its start.
SIDE = WINDOW - 1


def _sliding(x: np.ndarray, w: int, pick: np.ufunc, empty: int) -> np.ndarray:
    """pick over x[i : i + w] for every i, in two running passes over blocks of w; beyond the end counts as empty."""
    n = len(x)
    blocks = -(-n // w) + 1
    padded = np.full(blocks * w, empty, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[w - 1 : n + w - 1])


def anchors_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, hash of the GRAM words from it, row) of the anchors of rows of LEAST words or more."""
    grams, at, rows = ngrams(words, bounds, GRAM, short=False)
    n = len(grams)
    if n < WINDOW:
        return np.zeros(0, np.int64), grams[:0], np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    grams = grams | np.uint64(1)
    least = _sliding(grams, WINDOW, np.minimum, np.iinfo(np.uint64).max)
    whole = np.zeros(n, bool)
    whole[: n - WINDOW + 1] = row[: n - WINDOW + 1] == row[WINDOW - 1 :]
    least[~whole] = 0
    # Chosen: the least of some window that holds it, that is, of the windows that begin up to WINDOW - 1 before it.
    highest = _sliding(least[::-1], WINDOW, np.maximum, 0)[::-1]
    chosen = highest == grams
    # Where a word, a pair or up to GRAM words are repeated over and over, the least gram is a tie once in each period.
    # The first and the last of such a run stay, and of the others enough for each window to hold one.
    i = np.flatnonzero(chosen)
    if len(i) > 2:
        gap = np.diff(i)
        tie = (gap <= GRAM) & (grams[i[1:]] == grams[i[:-1]]) & (row[i[1:]] == row[i[:-1]])
        inner = np.zeros(len(i), bool)  # between two of the same gram at the same distance
        inner[1:-1] = tie[1:] & tie[:-1] & (gap[1:] == gap[:-1])
        since = np.arange(len(i)) - np.maximum.accumulate(np.where(inner, 0, np.arange(len(i))))
        period = np.concatenate([[1], gap])
        i = i[~inner | (since % np.maximum(WINDOW // period, 1) == 0)]
    return at[i], grams[i], row[i]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("left", pa.int32()), ("right", pa.int32())])
    for batch in batches:
        for lo, hi, data, off in slices(batch.column(1)):
            start, end, bounds = spans(data, off)
            words = word_hashes(data, start, end, fold=False)
            at, h, row = anchors_of(words, bounds)
            first, stop = np.maximum(at - SIDE, bounds[row]), np.minimum(at + GRAM + SIDE, bounds[row + 1])
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power_table(_BASE, len(words) + 1)[: len(words)])])
            c = mix((total[stop] - total[first]) * _power_table(_INVERSE, len(words) + 1)[first])
            left, right = at - first, stop - at - GRAM
            c = mix(c + (left * 64 + right).astype(np.uint64))
            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array((at - bounds[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], schema=schema
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SIDE words before each anchor, nearest first, and after its gram, as 32-bit hashes."""
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("y", pa.int64()), ("nl", pa.int32()), ("nr", pa.int32()), ("l", pa.binary()), ("r", pa.binary())])
    for batch in batches:
        for lo, hi, data, off in slices(batch.column(1)):
            start, end, bounds = spans(data, off)
            words = (word_hashes(data, start, end, fold=False) >> np.uint64(32)).astype(">u4")
            words = np.concatenate([np.zeros(SIDE, ">u4"), words, np.zeros(SIDE + GRAM, ">u4")])
            wanted = batch.column(2).slice(lo, hi - lo)
            flat, sizes = wanted.flatten(), np.diff(np.asarray(wanted.offsets))
            row = np.repeat(np.arange(hi - lo), sizes)
            pos, h = np.asarray(flat.field("pos")).astype(np.int64), flat.field("h")
            at = bounds[row] + pos
            nl, nr = np.minimum(pos, SIDE), np.minimum(bounds[row + 1] - at - GRAM, SIDE)
            each = np.arange(SIDE)
            left = np.where(each < nl[:, None], words[(at + SIDE - 1)[:, None] - each], 0).astype(">u4")
            right = np.where(each < nr[:, None], words[(at + SIDE + GRAM)[:, None] + each], 0).astype(">u4")
            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids, flat.field("pos"), h, flat.field("c"), flat.field("y"), pa.array(nl.astype(np.int32)), pa.array(nr.astype(np.int32)), pa.array([x.tobytes() for x in left], pa.binary()), pa.array([x.tobytes() for x in right], pa.binary())],
                schema=schema,
            )


_RUNS = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("part", pa.int32()), ("most", pa.int32()), ("runs", pa.list_(pa.int64())), ("edge", pa.binary())])
#: Bits of a run's name that number it within its partition; number 0 is the run that the partition begins with.
_NUMBER = 40


def _prefixes(h: np.ndarray, n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words that each row shares with the row before it, from the gram on; 0 for another gram. The first row's is 0."""
    out = np.zeros(len(h), np.int64)
    if len(h) > 1:
        differ = np.concatenate([words[1:] != words[:-1], np.ones((len(h) - 1, 1), bool)], 1).argmax(1)
        out[1:] = np.where(h[1:] == h[:-1], np.minimum(differ, np.minimum(n[1:], n[:-1])), 0)
    return out


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted suffixes with common prefixes: of each row the most words that it shares with a neighbour, and
    for each number of words up to that the name of the run of rows that share as many.

    Two rows share d words exactly if all neighbours between them do, that is, if they are in one run of depth d. What
    is needed to go on with a run in the next partition (first and last row, the last row's runs) is an ``edge`` row.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    base, depth = part << _NUMBER, np.arange(1, SIDE + 1)
    open_runs, seen = np.full(SIDE, base), 0  # of the last row so far; rows so far
    first = held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(k)).astype(np.int64) for k in range(4)]
        rows.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), ">u4").reshape(-1, SIDE))
        if first is None:
            first = [c[:1] for c in rows]
        else:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        ids, pos, h, n, words = rows
        shared = _prefixes(h, n, words)
        number = base | (seen + 1 + np.arange(len(ids)))[:, None]
        starts = shared[:, None] < depth  # a run of this depth begins here
        starts[0] = False  # the row is held from the batch before, or the partition begins with it
        names = np.maximum.accumulate(np.where(starts, number, open_runs), axis=0)
        most = np.append(np.maximum(shared[:-1], shared[1:]), 0)
        if seen == 0:
            most[0] = SIDE  # what the partition before shares with it isn't known here
        else:
            most[0] = max(most[0], held_shared)
        if len(ids) > 1:
            yield _run_rows(ids[:-1], pos[:-1], h[:-1], most[:-1], names[:-1], part)
        seen += len(ids) - 1
        held, held_shared, open_runs = [c[-1:] for c in rows], int(shared[-1]), names[-1]
        if seen == 0:
            held_shared = SIDE
    if first is not None:
        yield _run_rows(*(held[k] for k in range(3)), np.array([SIDE]), open_runs[None, :], part)
        edge = np.concatenate([first[2], first[3], held[2], held[3]]).astype("<i8").tobytes() + first[4].astype(">u4").tobytes() + held[4].astype(">u4").tobytes()  # joined rows are in native order
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64())] + [pa.array([part], pa.int32()), pa.nulls(1, pa.int32()), pa.array([open_runs.tolist()], pa.list_(pa.int64())), pa.array([edge], pa.binary())], schema=_RUNS)


def _run_rows(ids, pos, h, most, names, part: int) -> pa.RecordBatch:
    off = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(off), pa.array(names[np.arange(SIDE) < most[:, None]]))
    k = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(h), pa.array(np.full(k, part, np.int32)), pa.array(most.astype(np.int32)), runs, pa.nulls(k, pa.binary())], schema=_RUNS)


def _continued(edges: list) -> list[tuple[int, list[int]]]:
    """For each partition that has rows the names, by depth, of the runs that it begins with: those of the partition
    before, as far as the last row there and the first row here share words. ``edges``: a row a partition."""
    out, before, ended = [], None, None
    for row in sorted(edges, key=lambda r: r["part"]):
        edge, names = bytes(row["edge"]), np.array(row["runs"])
        h0, n0, h1, n1 = np.frombuffer(edge[:32], "<i8")
        first, last = (np.frombuffer(edge[at : at + 4 * SIDE], ">u4") for at in (32, 32 + 4 * SIDE))
        begun = np.full(SIDE, row["part"] << _NUMBER)
        if before is not None:
            h, n, words = before
            shared = _prefixes(np.array([h, h0]), np.array([n, n0]), np.stack([words, first]))[1]
            begun[:shared] = ended[:shared]
        out.append((row["part"], begun.tolist()))
        before, ended = (h1, n1, last), np.where(names & ((1 << _NUMBER) - 1), names, begun)
    return out


def _in_runs(contexts: DataFrame, side: str, first: str, name: str) -> DataFrame:
    """``id, pos, h, most, runs`` of every context, sorted by gram and ``first``; see :func:`_ordered`."""
    order = contexts.select("id", "pos", "h", f"n{side}", first).repartitionByRange("h", first).sortWithinPartitions("h", first, "id", "pos")
    runs = materialize(order.mapInArrow(lean(_ordered), "id long, pos int, h long, part int, most int, runs array<bigint>, edge binary"), name)
    begun = _continued(runs.where("edge is not null").select("part", "runs", "edge").collect())  # a row a partition
    begun = small(contexts.sparkSession.createDataFrame(begun, "part int, begun array<bigint>"))
    named = F.transform("runs", lambda x, d: F.when(x.bitwiseAND((1 << _NUMBER) - 1) == 0, F.get("begun", d)).otherwise(x))
    found = runs.where("edge is null").join(begun, "part").select("id", "pos", "h", F.col("most").alias(f"{side}_most"), named.alias(f"{side}_runs"))
    found._written_to = runs._written_to
    return found


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping or touching spans of one document made one."""
    order = Window.partitionBy("id").orderBy("begin", "finish")
    gap = F.col("begin") > F.coalesce(F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = found.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(order))
    return islands.groupBy("id", "island").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish")).drop("island")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, begin, finish, later``: word spans of passages of 50 words or more that another document has as well.

    ``later`` false: all spans, merged; true: the parts that a document with a smaller id has, merged. Words are split
    at ASCII white space, letters' case counts. Passages that only one document repeats don't count. Null ids and texts
    take no part; rows that repeat an id count as one document. An empty table gives an empty result.

    Anchors with the same words around them (up to 34 on each side, 84 in all) form a class; all its members are spans
    at once, so the copies of a common passage are counted, not sorted. One anchor of each class goes to the suffix
    sort, if its gram has more than one class: sorted by what follows and again by what precedes, each is compared
    with its neighbours. The least of the common prefixes along the order is what two suffixes share, so that a run of
    neighbours that share d words are all that do; and a passage is shared by those that are in one run on both sides,
    of as many words before the gram as after it make LEAST together. Sorting is by range over gram and context, so a
    common gram is dealt to many tasks; runs go on over the borders of partitions. Words are compared by 64-bit hashes,
    or 32 bits of these for each word in the sort.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    anchors = materialize(rows.mapInArrow(lean(_anchor_rows), "id long, pos int, h long, c long, left int, right int"), "anchors")
    grams = anchors.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("x < y")
    # Written first: a join of two plain exchanges can be split where one gram is very common.
    grams = materialize(grams.select("h", (F.col("c1") < F.col("c2")).alias("several")), "grams")
    shared = materialize(anchors.join(grams, "h"), "shared")
    discard(anchors, grams)
    classes = shared.groupBy("h", "c", "several").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("y"))
    classes = materialize(classes.select("h", "c", "several", "first", "y", (F.col("first.id") < F.col("y")).alias("common")), "classes")
    wanted = classes.where("several").select(F.col("first.id").alias("id"), F.struct(F.col("first.pos").alias("pos"), "h", "c", "y").alias("a"))
    lists = materialize(wanted.groupBy("id").agg(F.collect_list("a").alias("anchors")), "wanted")  # of one document each
    texts = rows.join(small(lists.select("id")), "id", "left_semi").join(lists, "id").select("id", "text", "anchors")
    contexts = materialize(texts.mapInArrow(lean(_contexts), "id long, pos int, h long, c long, y long, nl int, nr int, l binary, r binary"), "contexts")
    right, left = _in_runs(contexts, "r", "r", "right"), _in_runs(contexts, "l", "l", "left")
    # A passage of LEAST words around the gram has k words before it and SIDE - k after it. Two places share it if they
    # are in one run of SIDE - k words in the one order and in one of k words in the other; only numbers of words that
    # neighbours share in both orders are looked at.
    both = right.join(left, ["id", "pos", "h"]).where(F.col("l_most") + F.col("r_most") >= SIDE)
    both = both.join(contexts.select("id", "pos", "h", "c", "y"), ["id", "pos", "h"])
    k = F.explode(F.sequence(F.lit(SIDE) - F.least("r_most", F.lit(SIDE)), "l_most")).alias("k")
    every = both.select("h", "c", F.col("id").alias("x"), "y", "r_runs", "l_runs", k)
    run = lambda runs, d: F.coalesce(F.get(runs, d - 1), F.lit(0))  # noqa: E731  of no words all are in one
    windows = every.select("h", "c", "x", "y", "k", run("r_runs", F.lit(SIDE) - F.col("k")).alias("a"), run("l_runs", F.col("k")).alias("b"))
    windows = materialize(windows, "windows")
    discard(contexts, right, left)
    # Windows of one class only are spans already where the class is common.
    window = ["h", "k", "a", "b"]
    hits = windows.groupBy(*window).agg(F.min("x").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo < hi and many > 1")
    hits = materialize(hits.select(*window, "lo"), "hits")
    near = windows.join(small(hits), window).groupBy("h", "c", "lo").agg((-F.max("k")).alias("from"), (-F.min("k")).alias("to"))
    near = materialize(near.groupBy("h", "c").agg(F.collect_list(F.struct("lo", "from", "to")).alias("near")), "near")  # WINDOW at most
    discard(lists, windows, hits)
    # What makes an anchor's place a span, its whole context or windows of it, holds the anchor's gram, so that all
    # of it is one span without gaps: one row a place, whatever its class shares with however many others.
    marks = classes.select("h", "c", "common", F.col("first.id").alias("first_id")).join(near, ["h", "c"], "left").where("common or near is not null")
    marks = materialize(marks, "marks")
    discard(classes, near)
    own = F.col("common") & (F.col("left") + F.col("right") + GRAM >= LEAST)
    near_of = F.coalesce("near", F.array().cast("array<struct<lo:bigint,from:int,to:int>>"))
    before = F.filter(near_of, lambda x: x["lo"] < F.col("id"))
    begin, finish = -F.col("left"), GRAM + F.col("right")
    places = shared.join(marks, ["h", "c"]).select("id", "pos", near_of.alias("near"), before.alias("before"), F.when(own, begin).alias("b"), F.when(own, finish).alias("f"), (F.col("id") > F.col("first_id")).alias("after"))

    def spans_of(some: str, b: Column, f: Column) -> list[Column]:
        first = F.least(F.array_min(F.transform(some, lambda x: x["from"])), b)
        last = F.greatest(F.array_max(F.transform(some, lambda x: x["to"] + LEAST)), f)
        return [(F.col("pos") + first).cast("long"), (F.col("pos") + last).cast("long")]

    begin, finish = spans_of("near", F.col("b"), F.col("f"))
    later_begin, later_finish = spans_of("before", F.when(F.col("after"), F.col("b")), F.when(F.col("after"), F.col("f")))
    places = materialize(places.select("id", begin.alias("begin"), finish.alias("finish"), later_begin.alias("later_begin"), later_finish.alias("later_finish")).where("begin is not null").distinct(), "places")
    discard(shared, marks)
    every, later = places.select("id", "begin", "finish"), places.where("later_begin is not null").select("id", F.col("later_begin").alias("begin"), F.col("later_finish").alias("finish"))
    every, later = materialize(_merged(every), "spans"), materialize(_merged(later), "spans")
    discard(places)
    return every.withColumn("later", F.lit(False)).unionByName(later.withColumn("later", F.lit(True)))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages of 50 words or more that a document with a smaller id has too.

    Each removed word takes the white space after it along. Documents of which nothing is left are dropped; those
    that have no such passage, null ids and null texts are returned as they are. Rows that repeat an id are cut by the
    spans of both; other columns may have any name. An empty table gives an empty result.
    """
    p = fresh(docs.columns)
    gone = materialize(repeated_spans(docs, id_col, text_col).where("later").select(F.col("id").alias(f"{p}id"), F.struct("begin", "finish").alias("s")), "gone")
    lists = gone.groupBy(f"{p}id").agg(F.array_sort(F.collect_list("s")).alias(f"{p}gone"))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text_col)).cast(pa.string())
            texts, keep = [], []
            spans_of, spans_of_type = batch.column(len(names)).to_pylist(), batch.column(len(names)).type
            for text, lists in zip(column.to_pylist(), spans_of, strict=True):
                if not lists or text is None:
                    texts.append(text), keep.append(True)
                    continue
                raw = np.frombuffer(text.encode(), np.uint8)
                start, _, _ = spans(raw, np.array([0, len(raw)]))
                edges = np.append(start, len(raw))
                words, left, at = len(start), [], 0
                for s in lists:
                    left.append(raw[at : edges[min(s["begin"], words)]].tobytes())
                    at = edges[min(s["finish"], words)]
                left.append(raw[at:].tobytes())
                rest = b"".join(left).decode()
                texts.append(rest), keep.append(bool(rest.strip()))
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(i) for i, n in enumerate(names)]
            columns.append(pa.nulls(len(keep), spans_of_type))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))]).filter(pa.array(keep))

    lists = F.broadcast(lists) if not gone.limit(200_001).count() > 200_000 else lists
    rows = docs.join(lists, docs[f"`{id_col}`"].cast("long") == F.col(f"{p}id"), "left").select(*[docs[f"`{n}`"] for n in names], f"{p}gone")
    return map_rows(rows, lean(cut)).drop(f"{p}gone")
