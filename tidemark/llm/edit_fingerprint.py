"""Document fingerprints by a randomised edit embedding: shared random walks turn edit into Hamming distance."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._spark import discard, materialize
from tidemark.llm.components import components


#: Walk positions sampled in each octave [2^k, 2^(k+1)), below the first octave all are kept.
SAMPLES, FIRST = 64, 64
_PERIOD = 4096
_rng = np.random.default_rng(20240501)
#: Shared walk: at step j a character of class c moves on if the bit is set. Steps repeat with a long period.
_STEP = _rng.integers(0, 2, (_PERIOD, 256), dtype=np.uint8)
_CODE = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", np.uint8)
_OCTAVES = 48


def _positions() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in ascending order and the number of steps that each stands for."""
    steps, stands = [np.arange(FIRST)], [np.ones(FIRST)]
    for k in range(6, _OCTAVES):
        inner = np.sort(_rng.choice(1 << k, SAMPLES, replace=False)) if k < 24 else np.sort(_rng.integers(0, 1 << k, SAMPLES))
        steps.append((1 << k) + inner)
        stands.append(np.full(SAMPLES, (1 << k) / SAMPLES))
    return np.concatenate(steps), np.concatenate(stands)


_AT, _STANDS = _positions()


_STEP_ROWS = [row.tobytes() for row in _STEP]
#: Walks that still go on below which they are finished one by one.
_FEW = 24
_SLICE_CHARS = 1 << 23


def _walk_one(classes: bytes, codes: bytes, i: int, j: int, out: bytearray) -> None:
    """Finish one walk from character i at step j."""
    n, mask = len(classes), _PERIOD - 1
    until = _AT_LIST[len(out)]
    while i < n:
        if j == until:
            out.append(codes[i])
            until = _AT_LIST[len(out)]
        i += _STEP_ROWS[j & mask][classes[i]]
        j += 1


_AT_LIST = _AT.tolist()


def embed(texts: list[str]) -> list[str]:
    """Fingerprints: what the walk over each text reads at the sampled steps.

    At step j the walk reads the character it stands on and moves on or stays as a shared random bit for (j,
    character) says; texts that differ by few edits walk together again soon after each edit, so that their readings
    differ in few places. What is read is a hash of the character and the two that follow. All texts walk in lockstep.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    flat = ((points * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8)
    stop = np.cumsum(sizes)
    start = stop - sizes
    ahead = np.zeros(16, np.uint8)  # a walk is looked at every 16 steps and may read as far beyond its end
    later = np.zeros((2, len(flat)), np.uint32)
    later[0, :-1], later[1, :-2] = points[1:], points[2:]
    full = stop[sizes > 0]
    later[0, full - 1] = later[1, full - 1] = 0
    later[1, stop[sizes > 1] - 2] = 0
    three = (points * np.uint32(2246822519) ^ later[0]) * np.uint32(3266489917) ^ later[1]
    codes = _CODE[(three * np.uint32(668265263)) >> np.uint32(26)]
    out = [bytearray() for _ in texts]
    flat = np.concatenate([flat, ahead])
    live = np.flatnonzero(sizes)
    live = live[np.argsort(-sizes[live], kind="stable")]
    pos, end = start[live], stop[live]
    read: list[tuple[np.ndarray, np.ndarray]] = []
    j, k, until = 0, 0, _AT_LIST[0]
    mask = _PERIOD - 1
    while len(live) > _FEW:
        if j == until or not j & 15:
            going = pos < end
            if not going.all():
                live, pos, end = live[going], pos[going], end[going]
                continue
        if j == until:
            read.append((live, codes[pos]))
            k += 1
            until = _AT_LIST[k]
        pos += _STEP[j & mask][flat[pos]]
        j += 1
    if read:
        who, what = np.concatenate([d for d, _ in read]), np.concatenate([c for _, c in read])
        by = np.argsort(who, kind="stable")
        what = what[by].tobytes()
        heads, firsts = np.unique(who[by], return_index=True)
        for d, a, b in zip(heads.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(who)], strict=True):
            out[d] += what[a:b]
    for d, at in zip(live.tolist(), (pos - start[live]).tolist(), strict=True):
        if at < sizes[d]:
            _walk_one(flat[start[d] : stop[d]].tobytes(), codes[start[d] : stop[d]].tobytes(), at, j, out[d])
    return [x.decode("ascii") for x in out]


def likeness(a: str, b: str) -> float:
    """Share of the walks' steps at which the two read the same, estimated from the samples; two empty ones: 1."""
    if a == b:
        return 1.0
    n, m = sorted((len(a), len(b)))
    same = np.frombuffer(a.encode()[:n], np.uint8) == np.frombuffer(b.encode()[:n], np.uint8)
    return float(_STANDS[:n] @ same / _STANDS[:m].sum())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, next_text``: each row's text and that of the next row by ascending id (after the last: the first).

    Ids are cut into ranges of some hundred rows; a window inside each range finds the next row, and the first row of
    each range is copied to the end of the one before. So each text is moved once and no task sees more than its
    ranges. Rows that repeat an id follow each other in the order of a hash of their text. Null ids come before all
    others and are no one's first row. Null texts are empty ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = rows.select("id").where("id is not null")
    ranges = int(min(20_000, max(1, known.count() // 200)))
    heads = known.repartitionByRange(ranges, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id"))
    bounds = np.array(sorted(r["id"] for r in heads.collect()), np.int64)  # at most 20,000 ids

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        return pd.Series(np.maximum(np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy(), "right") - 1, 0).astype("int32"))

    rows = rows.withColumn("range", range_of("id")).withColumn("copied", F.lit(0))
    spark = docs.sparkSession
    firsts = spark.createDataFrame([(int(b), (i - 1) % len(bounds)) for i, b in enumerate(bounds)], "id long, before int")
    copies = rows.drop("range").join(F.broadcast(firsts), "id").select("id", "text", F.col("before").alias("range"), F.lit(1).alias("copied"))
    ordered = Window.partitionBy("range").orderBy("copied", "id", F.xxhash64("text"))
    return rows.unionByName(copies).withColumn("next_text", F.lead("text").over(ordered)).where("copied = 0").select("id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text: the last quarter of its code points (rounded down)
    replaced by the first as many of the next document's. ``near_edited`` and ``near_next`` are the likeness of a
    text's fingerprint to its edited text's and to the next document's. One row per row of ``docs``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(ids: list, texts: list[str], edited: list[str], follow: list[str]) -> pa.RecordBatch:
        every: dict[str, int] = {}
        for t in (*texts, *edited, *follow):
            every.setdefault(t, len(every))
        prints = embed(list(every))
        a, b, c = ([prints[every[t]] for t in ts] for ts in (texts, edited, follow))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(map(likeness, a, b), pa.float64()), pa.array(map(likeness, a, c), pa.float64()),
            ],
            schema=schema,
        )

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, edited, follow, held = [], [], [], [], 0
        for batch in batches:
            for i, t, n in zip(*batch.columns, strict=True):
                i, t, n = i.as_py(), t.as_py(), n.as_py()
                q = len(t) // 4
                ids.append(i), texts.append(t), edited.append(t[: len(t) - q] + n[:q]), follow.append(n)
                held += len(t) + len(n)
                if held > _SLICE_CHARS:
                    yield run(ids, texts, edited, follow)
                    ids, texts, edited, follow, held = [], [], [], [], 0
        if ids:
            yield run(ids, texts, edited, follow)

    rows = with_next(docs, id_col, text_col)
    return rows.mapInArrow(fingerprint, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Bands drawn from a block of samples, and samples of a band.
_BANDS, _BITS = 40, 6


def _drawn(size: int) -> list[tuple[int, ...]]:
    """The distinct sets of samples that bands read in a block of ``size`` samples: in small blocks three quarters of
    the samples in every way, in others sets drawn once and for all."""
    rng, bits = np.random.default_rng(size), max(1, min(_BITS, size * 3 // 4))
    if math.comb(size, bits) <= _BANDS:
        return list(itertools.combinations(range(size), bits))
    return sorted({tuple(sorted(rng.choice(size, bits, replace=False).tolist())) for _ in range(_BANDS)})


_DRAWN = {1 << k: _drawn(1 << k) for k in range(FIRST.bit_length())}


def bands_of(fingerprint: str) -> list[str]:
    """Keys of a fingerprint: block, band, and what the walk reads at the band's sampled steps.

    Blocks are the last two whole ones, which stand for most of the walk: octaves of samples, before them the first 64
    readings, and of fingerprints under 128 readings the beginnings whose lengths are powers of two. So fingerprints
    of somewhat different lengths share a block at every length. An empty one has no key.
    """
    m = len(fingerprint)
    whole = (m - FIRST) // SAMPLES
    if m >= FIRST:
        blocks = [(FIRST + i * SAMPLES, SAMPLES) if i >= 0 else (0, FIRST) for i in range(max(-1, whole - 2), whole)]
        blocks += [(0, FIRST // 2)] if whole == 0 else []
    else:
        blocks = [(0, 1 << k) for k in (m.bit_length() - 1, m.bit_length() - 2) if k >= 0]
    out = []
    for start, size in blocks:
        part = fingerprint[start : start + size]
        out += [f"{start}:{size}:{b}:" + "".join([part[i] for i in at]) for b, at in enumerate(_DRAWN[size])]
    return out


#: A bucket's members up to which its pairs are joined; more are compared in blocks of so many.
_SMALL, _BLOCK = 16, 256
#: The steps that a fingerprint of each length stands for.
_WEIGHT = np.concatenate([[0.0], np.cumsum(_STANDS)])


def _matrix(prints: list[str], width: int, end: int) -> np.ndarray:
    """Samples in rows and fingerprints in columns, ``end`` beyond a fingerprint's end."""
    flat = b"".join([x.encode().ljust(width, bytes([end])) for x in prints])
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(len(prints), width).T)


def near_between(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in two lists of fingerprints (none of them empty) at which their likeness is ``least`` or more.

    Equal samples are counted block by block from the heaviest one down, until no pair can reach ``least`` any more.
    Blocks begin at multiples of SAMPLES and their samples stand for as many steps each; sums of these are exact.
    """
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    width = -(-int(max(s.max() for s in sizes)) // SAMPLES) * SAMPLES
    a, b = _matrix(left, width, 0), _matrix(right, width, 1)
    total = np.maximum(_WEIGHT[sizes[0]][:, None], _WEIGHT[sizes[1]])
    same, enough = np.zeros(total.shape), total * (least - 1e-9)
    for start in range(width - SAMPLES, -1, -SAMPLES):
        count = np.zeros(total.shape, np.uint8)
        for i in range(start, start + SAMPLES):
            count += (a[i][:, None] == b[i]).view(np.uint8)
        same += count * _STANDS[start]
        if not (same + _WEIGHT[start] >= enough).any():
            break
    return np.nonzero(same / total >= least)


def _joined(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links between components that a spanning forest of them needs."""
    label: dict[int, int] = {}

    def root(x: int) -> int:
        while x in label:
            x = label[x]
        return x

    out = []
    for x, y in sorted(set(zip(left.tolist(), right.tolist(), strict=True))):
        low, high = sorted((root(x), root(y)))
        if low < high:
            label[high] = low
            out.append((low, high))
    return out


def _compare_blocks(least: float):
    """Kernel for mapInArrow over ``key, t, u, block, own, fingerprint``, where rows with the same (key, t, u) follow
    each other: links between the components of near members of blocks t and u of a bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(parts)
        block, own = rows["block"].to_numpy(), rows["own"].to_numpy()
        prints = rows["fingerprint"].to_pylist()
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        i, j = near_between([prints[k] for k in left], [prints[k] for k in right], least)
        x, y = own[left[i]], own[right[j]]
        return _joined(x[x != y], y[x != y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            by = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            found: list[tuple[int, int]] = []
            for begin, end in itertools.pairwise(cuts):
                now = tuple(by[:, begin].tolist())
                if held and now != group:
                    found += links(held)
                    held = []
                group = now
                held.append(batch.slice(begin, end - begin))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)
        if held and (found := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

    return run


def near_by_edits(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: documents linked where their fingerprints' likeness is ``least`` or more.

    Banding: documents that share a band's samples meet in a bucket. Two fingerprints that read the same at 0.8 of a
    block's samples share one of its 40 bands of 6 with probability above 0.99999. Verification: the likeness over all
    samples. Equal texts are one entry, and of buckets with the same members one is kept. First each bucket's members
    are compared with its smallest one, which joins groups of copies. Then, in buckets that aren't in one component,
    all members of different components are compared: in small buckets as joined pairs, in larger ones block by block,
    so that a task holds two blocks and no pair is ever a row; blocks of one component aren't compared. Nothing is
    capped. Null and empty texts, and null ids, are linked with nothing. Rows that repeat an id with several texts keep
    a fingerprint each; the texts are linked apart. Each row of ``docs`` gives one row, an empty table none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("h", pa.string()), ("fingerprint", pa.string())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (held < _SLICE_CHARS or end == at):
                    held, end = held + len(texts[end]), end + 1
                hashes = [hashlib.md5(t.encode()).hexdigest() for t in texts[at:end]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(hashes, pa.string()), pa.array(embed(texts[at:end]), pa.string())], schema=schema)
                at = end

    written: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        written.append(materialize(df, name))
        return written[-1]

    found = materialize(rows.mapInArrow(prints, "id long, h string, fingerprint string"), "fingerprints")
    reps = materialize(found.where("id is not null and fingerprint <> ''").groupBy("h").agg(F.min("id").alias("rep"), F.first("fingerprint").alias("fingerprint")), "representatives")

    @F.pandas_udf("array<string>")
    def keys(fingerprints):
        return fingerprints.map(bands_of)

    cells = put(reps.select("rep", F.explode(keys("fingerprint")).alias("key")).select("rep", F.xxhash64("key").alias("key")), "bands")
    digests = [F.bit_xor(F.xxhash64(F.lit(seed), "rep")).alias(f"digest_{seed}") for seed in (1, 2)]
    many = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head"), *digests).where("n > 1")
    many = many.groupBy("n", "head", "digest_1", "digest_2").agg(F.min("key").alias("key")).select("key", "n", "head")
    cells = put(cells.join(many, "key"), "buckets")
    alike = F.pandas_udf(lambda a, b: a.combine(b, likeness), "double")

    def near(pairs: DataFrame) -> DataFrame:
        side = [reps.select(F.col("rep").alias(x), F.col("fingerprint").alias(f"f_{x}")) for x in ("a", "b")]
        return put(pairs.join(side[0], "a").join(side[1], "b").where(alike("f_a", "f_b") >= least).select("a", "b"), "near")

    pairs = put(cells.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = near(pairs)
    groups = put(components(links), "components")
    own = cells.join(groups, F.col("rep") == F.col("node"), "left").select("key", "n", "head", "rep", F.coalesce("component", "rep").alias("own")).where("n > 2")
    own = put(own, "owned")
    mixed = own.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("key")
    own = put(own.join(mixed, "key", "left_semi"), "open")

    few = own.where((F.col("n") <= _SMALL) & (F.col("rep") != F.col("head")))
    x, y = (few.select("key", F.col("rep").alias(f"rep_{k}"), F.col("own").alias(f"own_{k}")) for k in "xy")
    more = x.join(y, "key").where("own_x <> own_y and rep_x < rep_y").select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()
    links = links.unionByName(near(put(more.join(pairs, ["a", "b"], "left_anti"), "pairs")))

    place = F.row_number().over(Window.partitionBy("key").orderBy("own", "rep")) - 1
    members = put(own.where(F.col("n") > _SMALL).select("key", "rep", "own", F.floor(place / _BLOCK).cast("int").alias("block")), "members")
    blocks = members.groupBy("key", "block").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    t, u = (blocks.select("key", F.col("block").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}")) for k in "tu")
    meet = t.join(u, "key").where("t <= u and least(low_t, low_u) < greatest(high_t, high_u)").select("key", "t", "u", F.explode(F.array_distinct(F.array("t", "u"))).alias("block"))
    rows = members.join(meet, ["key", "block"]).join(reps.select("rep", "fingerprint"), "rep").select("key", "t", "u", "block", "own", "fingerprint")
    rows = rows.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u")
    links = links.unionByName(put(rows.mapInArrow(_compare_blocks(least), "a long, b long"), "near"))
    groups = put(components(links), "components")
    discard(*[t for t in written if t is not groups])
    labels = reps.join(groups, F.col("rep") == F.col("node"), "left").select("h", F.coalesce("component", "rep").alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.join(labels, "h", "left").select(F.col("id").alias("doc_id"), "fingerprint", component.alias("component_id"))
