"""MinHash near-duplicate detection with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._spark import discard, materialize, small
from tidemark.llm._text import lean, mix, ngrams, slices, spans, word_hashes
from tidemark.llm.components import components

#: Members of a bucket of which all pairs across groups are compared, and members of a led group that are compared
#: with the rest of it before the remaining links are searched for.
FEW, LEADERS = 32, 8
#: Parts that every led group is dealt to while its heaviest members are found and compared with the others.
_SALTS = 8


def _sketcher(shingle: int, pieces: int, width: int):
    seeds = mix(np.arange(1, 2 * pieces * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                start, end, bounds = spans(data, off)
                grams, _, rows = ngrams(word_hashes(data, start, end), bounds, shingle)
                n = hi - lo
                size, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                full = np.flatnonzero(np.diff(rows))
                lists = np.zeros((len(full), 2 * pieces), np.uint64)
                if len(full):
                    parts = [np.unique(grams[rows[r] : rows[r + 1]]) for r in full]
                    size[full] = [len(p) for p in parts]
                    grams = np.concatenate(parts)
                    at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    k1[full] = np.add.reduceat(mix(grams ^ np.uint64(0x243F6A8885A308D3)), at)
                    k2[full] = np.add.reduceat(mix(grams ^ np.uint64(0x13198A2E03707344)), at)
                    for p in range(2 * pieces):
                        for s in seeds[p * width : (p + 1) * width]:
                            least = np.minimum.reduceat((grams ^ (s >> np.uint64(7))) * s, at)
                            lists[:, p] = mix(lists[:, p] * np.uint64(31) + least)
                ends = np.zeros(n + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, 2 * pieces, 0))
                pieces_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n).cast(pa.int64()), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pieces_of], schema=schema)

    return lean(sketch)


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for lo, hi, data, off in slices(column):
        start, end, bounds = spans(data, off)
        grams, _, rows = ngrams(word_hashes(data, start, end), bounds, shingle)
        for r in range(hi - lo):
            yield np.unique(grams[rows[r] : rows[r + 1]])


def _differences(shingle: int):
    """(leader, x, shingles in one of the two texts only) of pairs (a = leader, b = x)."""
    schema = pa.schema([("leader", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("own", pa.list_(pa.int64()))])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = [], []
            for x, y in zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle), strict=True):
                sizes.append(len(y)), own.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int64()))], schema=schema)

    return lean(differ)


def _checker(shingle: int, numerator: int, denominator: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle), strict=True)):
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                found[i] = common > 0 and denominator * common >= numerator * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], schema=schema)

    return lean(check)


def _candidates(reps: DataFrame, pieces: int, put) -> DataFrame:
    """(key, rep, n, weight) of the tables' rows that share their key's two halves with another document.

    A table's key combines one piece of the left collection and one of the right one. Two documents that meet in a
    table share both pieces, so pieces that only one document has are left out before the keys are formed: what is
    shuffled is 2 x pieces rows a document, not pieces x pieces.
    """
    cells = reps.select("rep", "n", F.posexplode("sketch").alias("p", "piece"))
    shared = cells.groupBy("p", "piece").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = put(shared, "shared")  # a join of two plain exchanges can be split where a piece is very common
    cells = cells.join(shared, ["p", "piece"]).groupBy("rep", "n")
    cells = cells.agg(F.collect_list(F.struct("p", "piece")).alias("cells"), F.sum("many").alias("weight"))  # at most 2 x pieces
    left = F.filter("cells", lambda c: c["p"] < pieces)
    right = F.filter("cells", lambda c: c["p"] >= pieces)
    keys = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x["p"], y["p"], x["piece"], y["piece"]))))
    return cells.select("rep", "n", "weight", F.explode(keys).alias("key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, numerator: int = 4, denominator: int = 5, pieces: int = 8, width: int = 2) -> DataFrame:
    """Link documents whose sets of word shingles have Jaccard similarity >= numerator / denominator.

    Returns one row per input row: ``doc_id, n_shingles, component_id`` (smallest id reachable over links),
    ``kept`` (the row's id is its component's).

    *Tensored banding.* Two collections of ``pieces`` hashes, each of ``width`` min-wise values, give
    ``pieces ** 2`` tables keyed by a pair of pieces, from ``2 * pieces * width`` min-wise values in all. With 8
    pieces of 2 values, a pair at similarity 0.85 shares a table with probability above 0.9999, at 0.8 above 0.9994.
    *Verification.* Every link is confirmed on the two full shingle sets, recomputed from the texts.
    *Large groups.* Documents with equal sets are first collapsed to one representative. Each document is compared
    with one leader (the member of its buckets that shares most pieces with others), so a group of n copies costs n
    comparisons. Where a bucket's members are not in one component by then, a few more members of the group are
    compared (each group dealt to several tasks), and at last the members' differences from their leader are joined by
    a prefix filter, which finds every link that is left between members of a bucket. Nothing is capped.

    Nulls: a null or empty text has no shingles and no link. A null id takes no part and has a null component.
    Rows that repeat an id count as one document, linked by any of its texts. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    written: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        written.append(materialize(df, name))
        return written[-1]

    sketch = _sketcher(shingle, pieces, width)
    sketches = materialize(rows.mapInArrow(sketch, "id long, n long, k1 long, k2 long, sketch array<long>"), "sketches")
    reps = sketches.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "representatives")
    # One document may be several rows' smallest id (a repeated id); those sets belong together.
    same = reps.groupBy("rep").agg(F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    cells = put(_candidates(same, pieces, put), "candidates")
    weights = cells.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    cells = put(cells.join(weights, "key"), "buckets")

    def with_texts(pairs: DataFrame) -> DataFrame:
        wanted = put(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
        texts = put(rows.join(small(wanted), "id", "left_semi"), "texts")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        return both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def near_in_size(n: str, m: str):
        return F.least(n, m) * denominator >= F.greatest(n, m) * numerator

    links = checked = groups = None

    def verify(pairs: DataFrame) -> None:
        nonlocal links, checked, groups
        pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        pairs = put(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        done = put(with_texts(pairs).mapInArrow(_checker(shingle, numerator, denominator), "a long, b long, linked boolean"), "verified")
        found = done.where("linked").select("a", "b")
        links = found if links is None else links.unionByName(found)
        checked = done.select("a", "b") if checked is None else checked.unionByName(done.select("a", "b"))
        groups = put(components(links), "components")

    def mixed() -> DataFrame:
        """Rows of the buckets whose members are in several components, with their component ``own``."""
        known = cells.join(groups, cells["rep"] == groups["node"], "left").select(cells["*"], F.coalesce("component", "rep").alias("own"))
        several = known.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("key")
        return put(known.join(several, "key", "left_semi"), "open")

    # First each document with its leader: of the heaviest members of its buckets the heaviest one.
    first = cells.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("col2"), F.col("n").alias("head_n"))).alias("head"))
    first = put(first.select("key", "head"), "leaders")
    led = cells.join(first, "key").groupBy("rep", "n", "weight").agg(F.max("head").alias("head"))
    led = put(led.select("rep", "n", "weight", (-F.col("head.col2")).alias("leader"), F.col("head.head_n").alias("leader_n")), "led")
    verify(led.where((F.col("leader") != F.col("rep")) & near_in_size("n", "leader_n")).select(F.col("rep").alias("p"), F.col("leader").alias("q")))
    rest = mixed()
    if not rest.isEmpty():
        # Then a few more members of each led group, the heaviest ones, with its documents in other components.
        rest = put(rest.join(led.select("rep", "leader"), "rep"), "led-cells")
        members = rest.groupBy("rep", "n", "leader", "weight", "own").agg(F.lit(1)).drop("1").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(_SALTS)))
        heads = members
        for part in (["leader", "salt"], ["leader"]):  # of each part first, then of what these have left
            best = Window.partitionBy(*part).orderBy(F.desc("weight"), "rep")
            heads = heads.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LEADERS)
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt")
        heads = heads.select("leader", F.col("rep").alias("q"), F.col("n").alias("q_n"), F.col("own").alias("q_own"), salts)
        met = members.join(heads, ["leader", "salt"]).where((F.col("q_own") != F.col("own")) & near_in_size("n", "q_n"))
        verify(met.select(F.col("rep").alias("p"), "q"))
        rest = put(mixed().join(led.select("rep", "leader"), "rep"), "led-cells")
    if not rest.isEmpty():
        # What is left of links lies between documents of different groups in a small bucket: all these pairs;
        several = rest.groupBy("key").agg(F.min("leader").alias("x"), F.max("leader").alias("y")).where("x < y").select("key")
        crossing = rest.join(several, "key")
        few = crossing.where(F.col("many") <= FEW).select("key", F.col("rep").alias("p"), "n", "leader", "own")
        other = few.select("key", F.col("p").alias("q"), F.col("n").alias("q_n"), F.col("leader").alias("q_leader"), F.col("own").alias("q_own"))
        pairs = few.join(other, "key").where((F.col("p") < F.col("q")) & (F.col("leader") != F.col("q_leader")) & (F.col("own") != F.col("q_own")) & near_in_size("n", "q_n")).select("p", "q")
        # or between documents of one group (those of a large bucket of several groups form one with its leader). Let
        # D be what a document has that the leader hasn't, and the other way round. Of two linked documents in two
        # components D is large against what they may differ in, so that their D must meet in their rarest elements.
        large = crossing.where(F.col("many") > FEW).join(first, "key").select((-F.col("head.col2")).alias("a"), F.col("rep").alias("b"))
        # This holds only if each member has been compared with that leader, also with the head of a bucket of several groups.
        heads = put(large.where("a <> b").distinct(), "heads")
        for x in ("a", "b"):
            known = same.select(F.col("rep").alias(x), F.col("n").alias(f"{x}_n")).join(groups.select(F.col("node").alias(x), "component"), x, "left")
            heads = heads.join(known.select(x, f"{x}_n", F.coalesce("component", x).alias(f"{x}_own")), x)
        heads = heads.where((F.col("a_own") != F.col("b_own")) & near_in_size("a_n", "b_n"))
        verify(pairs.unionByName(heads.select(F.col("a").alias("p"), F.col("b").alias("q"))))
        groups_of = rest.select(F.col("leader").alias("a"), F.col("rep").alias("b")).unionByName(large).where("a <> b").distinct()
        own = with_texts(put(groups_of, "groups")).mapInArrow(_differences(shingle), "leader long, x long, n long, own array<long>")
        slack = F.floor(F.col("n") * (denominator - numerator) / numerator).cast("long")  # most that a link's two sets differ in
        own = put(own.select("leader", "x", "n", F.size("own").alias("size"), slack.alias("slack"), "own"), "differences")
        each = own.select("leader", "x", "n", "size", "slack", F.explode("own").alias("e"))
        often = each.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("often"))
        rarest = Window.partitionBy("leader", "x").orderBy("often", "e")
        each = each.join(often, ["leader", "e"]).withColumn("rank", F.row_number().over(rarest)).where("often > 1 and rank <= slack + 1")
        each = each.join(groups.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("own", F.coalesce("component", "x"))
        each = put(each.select("leader", "e", "x", "n", "size", "slack", "rank", "own"), "rarest")
        # Two linked documents' D differ in as much as the two do: in ``most`` elements at most. So they have
        # (size + q_size - most) / 2 elements in common, and the first of these has a low rank in both.
        held = each.select("leader", "e", F.col("x").alias("q"), F.col("n").alias("q_n"), F.col("size").alias("q_size"), F.col("rank").alias("q_rank"), F.col("own").alias("q_own"))
        asked = each.where("rank <= slack div 2 + 1").select("leader", "e", F.col("x").alias("p"), "n", "size", "rank", "own")
        most = F.floor((F.col("n") + F.col("q_n")) * (denominator - numerator) / (denominator + numerator))
        early = (2 * F.col("rank") <= F.col("size") - F.col("q_size") + most + 2) & (2 * F.col("q_rank") <= F.col("q_size") - F.col("size") + most + 2)
        met = asked.join(held, ["leader", "e"]).where((F.col("own") != F.col("q_own")) & (F.col("size") <= F.col("q_size")) & near_in_size("n", "q_n") & early)
        met = put(met.select("leader", "p", "q").distinct(), "met")
        # How much two D differ decides before the texts are read again.
        for x in ("p", "q"):
            met = met.join(own.select("leader", F.col("x").alias(x), F.col("n").alias(f"{x}_n"), F.col("own").alias(f"{x}_own")), ["leader", x])
        differ = F.size("p_own") + F.size("q_own") - 2 * F.size(F.array_intersect("p_own", "q_own"))
        both = F.col("p_n") + F.col("q_n")
        verify(met.where((both - differ) * denominator >= (both + differ) * numerator).select("p", "q"))

    discard(*[t for t in written if t is not groups])
    labels = reps.join(groups, reps["rep"] == groups["node"], "left").select("k1", "k2", reps["n"].alias("n"), F.coalesce("component", "rep").alias("component_id"))
    found = sketches.join(labels, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, the one with the smallest id; null ids stay, and all
    rows that repeat the id that stays. Null and empty texts are near nothing; further columns may have any name."""
    gone = near_duplicates(docs, id_col, **how).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
