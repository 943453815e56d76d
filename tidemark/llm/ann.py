"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._spark import discard, materialize, small
from tidemark.llm._text import lean

#: Vectors that the root's tree is fitted on at most, children of a node, least sampled vectors of a leaf, and leaves
#: of a tree, about.
FIT_VECTORS, BRANCHES, LEAF, BINS = 8_192, 8, 16, 64
#: Rows of a leaf above which it is clustered again, sampled rows for that, about, and levels of trees below the root.
SPLIT, FIT_BIN, DEPTH = 4_096, 2_048, 5
#: Queries whose exact neighbours calibrate the number of leaves to visit, and the recall asked of them.
CALIBRATION, RECALL = 200, 0.97
#: Leaves that are visited first.
FIRST = 4
#: Rows of a block and queries of a batch that are compared at once.
BLOCK, BATCH = 2_048, 512


@dataclass
class Tree:
    """Centres of all nodes; ``children[i]`` are node numbers, empty for leaves; ``leaf[i]`` numbers the leaves."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def opened(self, q: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``q``, leaf, and squared distance of its centre, of the first ``visits`` leaves by best-bin-first: the
        nearest node that waits is opened next, and followed down to a leaf by the nearest child.

        A node that isn't its parent's nearest child waits until all that is nearer has been opened, so a leaf's turn
        is the largest distance at which one had to wait on the way to it. All queries are ordered at once.
        """
        far = np.stack([((q - c) ** 2).sum(1) for c in self.centres])
        turn, every = np.zeros_like(far), np.arange(len(q))
        for node, own in enumerate(self.children):
            if own:
                turn[own] = np.maximum(turn[node], far[own])
                turn[np.array(own)[far[own].argmin(0)], every] = turn[node]
        nodes = np.flatnonzero(np.array(self.leaf) >= 0)
        first = nodes[np.lexsort((far[nodes], turn[nodes]), axis=0)[:visits]].T
        return np.repeat(every, first.shape[1]), np.array(self.leaf)[first].ravel(), far[first, every[:, None]].ravel()

    def order(self, q: np.ndarray, visits: int) -> list[tuple[int, float]]:
        """The leaves of :meth:`opened` for one query, with their distances."""
        _, leaf, far = self.opened(q[None], visits)
        return list(zip(leaf.tolist(), far.tolist(), strict=True))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, the nearest child at every level, and how far it is from the leaf's centre."""
        at, out, off = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
        open_nodes = [0] if len(x) else []
        while open_nodes:
            node = open_nodes.pop()
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            if not self.children[node]:
                out[mine], off[mine] = self.leaf[node], np.sqrt(((x[mine] - self.centres[node]) ** 2).sum(1))
                continue
            own = np.array(self.children[node])
            c = self.centres[own]
            at[mine] = own[(-2 * x[mine] @ c.T + (c**2).sum(1)).argmin(1)]
            open_nodes += own.tolist()
        return out, off


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5) -> Tree:
    """Cluster, then cluster each cluster, until ``leaf`` vectors or fewer (or only equal ones) are left."""
    rng = np.random.default_rng(seed)
    centres, children, leaf_no, todo, leaves = [x.mean(0)], [[]], [-1], [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop(0)
        own = x[rows]
        distinct = np.unique(own, axis=0)
        if len(rows) <= leaf or len(distinct) < 2:
            leaf_no[node], leaves = leaves, leaves + 1
            continue
        c = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
        for _ in range(12):
            near = (-2 * own @ c.T + (c**2).sum(1)).argmin(1)
            c = np.stack([own[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        near = (-2 * own @ c.T + (c**2).sum(1)).argmin(1)
        used = [k for k in range(len(c)) if (near == k).any()]
        if len(used) < 2:
            leaf_no[node], leaves = leaves, leaves + 1
            continue
        for k in used:
            children[node].append(len(centres))
            todo.append((len(centres), rows[near == k]))
            centres.append(c[k]), children.append([]), leaf_no.append(-1)
    return Tree(np.array(centres), children, leaf_no)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def _best(q: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray | None = None, seen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, exact cosines) of each query's k nearest rows, and of all that tie with the last within rounding.

    Of rows below a query's floor, and of those that it hasn't ``seen``, none.
    """
    near = _unit(q) @ _unit(x).T
    if seen is not None:
        near[~seen] = -3.0
    bar = np.full(len(q), -2.0) if floors is None else floors.copy()
    many = np.flatnonzero((near >= bar[:, None] - 1e-12).sum(1) > k)
    if len(many):
        bar[many] = np.maximum(bar[many], np.partition(near[many], -k, axis=1)[:, -k])
    i, rows = np.nonzero(near >= bar[:, None] - 1e-12)
    scores = (q[i] * x[rows]).sum(1) / (np.sqrt((q**2).sum(1))[i] * np.sqrt((x**2).sum(1))[rows])
    asked, at = np.unique(i, return_index=True)
    for n, a, b in zip(asked.tolist(), at.tolist(), [*at[1:].tolist(), len(i)][: len(at)], strict=True):
        yield n, rows[a:b], scores[a:b]


def _record(names: str, *columns: tuple[Iterable, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], names=names.split())


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: id known, all components finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _spread(df: DataFrame, *key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


_ENTRY = "v array<double>, ids array<long>, bin long, off double"
_VISIT = "id long, bin long, far double"


class Index:
    """A hierarchical k-means tree over the rows of a DataFrame, which all lie in its leaves.

    The root's tree is fitted in the driver on a bounded sample and shipped to all tasks. Leaves of more than SPLIT
    rows are clustered again, each on its own sample in an executor, until none is left, so that the number of leaves
    grows with the rows and their size doesn't. These trees are a table: they never meet in one place.
    """

    def __init__(self, entries: DataFrame):
        """``entries``: ``v`` (vectors of one length, each once) and ``ids`` (those that have it, ascending)."""
        self.spark, self.written = entries.sparkSession, []
        picked = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(FIT_VECTORS).select("v").toPandas()["v"]
        self.root = fit_tree(_unit(np.stack(picked.to_numpy()).astype(float)), leaf=max(LEAF, -(-len(picked) // BINS)))
        shipped = self.shipped = self.spark.sparkContext.broadcast(self.root)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    leaf, off = shipped.value.assign(_unit(_matrix(batch.column(0))))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(off)], names=["v", "ids", "bin", "off"])

        placed, settled, self.trees = self._put(entries.select("v", "ids").mapInArrow(lean(place), _ENTRY), "placed"), [], []
        while len(self.trees) < DEPTH:
            large = self._put(placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT), "large")
            if large.isEmpty():
                break
            inner = placed.join(small(large), "bin")
            number = F.xxhash64(F.col("ids")[0], F.lit(len(self.trees)))
            sample = inner.where(F.pmod(number, F.col("n")) < FIT_BIN).groupBy("bin").agg(F.collect_list("v").alias("rows"))  # FIT_BIN in the mean
            trees = self._put(sample.mapInArrow(_fit_bins, "bin long, tree binary"), "trees")
            blocks = inner.withColumn("block", F.pmod(number, F.ceil(F.col("n") / BLOCK))).groupBy("bin", "block").agg(F.collect_list(F.struct("v", "ids")).alias("rows"))
            settled.append(placed.join(small(large), "bin", "left_anti").select("v", "ids", "bin", "off"))
            placed = self._put(blocks.join(trees, "bin").select("bin", "tree", "rows").mapInArrow(lean(_descend), _ENTRY), "placed")
            self.trees.append(trees)
        for more in settled:
            placed = placed.unionByName(more)
        self.placed = placed
        self.leaves = self._put(placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")), "leaves")
        self.size = self.leaves.count()
        # Blocks of the leaves of one tree together: what is compared stays large where leaves are small.
        rows = placed.select(_unit_of("bin").alias("unit"), "bin", "v", "ids")
        units = self._put(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "units")
        rows = rows.join(small(units), "unit").withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.ceil(F.col("n") / BLOCK)))
        self.blocks = self._put(rows.groupBy("unit", "block").agg(F.collect_list(F.struct("v", "ids", "bin")).alias("rows")), "blocks")

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the shared folder, until :meth:`close`."""
        self.written.append(materialize(df, name))
        return self.written[-1]

    def close(self) -> None:
        """Delete the index' tables and those of its searches."""
        discard(*self.written)

    def visits(self, asked: DataFrame, count: int) -> DataFrame:
        """``id, bin, far``: the ``count`` leaves that best-bin-first traversal opens for each query, and how far their
        centres are (squared). Each tree has a queue of its own; what they open is ordered by distance again."""
        shipped = self.shipped

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _opened(shipped.value, batch.column(0), batch.column(1), count, None)

        found = _spread(asked, "id").mapInArrow(lean(opened), _VISIT)
        for trees in self.trees:
            found = self._put(found, "visits")
            batches_of = self._batches(found.join(small(trees.select("bin")), "bin").select("id", "bin"), "bin", asked).join(trees, "bin")

            def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for n in range(batch.num_rows):
                        queries = batch.column(1)[n].values
                        yield _opened(pickle.loads(batch.column(2)[n].as_py()), queries.field("id"), queries.field("v"), count, batch.column(0)[n].as_py())

            deeper = batches_of.select("bin", "queries", "tree").mapInArrow(lean(inner), _VISIT)
            found = found.join(small(trees.select("bin")), "bin", "left_anti").select("id", "bin", "far").unionByName(deeper)
            if count < self.size:
                nearest_first = Window.partitionBy("id").orderBy("far", "bin")
                found = found.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= count).drop("n")
        return found

    def _batches(self, wanted: DataFrame, key: str, asked: DataFrame) -> DataFrame:
        """The queries that go to each ``key``, with their vectors and what else ``wanted`` has, in lists of about BATCH."""
        sizes = small(self._put(wanted.groupBy(key).agg(F.count(F.lit(1)).alias("askers")), "sizes"))
        dealt = wanted.join(sizes, key).withColumn("batch", F.pmod(F.xxhash64("id"), F.ceil(F.col("askers") / BATCH))).join(asked, "id")
        own = F.struct("id", "v", *[c for c in wanted.columns if c not in ("id", key)])
        return _spread(dealt.select(key, "batch", own.alias("own")), key, "batch").groupBy(key, "batch").agg(F.collect_list("own").alias("queries"))

    def compare(self, visits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """``query_id, vec_id, score``: of each block of leaves of which a query visits some (``id, bin, floor``), the k
        nearest rows of those whose score is not below its floor."""

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    rows, queries = batch.column(0)[n].values, batch.column(1)[n].values
                    ids, q_ids, floors = rows.field("ids"), queries.field("id").to_pylist(), np.asarray(queries.field("floor"))
                    bins, leaf = np.unique(np.asarray(rows.field("bin")), return_inverse=True)
                    lists = queries.field("bins")
                    who, wanted = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
                    at = np.minimum(np.searchsorted(bins, wanted), len(bins) - 1)
                    there, seen = bins[at] == wanted, np.zeros((len(lists), len(bins)), bool)
                    seen[who[there], at[there]] = True
                    found = []
                    for i, near, scores in _best(_matrix(queries.field("v")), _matrix(rows.field("v")), k + 1, floors, seen[:, leaf]):
                        own = sorted((-s, x) for r, s in zip(near.tolist(), scores.tolist(), strict=True) if s >= floors[i] for x in ids[r].as_py() if x != q_ids[i])[:k]
                        found += [(q_ids[i], x, -s) for s, x in own]
                    if found:
                        a, b, c = zip(*found, strict=True)
                        yield _record("query_id vec_id score", (a, pa.int64()), (b, pa.int64()), (c, pa.float64()))

        wanted = visits.groupBy("id", _unit_of("bin").alias("unit")).agg(F.collect_list("bin").alias("bins"), F.first("floor").alias("floor"))
        batches = self._batches(self._put(wanted, "wanted"), "unit", asked)
        return self.blocks.join(batches, "unit").select("rows", "queries").mapInArrow(lean(met), "query_id long, vec_id long, score double")

    def exact_leaves(self, trial: DataFrame, k: int) -> DataFrame:
        """``id, bin, vec_id``: the leaves that hold the true k nearest rows of a bounded set of queries."""
        asked = trial.toPandas()
        q, q_ids = np.stack(asked["v"].to_numpy()).astype(float), asked["id"].tolist()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[float, int, int]]] = [[] for _ in q_ids]
            for batch in batches:
                if batch.num_rows:
                    ids, bins = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                    for i, rows, scores in _best(q, _matrix(batch.column(0)), k + 1):
                        best[i] = sorted(best[i] + [(-s, x, bins[r]) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for x in ids[r] if x != q_ids[i]])[:k]
            found = [(q_ids[i], leaf, s, x) for i, own in enumerate(best) for s, x, leaf in own]
            if found:
                yield _record("id bin s vec_id", *zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))

        order = Window.partitionBy("id").orderBy("s", "vec_id")
        near = self.placed.select("v", "ids", "bin").mapInArrow(lean(scan), "id long, bin long, s double, vec_id long")
        return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("id", "bin", "vec_id")

    def calibrated(self, asked: DataFrame, k: int, recall: float) -> int:
        """Leaves to visit: of FIRST and half as many more at each step, the least (by bisection) that holds ``recall`` of
        the true neighbours of CALIBRATION queries."""
        trial = self._put(asked.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION), "trial")
        if trial.isEmpty():
            return 1
        truth = self._put(self.exact_leaves(trial, k), "truth")
        all_of, counts = truth.count(), [FIRST]
        while counts[-1] < self.size:
            counts.append(-(-counts[-1] * 3 // 2))
        low, high = 0, len(counts) - 1  # all leaves hold all neighbours
        while low < high:
            middle = (low + high) // 2
            held = truth.join(self.visits(trial, counts[middle]).select("id", "bin"), ["id", "bin"], "left_semi").count()
            low, high = (low, middle) if held >= recall * all_of else (middle + 1, high)
        return min(counts[low], self.size)

    def search(self, asked: DataFrame, k: int, recall: float) -> DataFrame:
        """``query_id, rank, vec_id, score`` of the k nearest rows in the leaves visited.

        First each query visits its FIRST nearest leaves. Of the others it needs only those that can hold a row nearer
        than its k-th so far (by the distance of the centre and the radius), and of their rows only the nearer ones.
        """
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

        def top(found: DataFrame) -> DataFrame:
            found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        count = self.calibrated(asked, k, recall)
        order = Window.partitionBy("id").orderBy("far", "bin")
        visits = self._put(self.visits(asked, count).withColumn("n", F.row_number().over(order)), "visits")
        early = self._put(top(self.compare(visits.where(F.col("n") <= FIRST).withColumn("floor", F.lit(-2.0)), asked, k)), "early")
        floors = early.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        late = visits.where(F.col("n") > FIRST).join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        reach = F.sqrt("far") - F.col("radius") <= F.sqrt(F.greatest(2 - 2 * F.col("floor"), F.lit(0.0))) + 1e-9
        late = self._put(late.join(small(self.leaves.select("bin", "radius")), "bin").where(reach).select("id", "bin", "floor"), "late")
        found = early.select("query_id", "vec_id", "score").unionByName(self.compare(late, asked, k))
        return top(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _opened(tree: Tree, ids: pa.Array, vectors: pa.Array, count: int, above: int | None) -> pa.RecordBatch:
    """The leaves of one tree that each query opens; leaves below a bin are numbered by it."""
    at, leaf, far = tree.opened(_unit(_matrix(vectors)), count)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(leaf if above is None else _below(above, leaf)), pa.array(far)], names=["id", "bin", "far"])


def _below(bin_: int, leaf: np.ndarray) -> np.ndarray:
    return (bin_ + 1) * 1024 + leaf  # a tree has fewer than 1,024 leaves


def _unit_of(bin_: str) -> Column:
    """The bin that a leaf's tree stands below; of the root's leaves each its own."""
    return F.when(F.col(bin_) < 1024, F.col(bin_)).otherwise(F.expr(f"{bin_} div 1024 - 1"))


def _fit_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            x = _unit(_matrix(batch.column(1)[n].values))
            yield _record("bin tree", ([batch.column(0)[n].as_py()], pa.int64()), ([pickle.dumps(fit_tree(x, leaf=max(LEAF, -(-len(x) // BINS))))], pa.binary()))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            rows = batch.column(2)[n].values
            leaf, off = pickle.loads(batch.column(1)[n].as_py()).assign(_unit(_matrix(rows.field("v"))))
            yield pa.RecordBatch.from_arrays([rows.field("v"), rows.field("ids"), pa.array(_below(batch.column(0)[n].as_py(), leaf)), pa.array(off)], names=["v", "ids", "bin", "off"])


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows of ``df`` by cosine that the search finds.

    ``queries`` has the same columns. Every row is put into a leaf of a hierarchical k-means tree (:class:`Index`).
    At most CALIBRATION of the queries are first answered exactly over all rows; leaf visits are widened until the
    leaves visited hold ``recall`` of their neighbours. All queries then visit that many leaves, best bin first, and
    are compared with all rows in them, in blocks. Equal vectors are one entry with its k + 1 smallest ids, so a vector
    that very many rows share costs no more than another. A row is never its own query's neighbour; ties go to the
    smaller id. Null, zero, non-finite vectors and null ids take no part; rows that repeat an id count once for each
    different vector, of a repeated query the least vector asks. Vectors are compared with those of their own length
    only, each length is searched by itself. Fewer rows than ``k`` give as many ranks; none give no result.
    """
    every, asked = _vectors(df, id_col, vec_col), _vectors(queries, id_col, vec_col)
    found = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = materialize(asked.groupBy("id").agg(F.min("v").alias("v")), "asked")
    rows = every.distinct()
    few = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    entries = materialize(rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")  # k + 1 ids at most
    for r in sorted(entries.groupBy(F.size("v").alias("n")).count().collect()):  # one row a length
        own = F.size("v") == r["n"]
        index = Index(entries.where(own))
        found = found.unionByName(materialize(index.search(asked.where(own), k, recall), "nearest"))
        index.close()
    discard(asked, entries)
    return found


def measured_recall(df: DataFrame, queries: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Share of the true neighbours for which ``found`` has rows as near as they, by brute force over all rows.

    For a bounded set of queries (they are shipped to all tasks).
    """
    asked = _vectors(queries, id_col, vec_col).toPandas()
    if not len(asked):
        return 1.0
    k = found.agg(F.max("rank")).first()[0] or 1
    q, q_ids = [np.asarray(v, float) for v in asked["v"]], asked["id"].tolist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            sizes = np.asarray(batch.column(1).value_lengths())
            for n in np.unique(sizes):
                mine = np.flatnonzero(sizes == n)
                x = _matrix(batch.column(1).take(pa.array(mine)))
                for i, v in zip(q_ids, q, strict=True):
                    if len(v) == n:
                        s = np.where(ids[mine] == i, -2, (x @ v) / (np.sqrt((x**2).sum(1)) * np.sqrt((v**2).sum())))
                        s = np.sort(s[s > -1.5])[::-1][:k]
                        yield _record("query_id score", (np.full(len(s), i), pa.int64()), (s, pa.float64()))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    true = _vectors(df, id_col, vec_col).mapInArrow(lean(scan), "query_id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    true = true.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("wanted"))
    as_near = F.sum((F.col("score") >= F.col("floor") - 1e-9).cast("int"))
    got = true.join(found.select("query_id", "score"), "query_id", "left").groupBy("query_id").agg(F.first("wanted").alias("wanted"), F.coalesce(as_near, F.lit(0)).alias("got"))
    return got.agg(F.sum(F.least("got", "wanted")) / F.sum("wanted")).first()[0]
