"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import map_rows, small_batches
from tidemark.llm._text import lean, mix, slices, spans, word_hashes

#: Labelled documents that the field is fitted on at most (half of each label), and lines of each of these.
FIT_DOCUMENTS, FIT_LINES = 4_000, 200
_BINS = 16
_FEATURES = 12


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_UPPER = _class_table(bytes(range(65, 91)))
_LETTER = _class_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _class_table(b"0123456789")
_SYMBOL = _class_table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-:;()\"?!|"))
_BAR = _class_table(b"|")
_BANG = _class_table(b"!")
_STOP = _class_table(b".,;?")
_ODD = _class_table(bytes([*range(0, 9), *range(14, 32), 127]))
_CHAR = _class_table(bytes(c for c in range(256) if c & 0xC0 != 0x80))


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, characters of each line, bounds of the rows in the lines); an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]))
    row_first = np.searchsorted(breaks, off[:-1]) + np.arange(len(off) - 1)
    bounds = np.concatenate([row_first, [len(begin)]])
    finish = np.concatenate([begin[1:], [len(data)]])
    inner = np.ones(len(begin), bool)
    inner[bounds[1:] - 1] = False  # lines that end in a line break
    finish = finish - inner

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return (total[finish] - total[begin]).astype(float)

    start, end, _ = spans(data, off)
    words = word_hashes(data, start, end, fold=False)
    first = np.searchsorted(start, begin)
    last = np.searchsorted(start, finish)
    n = np.maximum(last - first, 0).astype(float)

    def repeats(lag: int) -> np.ndarray:
        same = np.zeros(len(words) + 1, np.int64)
        if len(words) > lag:
            same[lag + 1 :] = np.cumsum(words[lag:] == words[:-lag])
        return np.maximum(same[last] - same[np.minimum(first + lag, len(words))], 0).astype(float)

    chars, letters = count(_CHAR), count(_LETTER)
    solid = np.maximum(chars - n + 1, 1)
    per_word = np.maximum(n, 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words))])
    key = sums[last] - sums[first] + n.astype(np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((key, row))
    twin = np.zeros(len(key), bool)
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    twin[order[1:][same]] = True
    columns = [
        np.log1p(chars), chars / per_word, count(_UPPER) / np.maximum(letters, 1), count(_SYMBOL) / solid, count(_DIGIT) / solid,
        count(_BAR) / per_word, count(_BANG) / per_word, repeats(1) / per_word, repeats(2) / per_word, count(_STOP) / per_word,
        count(_ODD) / solid, twin.astype(float),
    ]
    return np.stack(columns, 1), chars, bounds


@dataclass
class Field:
    """A fitted field: bin edges of each feature, weights of the bins of a line and its two neighbours, transitions."""

    edges: list[np.ndarray]
    weights: np.ndarray  # 3 x features x bins
    bias: float
    transitions: np.ndarray  # 2 x 2, from state to state; state 1 is good

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def emissions(self, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-odds of good over bad for each line from its own features and those of the lines beside it."""
        each = np.arange(bins.shape[1])
        own, before, after = (w[each, bins].sum(1) for w in self.weights)
        out = own + self.bias
        edge = np.zeros(len(bins) + 1, bool)
        edge[bounds[:-1]] = True
        joined = ~edge[1:-1] if len(bins) else edge[:0]
        out[1:] += before[:-1] * joined
        out[:-1] += after[1:] * joined
        return out


def forward_backward(emission: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probability of good for each line, and of each pair of states summed over neighbouring lines.

    All chains advance together; those that have ended drop out.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    good, step = np.exp(np.clip(emission, -30, 30)), np.exp(transitions)
    alpha, beta = np.zeros((len(emission), 2)), np.ones((len(emission), 2))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = start[: active[t]] + t
        a = np.ones((len(at), 2)) if t == 0 else alpha[at - 1] @ step
        a[:, 1] *= good[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = beta[at + 1].copy()
        b[:, 1] *= good[at + 1]
        b = b @ step.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(emission), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    after = beta[at].copy()
    after[:, 1] *= good[at]
    pair = alpha[at - 1][:, :, None] * step[None] * after[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return both[:, 1], pair.sum(0)


def _edges(x: np.ndarray) -> np.ndarray:
    """Upper bounds of a feature's bins: quantiles of all its values and, as most are 0 for many, of those above 0."""
    some = x[x > 0]
    high = np.quantile(some, (0.2, 0.5, 0.8)) if len(some) else np.zeros(0)
    return np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, _BINS - 3)[1:-1]), high]))[: _BINS - 1]


def fit_field(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = 120, ridge: float = 2.0) -> Field:
    """Maximise the penalised conditional likelihood, every line taking its document's label, by Adam."""
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    field = Field(edges, np.zeros((3, x.shape[1], _BINS)), 0.0, np.zeros((2, 2)))
    bins = field.bins(x)
    size = np.diff(bounds)
    y = np.repeat(labels, size).astype(float)
    rate = np.repeat(1.0 / np.maximum(np.bincount(labels, minlength=2), 1)[labels] / size, size) * len(labels) / 2
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    flat = bins + np.arange(x.shape[1]) * _BINS
    theta, m, v = np.zeros(3 * x.shape[1] * _BINS + 5), 0.0, 0.0
    for k in range(1, steps + 1):
        field.weights, field.bias, field.transitions = theta[5:].reshape(3, x.shape[1], _BINS), theta[4], theta[:4].reshape(2, 2)
        p, pairs = forward_backward(field.emissions(bins, bounds), bounds, field.transitions)
        lean = (y - p) * rate
        before, after = np.zeros_like(lean), np.zeros_like(lean)
        before[at - 1], after[at] = lean[at], lean[at - 1]
        sums = [np.bincount(flat.ravel(), np.repeat(g, x.shape[1]), x.shape[1] * _BINS) for g in (lean, before, after)]
        slope = np.concatenate([(seen - pairs).ravel() / max(len(y), 1) * len(labels), [lean.sum()], *sums]) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.weights, field.bias, field.transitions = theta[5:].reshape(3, x.shape[1], _BINS), theta[4], theta[:4].reshape(2, 2)
    return field


def _spread(n: int, most: int) -> np.ndarray:
    """All of n lines, or at most ``most`` in four runs at even distances, the first and the last line among them."""
    if n <= most:
        return np.arange(n)
    run = max(1, most // 4)
    return np.unique(np.concatenate([start + np.arange(run) for start in np.linspace(0, n - run, 4).astype(int)]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", documents: int = FIT_DOCUMENTS, lines: int = FIT_LINES) -> Field | None:
    """Fit a field on a bounded sample: at most ``documents`` labelled rows, half of each label, in the order of a
    hash of their ids, and at most ``lines`` lines of each, in four runs spread over the text. None where there is no
    labelled row.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    half = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(documents // 2) for c in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(half[0].unionByName(half[1])), "id").select("text", "label")
    schema = pa.schema([("label", pa.int32()), ("x", pa.binary())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(0)):
                x, _, bounds = line_features(data, off)
                out = [x[a + _spread(b - a, lines)].astype("<f4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(out, pa.binary())], schema=schema)

    found = sorted((r["label"], bytes(r["x"])) for r in rows.mapInArrow(lean(collect), "label int, x binary").collect())
    if not found:
        return None
    each = [np.frombuffer(x, "<f4").reshape(-1, _FEATURES).astype(float) for _, x in found]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return fit_field(np.concatenate(each), bounds, np.array([c for c, _ in found]))


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the mean of the lines' marginals of being good, weighted by their characters.

    Only the text is read. A null or empty text counts as one empty line. Without a field every score is 0.5.
    Null ids are kept; repeated rows are scored each; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                if field is None:
                    mean = np.full(hi - lo, 0.5)
                else:
                    x, chars, bounds = line_features(data, off)
                    p, _ = forward_backward(field.emissions(field.bins(x), bounds), bounds, field.transitions)
                    weight = chars + 1e-6
                    mean = np.add.reduceat(p * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.clip(mean, 0, 1))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(lean(marginals), "doc_id long, score double")


def keep_good(docs: DataFrame, field: Field | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, decided row by row in one pass.

    Null texts are scored as empty ones, repeated rows alike; columns may have any name; an empty table stays empty.
    """
    if field is None:
        return docs
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(names.index(text_col)).cast(pa.string())):
                x, chars, bounds = line_features(data, off)
                p, _ = forward_backward(field.emissions(field.bins(x), bounds), bounds, field.transitions)
                weight = chars + 1e-6
                mean = np.add.reduceat(p * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])
                yield batch.slice(lo, hi - lo).filter(pa.array(mean >= threshold))

    small_batches(docs.sparkSession)
    return map_rows(docs, lean(keep))
