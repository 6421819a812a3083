"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins by quantiles. Boosting goes round the features in
turn: a shallow tree on one feature fits the residual of the logistic loss, and its values, shrunken,
are added to that feature's table. Then the pairs with the largest gains (found on coarse bins) are boosted
the same way, with trees over two features. A model is its tables; a score is the sigmoid of a sum of look-ups, one
vectorised addition a table.

Features are computed from the whole text only. Labels are learnt from a bounded, hash-chosen
sample of labelled documents (``SAMPLE``), joined by doc_id.

Edge cases: a null text is an empty one and is scored as such. Labels that are null or name no document
are not used; a document labelled more than once counts once for each label. Without both
classes among the labels, every score is the share of 1s learnt (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import crc_mod, slices

#: Labelled documents at most; bins of a feature, and of each side of a pair.
SAMPLE, BINS, PAIR_BINS = 20_000, 64, 8
#: Rounds over all features, rounds over the pairs, pairs, shrinkage, leaves of a tree, least weight of a leaf.
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, LEAST = 60, 20, 8, 0.15, 4, 2.0
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "log_lines", "mean_word", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "other", "blanks",
    "shouting", "doubled_marks", "distinct_words", "top_word", "distinct_lines", "mean_line", "end_marks", "pipes", "squeeze", "repeated_pairs", "vowels", "capitalised",
)

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 blank, 7 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True


def describe(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    text = text or ""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=8) / n
    words = data.split()
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    marks = kinds == 4
    marks |= kinds == 5
    start = raw[np.flatnonzero((kinds[1:] != 6) & (kinds[:-1] == 6)) + 1] if len(raw) > 1 else raw
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lens.sum() / m, (lens > 14).sum() / m, (lens < 3).sum() / m,
        share[2], share[3], share[4], share[5], share[7] + share[0], share[6],
        ((kinds[1:] == 2) & (kinds[:-1] == 2)).sum() / n, (marks[1:] & (raw[1:] == raw[:-1])).sum() / n,
        len(seen) / m, max(seen.values(), default=0) / m, len(set(lines)) / k, np.log1p(n / k), sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, data.count(b"|") / m,
        _squeeze(data), len(pairs) / m, _VOWEL[raw].sum() / n, (_CLASS[start] == 2).sum() / m,
    ]


def _squeeze(data: bytes) -> float:
    """Compressed share of a text, piece by piece."""
    return sum(len(zlib.compress(data[s : s + 65536], 1)) for s in range(0, len(data), 65536)) / max(1, len(data))


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` names the features of each pair table."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 for rows of features: look-ups and additions."""
        total = np.full(len(x), self.base)
        for f, e in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(e, x[:, f], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values a bin of a shallow tree over ordered bins: at most ``LEAVES`` intervals, split where the gain is largest."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            c = np.arange(a + 1, b)
            if not len(c):
                continue
            gain = worth(a, c) + worth(c, b) - worth(a, b)
            gain[(ch[c] - ch[a] < LEAST) | (ch[b] - ch[c] < LEAST)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], leaf, int(c[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one split on each of two features: its gain and its values."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0))) for v in (g, h))
    best, out = 0.0, np.zeros_like(g)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    for a in range(1, len(g)):
        for b in range(1, g.shape[1]):
            part = []
            for s, e in (((0, a), (0, b)), ((0, a), (b, -1)), ((a, -1), (0, b)), ((a, -1), (b, -1))):
                part.append([v[s[1], e[1]] - v[s[0], e[1]] - v[s[1], e[0]] + v[s[0], e[0]] for v in (cg, ch)])
            gain = sum(p[0] ** 2 / (p[1] + 1) for p in part) - whole
            if gain > best:
                best = gain
                v = [p[0] / (p[1] + 1) for p in part]
                out = np.zeros_like(g)
                out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on features ``x`` and classes ``y`` (0 or 1)."""
    f = x.shape[1]
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(base, [np.empty(0)] * f, np.zeros((f, 1)), [], [np.empty(0)] * f, np.zeros((0, 1, 1)))
    edges, coarse = [_edges(x[:, k], BINS) for k in range(f)], [_edges(x[:, k], PAIR_BINS) for k in range(f)]
    bins = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)])
    wide = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)])
    tables = np.zeros((f, BINS + 1))
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k in range(f):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(bins[k], y - p, BINS + 1)
            h = np.bincount(bins[k], p * (1 - p), BINS + 1)
            step = RATE * _tree(g, h)
            tables[k] += step
            total += step[bins[k]]
    n = PAIR_BINS + 1
    p = 1 / (1 + np.exp(-total))

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[a] * n + wide[b], v, n * n).reshape(n, n)

    ranked = sorted(((_cross(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b) for a in range(f) for b in range(a)), reverse=True)
    pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    pair_tables = np.zeros((len(pairs), n, n))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _cross(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            pair_tables[k] += step
            total += step[wide[a], wide[b]]
    return Model(base, edges, tables, pairs, coarse, pair_tables)


def described(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns and the features of ``text`` as an array."""
    fields = [docs.schema[c] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [describe(t.as_py()) for t in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(rows, pa.list_(pa.float64()))], names=[*carry, "x"])

    return docs.select(*carry, "text").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", x array<double>")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_fold: int = 0, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labels (those of least hash of their doc_id) outside the held fold."""
    known = labels.filter(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != held_fold)).select(F.col("doc_id").alias("known_id"), F.col(label).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("known_id"), "known_id", "y").limit(sample)
    # at most ``sample`` rows of two numbers: small whatever the data
    rows = described(docs.join(F.broadcast(few), docs["doc_id"] == few["known_id"]).select("known_id", "y", "text"), "known_id", "y").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y = rows["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[:2], y, rows["known_id"].to_numpy())) if len(y) else []
    return fit(x[order], y[order]) if len(y) else fit(x, y)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([describe(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text of ``docs`` (doc_id, text)."""
    model = learn(docs.select("doc_id", "text"), labels)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more."""
    model = learn(docs.select("doc_id", "text"), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([describe(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
