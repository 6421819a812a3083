"""Language identification by a convolutional network over bytes.

The network embeds each byte, runs filters of several widths over the embedded bytes of
a fixed-length window, rectifies, takes each filter's greatest value over the window, and
turns these into class probabilities (softmax). It is trained here, in numpy, with Adam, on a bounded, hash-chosen
sample of windows of labelled texts, drawn from the whole length of each. Whole texts are scored: every window of a text is one row of a
batch, and the text's score is the mean of its windows' log probabilities, weighted by their bytes. Windows are as long in training as in scoring.

For scoring, embedding and filters are multiplied out into a table for each place of a filter
(256 rows, one a byte), so a filter's response is a sum of table rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0. With no labelled
text at all, every text is ``und``; with one language only, all texts with letters are of that language. Ties go to the
language that comes first in alphabetical order. Very long texts are scored whole, one without letters read to its end. Repeated rows give repeated
results, and count once in training. An empty table gives an empty result. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import crc_mod

#: Bytes of a window; filter widths and filters of each; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Training: labelled texts at most for each language, windows taken of each, passes, batch and step.
SAMPLE, PER_TEXT, EPOCHS, BATCH, RATE = 400, 2, 6, 64, 0.01


@dataclass
class Net:
    """Parameters of the network; ``labels`` in alphabetical order."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, for each place of its filters: 256 rows of responses."""
        return [[(self.embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]


def windows(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``size`` bytes, bytes in each); the last is filled up with zero bytes."""
    n = max(1, -(-len(data) // size))
    raw = np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)
    lens = np.full(n, size)
    lens[-1] = len(data) - (n - 1) * size
    return raw, np.maximum(lens, 1)


def train(pieces: list[bytes], langs: list[str], seed: int = 7) -> Net | None:
    """A network for the languages in ``langs`` from windows (``pieces``, WINDOW bytes at most); None if there are none."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    rows = [windows(t[:WINDOW], WINDOW)[0][0] for t in pieces]
    ys = [labels.index(lang) for lang in langs]
    x, y = np.array(rows), np.array(ys)
    c, f = len(labels), FILTERS
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "o": rng.normal(0, 0.2, (f * len(WIDTHS), c)), "ob": np.zeros(c)}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, f)), np.zeros(f)
    moment, spread, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    share = np.bincount(y, minlength=c)
    weight = len(y) / (c * np.maximum(share, 1))
    for _ in range(EPOCHS if c > 1 else 0):
        order = rng.permutation(len(x))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            xb, yb = x[pick], y[pick]
            n, length = xb.shape
            emb = p["e"][xb]
            pooled, where, cols = [], [], []
            for w in WIDTHS:
                col = np.concatenate([emb[:, k : length - w + 1 + k] for k in range(w)], axis=2)
                z = col @ p[f"f{w}"].reshape(w * EMBED, f) + p[f"b{w}"]
                at = z.argmax(1)
                pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
                where.append(at)
                cols.append(col)
            h = np.concatenate(pooled, 1)
            a = np.maximum(h, 0)
            logit = a @ p["o"] + p["ob"]
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            d = prob.copy()
            d[np.arange(n), yb] -= 1
            d *= (weight[yb] / n)[:, None]
            grad = {"o": a.T @ d, "ob": d.sum(0), "e": np.zeros_like(p["e"])}
            dh = (d @ p["o"].T) * (h > 0)
            for q, w in enumerate(WIDTHS):
                g = dh[:, q * f : (q + 1) * f]
                best = cols[q][np.arange(n)[:, None], where[q]]  # (n, f, w * EMBED): what each filter saw at its best place
                grad[f"b{w}"] = g.sum(0)
                grad[f"f{w}"] = np.einsum("nf,nfd->df", g, best).reshape(w, EMBED, f)
                back = g[:, :, None, None] * p[f"f{w}"].transpose(2, 0, 1)[None]
                for k in range(w):
                    np.add.at(grad["e"], xb[np.arange(n)[:, None], where[q] + k], back[:, :, k])
            step += 1
            for k in p:
                moment[k] = 0.9 * moment[k] + 0.1 * grad[k]
                spread[k] = 0.999 * spread[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    return Net(labels, p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], p["ob"])


class Scorer:
    """Log probabilities of windows, in batches, by table rows."""

    def __init__(self, net: Net):
        self.net, self.tables = net, net.tables()
        self.bias = np.concatenate(net.bias).astype(np.float32)

    def windows(self, raw: np.ndarray) -> np.ndarray:
        out = np.empty((len(raw), len(self.net.labels)))
        for s in range(0, len(raw), 64):
            x = raw[s : s + 64]
            pooled = []
            for tables in self.tables:
                w = len(tables)
                z = tables[0][x[:, : x.shape[1] - w + 1]]
                for k in range(1, w):
                    z += tables[k][x[:, k : x.shape[1] - w + 1 + k]]
                pooled.append(z.max(1))
            a = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            logit = a @ self.net.out + self.net.out_bias
            logit -= logit.max(1, keepdims=True)
            out[s : s + 64] = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, probability) of each whole text."""
        parts, owner, size = [], [], []
        good = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        for k, t in enumerate(texts):
            if good[k]:
                raw, lens = windows(t.encode(), WINDOW)
                parts.append(raw)
                owner.append(np.full(len(raw), k))
                size.append(lens)
        if not parts:
            return [("und", 0.0)] * len(texts)
        logs = self.windows(np.concatenate(parts))
        who, lens = np.concatenate(owner), np.concatenate(size)
        total, mass = np.zeros((len(texts), len(self.net.labels))), np.zeros(len(texts))
        np.add.at(total, who, logs * lens[:, None])
        np.add.at(mass, who, lens)
        out = []
        for k, ok in enumerate(good):
            if not ok:
                out.append(("und", 0.0))
                continue
            mean = total[k] / mass[k]
            prob = np.exp(mean - mean.max())
            prob /= prob.sum()
            best = int(prob.argmax())
            out.append((self.net.labels[best], float(prob[best])))
        return out


def sample(labelled: DataFrame, per_lang: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """Windows, ``PER_TEXT`` at most of each, of at most ``per_lang`` distinct texts of each language, those of least hash.

    Ranks go to distinct hashes, whatever the number of copies and empty texts: every language gets
    min(``per_lang``, its distinct texts). Only hashes are ranked; the second pass takes the texts up to the last rank's
    hash, cuts their windows at places chosen by hash over their whole length, and copies of a text become one row before anything is gathered.
    """
    hashed = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    ranks = hashed.select("lang", "h").distinct().withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= per_lang)
    last = {r["lang"]: r["h"] for r in ranks.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return [], []
    edges = F.create_map(*(F.lit(x) for pair in sorted(last.items()) for x in pair))
    few = hashed.filter(F.col("h") <= F.element_at(edges, F.col("lang")))
    data = F.encode("text", "utf-8")
    # whole windows only, where a text has one
    n = F.greatest(F.lit(1), F.floor(F.octet_length("text") / WINDOW)).cast("int")
    at = F.array_distinct(F.array(*(F.pmod(F.xxhash64("h", F.lit(k)), n).cast("int") for k in range(PER_TEXT))))
    pieces = F.transform(at, lambda k: F.substring(data, k * WINDOW + 1, F.lit(WINDOW)))
    best = few.select("lang", "h", pieces.alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces")).orderBy("lang", "h").collect()
    return [bytes(p) for r in best for p in r["pieces"]], [r["lang"] for r in best for _ in r["pieces"]]


OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """Language and probability of every whole text of ``docs`` (doc_id, held_out, text)."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            got: list[tuple[str, float]] = []
            texts = batch.column(2)
            for s in range(0, len(texts), 64):
                part = texts.slice(s, 64).to_pylist()
                got += scorer.texts(part) if scorer else [("und", 0.0)] * len(part)
            arrays = [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, OUT)


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """Train on the documents outside the held fold, predict all of them (doc_id, text, lang)."""
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_fold, F.lit(False))
    net = train(*sample(docs.filter(~held).select("text", "lang")))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), net)
