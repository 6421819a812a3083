"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

1. ``features``: every whole text becomes its set of hashed word shingles (64 bits), a digest
   of that set, and band keys of its MinHash signature. Only these leave the task.
2. Documents with equal sets form a *class*; one document's set stands for all.
3. Classes that share a band key are candidates. Small *families* (classes connected by shared bands, ``FAMILY`` at most)
   are compared whole, each in one task, so that no set is sent twice.
4. Larger families are worked through bucket by bucket. First every member of a bucket is compared with the bucket's *hub*,
   its least class: as many pairs as members. Links found join classes to components. Only a bucket
   whose members are then in several components is *open*: its *strangers*, all but those of the largest component, are compared with
   all other members, in blocks, leaving out pairs of one component. So a family of near copies costs its
   members, and a chain its neighbours; no family is compared pair by pair.
5. A comparison goes through the signatures batch by batch: with m of n values equal, the posterior that the similarity
   reaches the threshold (uniform prior) is P(Bin(n + 1, t) <= m); a pair whose posterior falls below
   ``miss`` is dropped. Survivors are verified on the full sets, in integers. A block sends on
   a spanning forest of its links: no more rows than it has classes, and the same components.
6. Connected components of the links, then back to all documents through their classes.

A pair at the threshold shares no band with probability ``BAND_MISS`` at most. Every pair that shares one is compared, unless links found
before have joined it already.

Words are runs of bytes other than ASCII blanks, with A-Z lower-cased. A text of fewer words than a
shingle is one shingle. Sets are of 64-bit hashes: two shingles of one comparison are taken for equal with a probability of about 2**-64 a pair.

Edge cases: texts that are null or without words have an empty set and are linked with nothing; rows
without doc_id are linked with nothing either (component null, kept). For ``assign``, rows that share a doc_id are
one document: links of any are links of all, and each row tells its own set's size. ``keep_one`` works on texts instead: rows that share an id stay
apart if their texts do. Repeated rows give repeated results in ``assign`` and one row in ``keep_one``. Very long texts are
shingled whole. Ties of a representative go to the least id, then the least hash of the text. An empty table gives an empty result. Other columns, whatever their names,
are not read by ``assign`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bits import Bits
from spanloom.llm.common import cut, hot_keys, join_spread, slices
from spanloom.llm.components import components

#: Chance that a pair at the threshold shares no band; rows of a block; classes of a family compared whole; signature values of a batch.
BAND_MISS, BLOCK, FAMILY, BATCH = 1e-5, 256, 512, 30
#: Bytes of words in a worker's memo, and of one that is kept there.
MEMO, LONGEST = 16_000_000, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Columns that ``keep_one`` adds for its joins.
ID, HASH = "__neardup_id", "__neardup_hash"


class _Words(dict):
    """Hashes of words, in a memo bounded by bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if self.held > MEMO:
                self.clear()
                self.held = 0
            self.held += len(word) + 150
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``n`` words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _ODD + h[k : len(h) - size + 1 + k]
    return np.unique(_mixed(out))


class Signer:
    """Signatures of ``bands * rows`` values and their band keys."""

    def __init__(self, percent: int, rows: int):
        self.rows = rows
        self.bands = math.ceil(math.log(BAND_MISS) / math.log(1 - (percent / 100) ** rows))
        size = self.bands * rows
        seeds = _mixed(np.arange(1, 2 * size + 1, dtype=np.uint64) * _ODD)
        self.a = seeds[:size].astype(np.uint32) | np.uint32(1)
        self.b = (seeds[size:] >> np.uint64(32)).astype(np.uint32)
        self.place = _mixed(np.arange(11, rows + 11, dtype=np.uint64)) | np.uint64(1)
        self.salt = _mixed(np.arange(1000, self.bands + 1000, dtype=np.uint64))

    def signature(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        short = (found >> np.uint64(32)).astype(np.uint32)[:, None]
        for k in range(0, len(short), 2048):
            np.minimum(out, (short[k : k + 2048] * self.a + self.b).min(0), out=out)
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        table = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return _mixed((table * self.place).sum(1, dtype=np.uint64) ^ self.salt).view(np.int64)


def least_matches(n: int, percent: int, miss: float) -> int:
    """The least m for which P(Bin(n + 1, t) <= m) reaches ``miss``."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


FEATURES = "doc_id long, h long, n_shingles long, kind binary, bands array<long>"


def features(docs: DataFrame, n: int, signer: Signer) -> DataFrame:
    """Hash of the text (h), set size, set digest and band keys of every document; digest and keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, kinds, bands = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                kinds.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(signer.keys(signer.signature(s)) if len(s) else None)
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(kinds, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n_shingles", "kind", "bands"])

    return _named(docs).mapInArrow(run, FEATURES)


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): what names a row, and its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def _survivors(x: np.ndarray, y: np.ndarray, percent: int, miss: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that no batch of signature values could rule out."""
    width = x.shape[1]
    got = np.zeros((len(x), len(y)), np.int16)
    for k in range(min(BATCH, width)):
        got += x[:, k][:, None] == y[:, k][None, :]
    alive = got >= least_matches(min(BATCH, width), percent, miss)
    i, j = np.nonzero(np.triu(alive, 1) if same else alive)
    m = got[i, j].astype(np.int32)
    for k in range(BATCH, width, BATCH):
        stop = min(k + BATCH, width)
        step = max(1, 2**21 // (stop - k))
        for c in range(0, len(i), step):
            m[c : c + step] += (x[i[c : c + step], k:stop] == y[j[c : c + step], k:stop]).sum(1)
        keep = m >= least_matches(stop, percent, miss)
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets xs[i], ys[j]."""
    if len(i) < 256:
        return np.array([len(np.intersect1d(xs[a], ys[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    one, two = np.concatenate([xs[r] for r in rows]), np.concatenate([ys[c] for c in cols])
    common = np.intersect1d(one, two)
    total = np.zeros((len(rows), len(cols)), np.float64)

    def places(sets: np.ndarray, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, sets)
        at[at == len(common)] = 0
        hit = common[at] == sets if len(common) else np.zeros(len(sets), bool)
        return np.repeat(np.arange(len(lens)), lens)[hit], at[hit]

    r1, c1 = places(one, [len(xs[r]) for r in rows])
    r2, c2 = places(two, [len(ys[c]) for c in cols])
    for k in range(0, len(common), 4096):  # shared shingles as 0/1 columns, multiplied by slices
        m1, m2 = (c1 >= k) & (c1 < k + 4096), (c2 >= k) & (c2 < k + 4096)
        a, b = (np.zeros((n, min(4096, len(common) - k)), np.float32) for n in (len(rows), len(cols)))
        a[r1[m1], c1[m1] - k] = 1
        b[r2[m2], c2[m2] - k] = 1
        total += a @ b.T
    return total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that join what earlier ones have not joined."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    out = []
    for a, b in pairs:
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(percent: int, miss: float, width: int):
    """Links between the rows of a group: those of side 0 with those of side 1, and side 2 with itself and with side 1; never within one component."""

    def run(key, group):
        node, comp, side = (group[c].to_numpy() for c in ("node", "comp", "side"))
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in group["found"]]
        signs = np.frombuffer(b"".join(s.as_py() for s in group["sign"]), np.uint32).reshape(-1, width)
        size = np.array([len(s) for s in sets])
        links: list[tuple[int, int]] = []
        for left, right, same in ((0, 1, False), (2, 2, True)):
            one, two = np.flatnonzero(side == left), np.flatnonzero(side == right)
            for k in range(0, len(one), BLOCK):
                for m in range(k if same else 0, len(two), BLOCK):
                    r, c = one[k : k + BLOCK], two[m : m + BLOCK]
                    a, b = _survivors(signs[r], signs[c], percent, miss, same and k == m)
                    fits = (comp[r][a] != comp[c][b]) & (100 * np.minimum(size[r][a], size[c][b]) >= percent * np.maximum(size[r][a], size[c][b]))
                    a, b = a[fits], b[fits]
                    both = _overlaps([sets[x] for x in r], [sets[x] for x in c], a, b)
                    good = 100 * both >= percent * (size[r][a] + size[c][b] - both)
                    links += zip(node[r][a[good]].tolist(), node[c][b[good]].tolist(), strict=True)
        links = _forest(iter(links))
        cols = list(zip(*links, strict=True)) if links else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def _members(n: int, signer: Signer, wanted):
    """Signature and set of each document that stands for a class (and of the few that the filter takes for one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hit = wanted.value.holds(batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy())
            kinds, found, sign = [], [], []
            for k in np.flatnonzero(hit).tolist():
                s = shingles(batch.column(2)[k].as_py(), n)
                if len(s):
                    found.append(s.tobytes())
                    kinds.append(hashlib.blake2b(found[-1], digest_size=16).digest())
                    sign.append(signer.signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (kinds, found, sign)], names=["kind", "found", "sign"])

    return run


def classes_of(seen: DataFrame) -> DataFrame:
    """(kind, node, n, best, bands): classes of equal sets under a number of their own, with their rows and the least (doc_id, h) of them."""
    rows = seen.filter("kind IS NOT NULL AND doc_id IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h")).alias("best"), F.first("bands").alias("bands"))
    return cut(rows.withColumn("node", F.monotonically_increasing_id()))


def linked(docs: DataFrame, classes: DataFrame, n: int, percent: int, signer: Signer, miss: float) -> DataFrame:
    """(a, b): links between classes that join the same classes as all links between classes that share a band."""
    spark, width = docs.sparkSession, signer.bands * signer.rows
    compare = _compare(percent, miss, width)
    banded = classes.select("node", F.explode("bands").alias("band"))
    sizes = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).filter("size > 1"))
    met = join_spread(banded, sizes, "band", hot_keys(sizes, "band", "size", signer.bands * classes.count())).filter("hub IS NOT NULL")
    met = cut(met.select("band", "node", "hub"))
    families = components(met.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    per_family = cut(families.groupBy("root").agg(F.count(F.lit(1)).alias("members")))
    sized = join_spread(families, per_family, "root", hot_keys(per_family, "root", "members", families.count()))
    ours = cut(classes.drop("bands").join(sized.hint("merge"), "node"))
    # the sets of the documents that stand for these classes are made again where the documents are read: no other text moves.
    # They get their family on the way, so that each is sent once more, to its family, and only large ones beyond that
    held = spark.sparkContext.broadcast(Bits.of(ours.select(F.col("best.doc_id").alias("doc_id"), F.col("best.h").alias("h"))))
    made = _named(docs).mapInArrow(_members(n, signer, held), "kind binary, found binary, sign binary").dropDuplicates(["kind"])
    every = cut(made.hint("merge").join(ours.select("kind", "node", "root", "members"), "kind").select("node", "root", "members", "found", "sign"))
    whole = every.filter(F.col("members") <= FAMILY).select("root", "node", F.col("node").alias("comp"), F.lit(2).alias("side"), "found", "sign")
    links = whole.groupBy("root").applyInArrow(compare, "a long, b long")
    if per_family.filter(F.col("members") > FAMILY).isEmpty():
        return cut(links)
    known = every.filter(F.col("members") > FAMILY).select("node", "found", "sign")
    inside = cut(met.join(sized.filter(F.col("members") > FAMILY).select("node").hint("merge"), "node", "left_semi"))
    # every member with its buckets' hubs, a hub's members dealt in blocks
    pairs = cut(inside.filter("node <> hub").select("hub", "node").distinct())
    fans = cut(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / (4 * BLOCK)).cast("int")))
    dealt = join_spread(pairs, fans, "hub", hot_keys(fans, "hub", "n", pairs.count())).select("hub", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    hubs = fans.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    ends = known.join(dealt.hint("merge"), "node").select("hub", "part", "node", F.lit(1).alias("side"), "found", "sign").unionByName(
        known.join(hubs.withColumnRenamed("hub", "node").hint("merge"), "node").select(F.col("node").alias("hub"), "part", "node", F.lit(0).alias("side"), "found", "sign")
    )
    star = cut(ends.withColumn("comp", F.col("node")).groupBy("hub", "part").applyInArrow(compare, "a long, b long"))
    # open buckets: members of several components
    labels = components(star)
    marked = inside.join(labels.withColumnRenamed("root", "comp").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    shares = marked.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    states = shares.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1 AND all > 2")  # a pair was compared already
    open_ = cut(states.select("band", F.col("most.comp").alias("main"), F.col("all"), (F.col("all") - F.col("most.n")).alias("strange")))
    links = cut(links).unionByName(star)
    if open_.isEmpty():
        return links
    kept = join_spread(marked.select("band", "node", "comp"), open_, "band", hot_keys(open_, "band", "all", inside.count())).filter("main IS NOT NULL")
    # strangers in blocks of their own, all members in blocks: every block of strangers meets every block of members
    kept = cut(kept.withColumn("n_s", F.ceil(F.col("strange") / BLOCK).cast("int")).withColumn("n_m", F.ceil((F.col("all") - F.col("strange")) / BLOCK).cast("int")))
    strange, at = F.col("comp") != F.col("main"), F.xxhash64("node", "band")
    own = F.pmod(at, F.when(strange, F.col("n_s")).otherwise(F.col("n_m"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # cells (i, j, kind): stranger block i with main block j, or with stranger block j from i on
    cells = F.when(
        strange,
        F.concat(
            F.transform(every(F.col("n_m")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("sort"), F.lit(0).alias("side"))),
            F.transform(every(F.col("n_s")), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.lit(1).alias("sort"), F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1).alias("side"))),
        ),
    ).otherwise(F.transform(every(F.col("n_s")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(0).alias("sort"), F.lit(1).alias("side"))))
    spread = kept.withColumn("own", own).select("band", "node", "comp", F.explode(cells).alias("c")).select("band", "node", "comp", "c.*")
    rest = known.join(spread.hint("merge"), "node").groupBy("band", "sort", "i", "j").applyInArrow(compare, "a long, b long")
    return links.unionByName(cut(rest))


def assign(docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    signer = Signer(percent, rows)
    seen = cut(features(docs, n, signer))
    classes = classes_of(seen)
    hot = hot_keys(classes, "kind", "n", seen.count())
    links = linked(docs, classes, n, percent, signer, miss)
    # rows that share an id: their classes are linked
    mark = F.xxhash64("kind")
    ids = seen.filter("kind IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    ids = cut(ids.select("doc_id", "n"))
    if not ids.isEmpty():
        often = hot_keys(ids, "doc_id", "n", seen.count())
        held = join_spread(seen.select("doc_id", "kind"), ids, "doc_id", often).filter("n IS NOT NULL AND kind IS NOT NULL").select("doc_id", "kind").distinct()
        held = cut(join_spread(held, classes.select("kind", "node"), "kind", hot).select("doc_id", "node"))
        hubs = held.groupBy("doc_id").agg(F.min("node").alias("hub"))
        links = links.unionByName(join_spread(held, hubs, "doc_id", often).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    roots = components(links)
    named = classes.select("kind", "node", F.col("best.doc_id").alias("least")).join(roots.hint("merge"), "node", "left")
    ids = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("found_id"))
    named = cut(join_spread(named, ids, "root", hot_keys(roots.groupBy("root").count(), "root", "count", roots.count())).select("kind", F.coalesce("found_id", "least").alias("found_id")))
    out = join_spread(seen.drop("bands", "h"), named, "kind", hot).withColumn("component_id", F.coalesce("found_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """``docs``, all its columns, with one row of each group of near-duplicate texts, the one with the least doc_id; rows without doc_id or words stay, repeated ones once."""
    signer = Signer(percent, rows)
    seen = cut(features(docs, n, signer))
    classes = classes_of(seen)
    roots = components(linked(docs, classes, n, percent, signer, miss))
    best = classes.select("node", "best").join(roots.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.*")
    bare = seen.filter("kind IS NULL AND doc_id IS NOT NULL").select("doc_id", "h").distinct()
    keys = cut(best.unionByName(bare))
    named, own = docs.withColumns({ID: F.col("doc_id").cast("long"), HASH: F.xxhash64("text")}), docs.columns
    # what repeats a row very often is thinned out where it is read
    often = seen.filter("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    often = F.broadcast(cut(hot_keys(often.withColumn("row", F.struct("doc_id", "h")), "row", "n", seen.count()).select(F.col("row.doc_id").alias(ID), F.col("row.h").alias(HASH))))
    wanted = keys.toDF(ID, HASH)
    many = named.filter("doc_id IS NOT NULL").join(often, [ID, HASH], "left_anti").join(wanted.hint("merge"), [ID, HASH], "left_semi").dropDuplicates([ID, HASH])
    few = named.join(often, [ID, HASH], "left_semi").dropDuplicates([ID, HASH]).join(wanted.hint("merge"), [ID, HASH], "left_semi")
    return many.select(own).unionByName(few.select(own)).unionByName(docs.filter("doc_id IS NULL"))
