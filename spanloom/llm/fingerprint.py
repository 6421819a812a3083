"""Quartile bucket digests of documents.

Every window of twelve bytes of a text gives six triplets; each is hashed into one of
``BUCKETS`` counters. A digest holds the length (its logarithm), the quartiles of the counts
relative to the third one, and for each bucket the quarter of the counts that its own
lies in (two bits). Digests of similar texts differ in few buckets, whatever the
positions. ``likeness`` turns the sum of bounded differences into a number from 0 to 1.

Edge cases: a null text is an empty one. Texts shorter than a window are
counted as if followed by zero bytes. Equal texts have equal digests and a likeness of 1. With
one document only, the next document is the document itself. Documents are ordered by
descending doc_id, null ids last, rows that share an id by their text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, slices

#: Counters of a digest (a power of two) and what a bucket, a quartile ratio and a step of length may add to a difference at most.
BUCKETS = 512
BUCKET_MOST, RATIO_MOST, LENGTH_MOST = 6, 12, 48
#: Bytes of a window, and the triplets taken from it: wide ones tell words apart, where narrow ones only tell languages.
WINDOW = 12
TRIPLETS = ((0, 4, 9), (0, 5, 11), (0, 3, 10), (0, 6, 11), (0, 5, 10), (0, 7, 11))
_MIX = tuple(np.uint32((0x9E3779B1 * (2 * k + 1)) & 0xFFFFFFFF) for k in range(len(TRIPLETS)))
_SHIFT = np.uint32(32 - int(math.log2(BUCKETS)))
#: A difference at which likeness is 0.
BOUND = BUCKETS * 2 + RATIO_MOST * 2 + LENGTH_MOST


def counts(data: bytes) -> np.ndarray:
    """Bucket counts of all triplets of a text's bytes."""
    if not data:
        return np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8).astype(np.uint32)
    n = len(raw) - WINDOW + 1
    total = np.zeros(BUCKETS, np.int64)
    for (a, b, c), mix in zip(TRIPLETS, _MIX, strict=True):
        h = raw[a : a + n] | raw[b : b + n] << np.uint32(8) | raw[c : c + n] << np.uint32(16)
        h = (h ^ h >> np.uint32(11)) * mix
        total += np.bincount(h >> _SHIFT, minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """Hex digest: length, two quartile ratios, then two bits a bucket."""
    c = counts(data)
    q1, q2, q3 = np.partition(c, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    size = min(255, int(12 * math.log2(len(data) + 1)))
    ratios = [int(100 * q // q3) % 256 if q3 else 0 for q in (q1, q2)]
    return f"{size:02x}{ratios[0]:02x}{ratios[1]:02x}" + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Sum of the bounded differences of two digests."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8).astype(np.int16) for s in (a, b))
    head = min(LENGTH_MOST, int(abs(x[0] - y[0]))) + sum(min(RATIO_MOST, int(abs(x[k] - y[k])) // 4) for k in (1, 2))
    total = 0
    for shift in (0, 2, 4, 6):
        d = np.abs((x[3:] >> shift & 3) - (y[3:] >> shift & 3))
        total += int(d.sum()) + (BUCKET_MOST - 3) * int((d == 3).sum())
    return head + total


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling with their difference to 0 at ``BOUND``."""
    return 1.0 if a == b else max(0.0, 1 - difference(a, b) / BOUND)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of the one that follows it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following).encode()
    new_mark = digest(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (range, guest, descending id): each with the row after it; a range ends with a guest, the first row of the next."""
    held = None
    for batch in slices(batches):
        rows = []
        for reach, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mark = None
            if held and held[0] == reach:
                mark = digest(text.encode())
                rows.append(_row(held[1], held[2], held[3], text, mark))
            held = None if guest else (reach, doc_id, text, mark or digest(text.encode()))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of every whole text of ``docs`` (doc_id, text), of its edited text, and their likeness.

    Ranges of ids are dealt to tasks, each sorted; what a range needs of the next one is
    a single row, sent along as its guest. Only the ranges' greatest ids, one a range,
    pass through the driver.
    """
    low = -(2**63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"))
    n = partitions(docs.sparkSession)
    cuts = ids.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10000)).first()[0] if n > 1 else None
    splits = sorted({float(c) for c in cuts or ()})
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def ranged(df: DataFrame) -> DataFrame:
        if not splits:
            return df.withColumn("reach", F.lit(0))
        out = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="point", outputCol="place").transform(df.withColumn("point", F.col("key").cast("double")))
        return out.withColumn("reach", F.lit(len(splits)) - F.col("place").cast("int")).drop("point", "place")

    heads = sorted((r["reach"], r["key"]) for r in ranged(ids).groupBy("reach").agg(F.max("key").alias("key")).collect())
    if not heads:
        return docs.sparkSession.createDataFrame([], OUT)
    # the first row of each range is the guest of the range before it, that of the first range the guest of the last
    guest_of = {key: heads[(k - 1) % len(heads)][0] for k, (_, key) in enumerate(heads)}
    firsts = docs.sparkSession.createDataFrame([(k, r) for k, r in guest_of.items()], "key long, reach int")
    own = ranged(rows).select("reach", F.lit(False).alias("guest"), "doc_id", "text", "key")
    guests = rows.filter(F.col("key").isin(list(guest_of))).join(F.broadcast(firsts), "key").select("reach", F.lit(True).alias("guest"), "doc_id", "text", "key")
    dealt = own.unionByName(guests).repartitionById(len(heads), F.col("reach"))
    ordered = dealt.sortWithinPartitions("reach", "guest", F.col("key").desc(), F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("reach", "guest", "doc_id", "text").mapInArrow(_stream, OUT)
