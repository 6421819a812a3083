"""Exact BPE by content-defined chunk reuse.

A rolling hash cuts each text into chunks whose borders depend on nearby bytes
only, so passages shared by documents give the same chunks wherever they stand.

1. ``chunk_table``: chunk digests of every document, small rows without text.
2. ``shared``: digests seen more than once, each with one home (document, place).
3. The homes' chunks are encoded once, where they are read, and joined to all that hold them.
4. ``assemble``: each document takes its shared chunks' tokens, encodes the rest,
   and *repairs* every chunk border: the text between the last safe place before
   the border and the first after it is encoded again, widened by one safe place to
   each side; the widened parts must agree with the tokens already there, or the
   window widens further (to the whole text, if need be).

A safe place is one where a blank follows a printable ASCII character other than a
blank: no pattern of the pre-tokenizer holds a blank after another character, so
one of its pieces ends there in every context, and tokens to the left and right do
not depend on each other.

Special strings inside a text cut it first, as the tokenizers library does; the
parts between them are encoded on their own. Encoding uses the vocabulary's merge
ranks (taken from the same file), which gives the library's ids.

Edge cases: a null text is an empty one (no tokens, digests of the empty string);
repeated rows give repeated results; a null doc_id is carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bits import Bits
from spanloom.llm.common import cut, hot_keys, join_spread, partitions, slices

#: Chunk sizes in bytes: no border before LEAST, one at MOST at the latest, one in 2**BITS places on average.
LEAST, MOST, BITS = 96, 4096, 9
_WINDOW = 32

#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()
_SAFE_LEFT = np.zeros(256, bool)
_SAFE_LEFT[33:127] = True


def borders(data: bytes) -> list[int]:
    """Chunk borders of a text's bytes, 0 and its length included; none inside a character."""
    n = len(data)
    if n <= 2 * LEAST:
        return [0, n] if n else [0]
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    width = 1
    while width < _WINDOW:  # h[i] becomes the sum of gear[byte i-k] << k, by doubling
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
        width *= 2
    cuts = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    out, last = [0], 0
    for c in [*cuts.tolist(), n]:
        while c - last > MOST:
            last += MOST
            while last < n and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if c - last >= LEAST and c < n:
            while c < n and data[c] & 0xC0 == 0x80:
                c += 1
            if c < n:
                out.append(c)
                last = c
    return [*out, n] if out[-1] < n else out


class Coder:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.bytes_of: dict[int, bytes] = {v: bytes(byte_of[c] for c in k) for k, v in ids.items()}
        ranks = {b: i for i, b in self.bytes_of.items()}
        self.core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        size = max(self.bytes_of) + 1
        self.width = np.zeros(size, np.int64)
        for i, b in self.bytes_of.items():
            self.width[i] = len(b)
        self.name = [str(i) for i in range(size)]
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def plain(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def direct(self, text: str) -> list[int]:
        """Ids of a whole text without any reuse."""
        if not (self.splitter and self.splitter.search(text)):
            return self.plain(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [*self.plain(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def assemble(self, data: bytes, edges: list[int], known: dict[int, np.ndarray]) -> list[int]:
        """Ids of a text's bytes from the ids of its shared chunks (``known``, by chunk number), with repaired borders."""
        raw = np.frombuffer(data, np.uint8)
        safe = np.flatnonzero(_SAFE_LEFT[raw[:-1]] & (raw[1:] == 32)) + 1
        out: list[int] = []
        at, ids, ends = 0, None, None  # the open part: from a true border of tokens on; ids None: not encoded yet
        for a, b, fresh in self._parts(data, edges, known):
            fresh_ends = np.concatenate(([0], np.cumsum(self.width[fresh]))) + a
            if not a:
                ids, ends = fresh, fresh_ends
                continue
            mid = int(np.searchsorted(safe, a, "right"))  # safe[mid] is the first safe place after the border
            step = 1
            while True:
                if mid + step >= len(safe) or safe[mid + step] >= b:
                    ids = None  # nothing to agree with on the right: this part joins the open one
                    break
                inner_r, right = int(safe[mid + step - 1]), int(safe[mid + step])
                narrow = ids is None or mid - 1 - step < 0 or safe[mid - 1 - step] <= at
                left, inner_l = (at, at) if narrow else (int(safe[mid - 1 - step]), int(safe[mid - step]))
                again = np.asarray(self.plain(data[left:right].decode()), np.int64)
                span = np.concatenate(([0], np.cumsum(self.width[again]))) + left
                i, j = np.searchsorted(fresh_ends, (inner_r, right))
                agreed = np.array_equal(fresh[i:j], again[np.searchsorted(span, inner_r) :])
                if agreed and not narrow:
                    k, m = np.searchsorted(ends, (left, inner_l))
                    agreed = np.array_equal(ids[k:m], again[: np.searchsorted(span, inner_l)])
                if agreed:
                    if not narrow:
                        out += ids[np.searchsorted(ends, at) : k].tolist()
                    out += again.tolist()
                    at, ids, ends = right, fresh, fresh_ends
                    break
                step *= 2
        return out + (self.plain(data[at:].decode()) if ids is None else ids[np.searchsorted(ends, at) :].tolist())

    def _parts(self, data: bytes, edges: list[int], known: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, ids): each shared chunk, and each run of chunks that no other text has, as one."""
        k, m = 0, len(edges) - 1
        while k < m:
            j = k + 1
            if k in known:
                yield edges[k], edges[j], known[k]
            else:
                while j < m and j not in known:
                    j += 1
                yield edges[k], edges[j], np.asarray(self.plain(data[edges[k] : edges[j]].decode()), np.int64)
            k = j

    def encode(self, text: str, known: dict[int, np.ndarray]) -> list[int]:
        """Ids of a whole text; chunks are reused where it has any and no special string cuts it."""
        if not known or self.splitter and self.splitter.search(text):
            return self.direct(text)
        data = text.encode()
        return self.assemble(data, borders(data), known)


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _digests(data: bytes, edges: list[int]) -> list[bytes]:
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(edges, edges[1:], strict=False)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, version): key and version tell texts apart, whatever ids are null or repeated."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.withColumn("key", F.coalesce("doc_id", F.lit(-1))).withColumn("version", F.xxhash64("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, version, packed): texts compressed one by one, for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            packed = pa.array([squeeze(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["doc_id", "key", "version", "packed"])

    return keyed.select("doc_id", "key", "version", "text").mapInArrow(run, "doc_id long, key long, version long, packed binary")


def _unpacked(column) -> Iterator[str]:
    expand = zstandard.ZstdDecompressor().decompress
    for x in column:
        yield expand(x.as_py()).decode()


def chunk_table(keyed: DataFrame) -> DataFrame:
    """Digest, document and place of every chunk of documents that have more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            origin, place, digests = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                data = text.encode()
                edges = borders(data)
                if len(edges) > 2:
                    found = _digests(data, edges)
                    digests += found
                    place += range(len(found))
                    origin += [r] * len(found)
            take = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(place, pa.int32()), pa.array(digests, pa.binary())],
                names=["key", "version", "place", "digest"],
            )

    return keyed.select("key", "text", "version").mapInArrow(run, "key long, version long, place int, digest binary")


def _encode_homes(path: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, homes = coder(path), held.value
        for batch in slices(batches):
            digests, codes = [], []
            for key, version, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode()
                edges = borders(data)
                n = len(edges) - 1
                if n < 2:
                    continue
                for k in np.flatnonzero(homes.holds(np.full(n, key), version ^ np.arange(n))).tolist():
                    part = data[edges[k] : edges[k + 1]]
                    digests.append(hashlib.blake2b(part, digest_size=16).digest())
                    codes.append(np.asarray(c.plain(part.decode()), np.uint16 if len(c.width) <= 65536 else np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(codes, pa.binary())], names=["digest", "codes"])

    return run


def _encode_texts(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        kind = np.uint16 if len(c.width) <= 65536 else np.int32
        for batch in slices(batches):
            rows = []
            for text, shared in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                known = {x["place"]: np.frombuffer(x["codes"], kind).astype(np.int64) for x in shared or ()}
                ids = c.encode(text, known)
                said = ",".join([c.name[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), ids))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            out = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): n_tokens, digests of its ids and of the text decoded from them; ``with_ids`` adds ids."""
    keyed = _keyed(docs)
    chunks = cut(chunk_table(keyed))
    shared = cut(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "version", "place")).alias("home")).filter("n > 1").select("digest", "n", "home.*"))
    held = docs.sparkSession.sparkContext.broadcast(Bits.of(shared.select("key", F.col("version").bitwiseXOR(F.col("place").cast("long")).alias("at"))))
    # homes are found and encoded where their documents are read: their texts do not move
    codes = keyed.select("key", "version", "text").mapInArrow(_encode_homes(path, held), "digest binary, codes binary")
    codes = codes.join(shared.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    # the one exchange of the texts, compressed
    dealt = _packed(keyed).repartition(partitions(docs.sparkSession), "key", "version")
    # a chunk that very many documents hold is joined by broadcast: 4,000 of them at most, of 8 kB at most
    often = hot_keys(shared, "digest", "n", chunks.count())
    owned = join_spread(chunks, codes, "digest", often).filter("codes IS NOT NULL").groupBy("key", "version").agg(F.collect_list(F.struct("place", "codes")).alias("shared"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return dealt.join(owned, ["key", "version"], "left").select("doc_id", "packed", "shared").mapInArrow(_encode_texts(path, with_ids), schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` (doc_id, ids) with the text that the ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", text])

    return tokens.select("doc_id", ids).mapInArrow(run, f"doc_id long, {text} string")
