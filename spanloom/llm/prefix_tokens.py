"""Token counts by prefix dynamic programming (SentencePiece BPE).

The program stores the exact token count of every prefix of a text. Its recurrence is ``count[i] = count[i - len(t)] + 1``
where ``t`` is the one piece that ends at ``i`` and stays apart from the last piece of the
prefix before it: a sequence of pieces is an encoding exactly when each pair of
neighbours is one. Pieces are few and short, so a place costs a few look-ups.

No piece of the vocabulary holds the blank mark after another character, so no
merge crosses the place where a run of blanks begins: the count of a prefix is the
count at the last such place, plus the count of the rest, a prefix of one *word*
(a run of blanks and the characters up to the next blank). So the table is stored in two levels:

* for each text, the running count at every word start (``PrefixCounts.cum``), and
* for each distinct word, the counts of all its prefixes, made once by the recurrence and kept in a memo.

A text's number of tokens is the table's last entry; truncation ("the longest prefix within a budget") and counting ("how
many tokens has text[:i]") are look-ups and bisections. The text is never encoded, by this or any library; the
library gives the vocabulary and, in tests, the counts to match.

Edge cases: a null text is an empty one; it has 0 tokens and is under any limit. A very long text is counted whole, one
without any blank as one word, in time and memory in proportion to it; memos are bounded by bytes. Repeated rows give repeated results, and
nothing is ranked, so there are no ties. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import slices

#: Bytes of words and tables in each of a worker's two memos, pairs in another one, and characters of a word that is kept (results do not depend on them).
MEMO, PAIRS, LONGEST = 80_000_000, 200_000, 60
MARK = "\u2581"


class Pieces:
    """Prefix tables for words of one SentencePiece BPE model, with bounded memos."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in usable}
        self.model = m
        self.longest = max(map(len, self.score))
        #: Pieces of several characters that merging makes of their own text.
        self.solid = {t for t in self.score if len(t) > 1 and self._merge(t) == [t]}
        #: Lengths of the solid pieces that end in two characters, the longest first.
        self.ending: dict[str, list[int]] = {}
        for t in sorted(self.solid, key=len, reverse=True):
            found = self.ending.setdefault(t[-2:], [])
            if not found or found[-1] != len(t):
                found.append(len(t))
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.alone: dict[tuple[str, str], bool] = {}

    def _size(self, s: str) -> int:
        """Tokens of a single symbol: 1, or its bytes where the vocabulary lacks it."""
        return 1 if s in self.score else len(s.encode())

    def _apart(self, left: str, right: str) -> bool:
        """Whether the pieces, side by side, are what the model makes of their text."""
        got = self.alone.get((left, right))
        if got is None:
            if len(self.alone) > PAIRS:
                self.alone.clear()
            got = self.alone[left, right] = self._merge(left + right) == [left, right]
        return got

    def _merge(self, s: str) -> list[str]:
        """The pieces of a short string, by merging the best-scored pair until none is left."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def prefixes(self, key: str) -> bytes | array:
        """Counts of every prefix of the word that ``key`` makes with a blank before it; the empty one first."""
        got = self.table.get(key)
        if got is not None:
            return got
        got = self.older.get(key)
        if got is not None:
            return self._keep(key, got)
        word = MARK + key.replace(" ", MARK)
        solid, ending, alone, apart = self.solid, self.ending, self.alone, self._apart
        count, last = [0], [""]
        for i in range(1, len(word) + 1):
            for size in ending.get(word[i - 2 : i], ()) if i > 1 else ():
                j = i - size
                if j < 0:
                    continue
                t = word[j:i]
                if t in solid:
                    good = not j or alone.get((last[j], t))
                    if good or good is None and apart(last[j], t):
                        count.append(count[j] + 1)
                        break
            else:  # a single symbol
                t = word[i - 1]
                count.append(count[i - 1] + self._size(t))
            last.append(t)
        if len(key) > LONGEST:
            return array("l", count)
        return self._keep(key, bytes(count))  # a byte a prefix: such a word has at most four tokens a character

    def _keep(self, key: str, table: bytes) -> bytes:
        """Keeps a table. A full memo becomes the older one, whose words come back when they are asked for, and the one before it goes."""
        if self.held > MEMO:
            self.older, self.table, self.held = self.table, {}, 0
        self.held += len(table) + len(key) + 190
        self.table[key] = table
        return table


def blank_runs(text: str) -> list[str]:
    """``text`` cut where a run of blanks begins."""
    words = text.replace("▁", " ").split(" ")
    if "" not in words:
        return [words[0], *(" " + w for w in words[1:])]
    runs: list[str] = []
    blanks = ""
    for k, w in enumerate(words):
        blanks += " " * bool(k)
        if w:
            runs.append(blanks + w)
            blanks = ""
    return [*runs, blanks] if blanks else runs


class PrefixCounts:
    """Token counts at all prefixes of one text."""

    def __init__(self, pieces: Pieces, text: str | None):
        self.pieces = pieces
        self.runs = blank_runs(text) if text else []
        # the model writes a blank of its own before the text: every word is a key with a blank before it
        self.keys = [self.runs[0], *(r[1:] for r in self.runs[1:])] if self.runs else []
        table, get = pieces.table, pieces.prefixes
        self.cum = [0, *accumulate([(table.get(k) or get(k))[-1] for k in self.keys])]
        self.starts = None

    def _starts(self) -> list[int]:
        if self.starts is None:
            self.starts = [0, *accumulate(map(len, self.runs))]
        return self.starts

    @property
    def total(self) -> int:
        return self.cum[-1]

    def at(self, i: int) -> int:
        """Tokens of text[:i]."""
        if i <= 0 or not self.runs:
            return 0
        starts = self._starts()
        k = bisect_right(starts, i) - 1
        if k >= len(self.runs) or starts[k] == i:
            return self.cum[min(k, len(self.runs))]
        return self.cum[k] + self.pieces.prefixes(self.keys[k])[i - starts[k] + (k == 0)]

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens that ends in or before the first word to pass the budget."""
        k = bisect_right(self.cum, budget) - 1
        starts = self._starts()
        if k >= len(self.runs):
            return starts[-1]
        inside = self.pieces.prefixes(self.keys[k])[1 if k == 0 else 0 :]
        return starts[k] + max(i for i in range(len(inside) - 1) if i == 0 or self.cum[k] + inside[i] <= budget)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Counts of every whole text of ``docs`` (doc_id, text), and how many code points fit in ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            done = [PrefixCounts(p, x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array([x.total for x in done], pa.int64()),
                    pa.array([x.total > limit for x in done], pa.bool_()),
                    pa.array([x.fit(limit) if x.total > limit else len(t) for x, t in zip(done, texts, strict=True)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)
