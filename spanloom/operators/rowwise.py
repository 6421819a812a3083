"""Lines, paragraphs and split translations of whole documents in plain Python, for results that hold no spans.

The steps and their results are those of ``lines``, ``paragraphs`` and ``translate``: these are expressions over nested columns, which Spark
interprets, at tens of microseconds a span. What follows only needs a line's text, sizes and place, so a document's spans live in its worker
alone: they are read once, and neither written to rows nor dealt out. Coordinates are numbers; a font may be None.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions import fonts, text
from spanloom.operators.lines import CLUSTER_MOST, MARGIN, TALL_REACH, X_GAP
from spanloom.operators.paragraphs import split
from spanloom.operators.translate import LEXICON
from spanloom.sources import lift
from spanloom.sources.lift import Spans

#: Documents read, and lines given, at once.
DOCS, LINES = 256, 20_000
BLANKS = " \t\n\r\f"
#: A character that makes a line worth translating, a run of leaders, and what stands before it.
SPOKEN, LEADER = re.compile(r"[^ \t\n\r\f0-9.,;:!?()\[\]/*+=-]"), re.compile(text.LEADER)
CONTENT, MARKER = re.compile(f"(?s)^(.*?){text.LEADER}"), re.compile(r"\{M([0-9]+)\}")


@dataclass(slots=True)
class Look:
    """What the fonts of a raw line's spans say: whether each is of text and its style, and whether there is text, mathematics,
    and bold; which spans are no tall symbols, and whether all are tall ones (None: not known)."""

    kinds: tuple[tuple[bool, str], ...]
    has_text: bool
    has_math: bool
    has_bold: bool
    core: tuple[int, ...] | None
    tall: bool | None


@dataclass(slots=True)
class Raw:
    """A raw line: its spans by columns, the look of their fonts, their box and core range of y."""

    spans: Spans
    look: Look
    x0: float
    y0: float
    x1: float
    y1: float
    c0: float
    c1: float


@dataclass(slots=True)
class Line:
    """A line that is translated: what it gives to its paragraph, and what decides on its group."""

    own: str
    n_math: int
    x0: float
    y0: float
    y1: float
    first_size: float
    mergeable: bool


@lru_cache(4096)
def _font(font: str | None) -> tuple[bool, str, bool | None]:
    """Whether a font is of text, its style, and whether it is of tall symbols."""
    if font is None:
        return False, "regular", None
    holds = lambda marks: any(m in font for m in marks)
    bold, italic = holds(fonts.BOLD), holds(fonts.ITALIC)
    return holds(fonts.TEXT), ("bold" if bold else "") + ("italic" if italic else "") or "regular", "CMEX" in font


@lru_cache(65_536)
def _look(names: tuple[str | None, ...]) -> Look:
    found = [_font(f) for f in names]
    core = tuple(k for k, (_, _, tall) in enumerate(found) if tall is False)
    tall = False if core else None if None in names else True
    return Look(tuple(f[:2] for f in found), any(f[0] for f in found), not all(f[0] for f in found), any(f[1] == "bold" for f in found), None if len(core) == len(names) else core, tall)


def raw(spans: Spans) -> Raw:
    _, names, _, x0, y0, x1, y1, oy = spans
    look = _look(names)
    c0, c1 = low, high = min(y0), max(y1)
    if look.core:
        c0, c1 = min(y0[k] for k in look.core), max(y1[k] for k in look.core)
    elif look.core is not None:
        whole = 0.0
        for y in oy:  # one after the other, as engines add
            whole += y
        c0, c1 = whole / len(oy) - 3, whole / len(oy) + 3
    return Raw(spans, look, min(x0), low, max(x1), high, c0, c1)


def y_groups(raws: list[Raw]) -> list[list[Raw]]:
    """See ``lines.y_groups``."""
    firsts: list[tuple[float, float]] = []
    groups: list[list[Raw]] = []
    for r in raws:
        if r.look.tall is not False:
            continue
        c0, c1 = r.c0, r.c1
        for n, (g0, g1) in enumerate(firsts):
            if g1 > c0 and g0 < c1:
                height = min(c1 - c0, g1 - g0)
                if height > 0 and 2 * (min(c1, g1) - max(c0, g0)) >= height:
                    groups[n].append(r)
                    break
        else:
            firsts.append((c0, c1))
            groups.append([r])
    for r in raws:
        if r.look.tall:
            gap, n = min(((min(abs(r.x0 - m.x1), abs(m.x0 - r.x1)), n) for n, g in enumerate(groups) for m in g), default=(TALL_REACH, 0))
            if gap < TALL_REACH:
                groups[n].append(r)
            else:
                groups.append([r])
    return groups


def _clusters(group: list[Raw]) -> Iterator[list[Raw]]:
    order = sorted(group, key=lambda r: r.x0)
    begin = 0
    for k in range(1, len(order)):
        if order[k].x0 - order[k - 1].x1 >= X_GAP:
            yield order[begin:k]
            begin = k
    yield order[begin:]


def _merges(cluster: list[Raw]) -> bool:
    """See ``lines.guard``."""
    if not 1 < len(cluster) <= CLUSTER_MOST:
        return False
    left = min(r.x0 for r in cluster) + MARGIN
    return any(r.look.has_text for r in cluster) and sum(r.look.has_text and r.x0 < left for r in cluster) <= 1


def members(raws: list[Raw]) -> Iterator[list[Raw]]:
    """The raw lines that make each line, in the order of lines."""
    for group in y_groups(raws):
        if len(group) == 1:
            yield group
            continue
        for cluster in _clusters(group):
            if _merges(cluster):
                yield cluster
            else:
                yield from ([r] for r in cluster)


def _dominant(texts: Sequence[str], kinds: Sequence[tuple[bool, str]]) -> str:
    sums: dict[str, int] = {}
    for t, (is_text, style) in zip(texts, kinds, strict=True):
        if is_text and t.strip(BLANKS):
            sums[style] = sums.get(style, 0) + len(t)
    return max(sums, key=sums.__getitem__, default="regular")


def _line(rs: list[Raw]) -> Line | None:
    """The line that raw lines make, or None if nothing in it is translated."""
    one = rs[0]
    if len(rs) == 1:
        texts, kinds, size = one.spans[0], one.look.kinds, one.spans[2][0]
        x0, y0, y1, has_math, has_bold = one.x0, one.y0, one.y1, one.look.has_math, one.look.has_bold
    else:
        spans = sorted((s for r in rs for s in zip(r.spans[3], r.spans[0], r.look.kinds, r.spans[2], strict=True)), key=itemgetter(0))
        _, texts, kinds, sizes = zip(*spans, strict=True)
        x0, y0, y1, size = min(r.x0 for r in rs), min(r.y0 for r in rs), max(r.y1 for r in rs), sizes[0]
        has_math, has_bold = any(r.look.has_math for r in rs), any(r.look.has_bold for r in rs)
    n_math = 0
    if has_math:
        if not any(k[0] and SPOKEN.search(t) for k, t in zip(kinds, texts, strict=True)):
            return None
        pieces, before = [], True
        for (is_text, _), t in zip(kinds, texts, strict=True):
            if is_text:
                pieces.append(t)
            elif before:
                pieces.append(f"{{M{n_math}}}")
                n_math += 1
            before = is_text
        template = "".join(pieces)
    else:
        template = "".join(texts)
        if not SPOKEN.search(template):
            return None
    is_toc = LEADER.search(template) is not None
    own = CONTENT.match(template)[1].strip(BLANKS) if is_toc else template
    ok = not is_toc and n_math == 0 and size <= 11 and not (has_bold and _dominant(texts, kinds) == "bold")
    return Line(own, n_math, x0, y0, y1, size, ok)


def lines(raws: Iterable[Spans]) -> list[tuple[int, Line]]:
    """(line_no, line) of a block's raw lines, each by columns: those that ``lines.lines`` gives."""
    found = ((n, _line(rs)) for n, rs in enumerate(members([raw(spans) for spans in raws if spans[0]])))
    return [(n, l) for n, l in found if l]


def grouped(own: list[tuple[int, Line]]) -> Iterator[list[Line]]:
    """Paragraphs of a document's lines (page_idx, line), see ``paragraphs.grouped``."""
    held: list[Line] = []
    page = None
    for p, l in own:
        if held:
            b = held[-1]
            if not (l.mergeable and b.mergeable and p == page and abs(l.x0 - b.x0) < 20 and l.y0 - b.y1 < b.first_size and abs(l.first_size - b.first_size) < 0.5):
                yield held
                held = []
        held.append(l)
        page = p
    if held:
        yield held


def merged(group: list[Line]) -> str:
    """A paragraph's text, see ``paragraphs.merged``."""
    parts, offset = [], 0
    for l in group:
        parts.append(MARKER.sub(lambda m, by=offset: f"{{M{int(m[1]) + by}}}", l.own) if offset else l.own)
        offset += l.n_math
    return " ".join(parts)


def lexicon(said: str, words: dict[str, str]) -> str:
    return " ".join([words.get(w, w) for w in said.split(" ")])


def translated(pages: Iterable[tuple[int, int, list[Spans]]], words: dict[str, str]) -> Iterator[str]:
    """The translation of each line of a document's blocks (page_idx, block_no, raws), in the order of lines."""
    own = [(page, block, n, l) for page, block, raws in pages for n, l in lines(raws)]
    own.sort(key=itemgetter(0, 1, 2))
    for group in grouped([(page, l) for page, _, _, l in own]):
        yield from split(lexicon(merged(group), words), [len(l.own) for l in group], [l.n_math for l in group])


def split_translation(docs: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, seq, translated) of ``docs`` (doc_id, text): every line of the lifted texts with its share of its paragraph's translation by the lexicon.

    Whole texts are dealt by doc_id, once; rows that share an id are one document, as in ``lift.blocks``.
    """
    table = LEXICON if words is None else words

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS):
                part = batch.slice(k, DOCS)
                yield from zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        seqs: list[int] = []
        said: list[str] = []
        kinds = (("doc_id", pa.int64()), ("seq", pa.int32()), ("translated", pa.string()))
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((ids, seqs, said), kinds, strict=True)], [n for n, _ in kinds])
        for doc, same in groupby(rows(batches), itemgetter(0)):
            for seq, t in enumerate(translated(lift.pages(doc, [t for _, t in same]), table)):
                ids.append(doc)
                seqs.append(seq)
                said.append(t)
            if len(ids) >= LINES:
                yield made()
                ids, seqs, said = [], [], []
        if ids:
            yield made()

    known = lift.dealt(docs).sortWithinPartitions("doc_id")
    return known.mapInArrow(run, "doc_id long, seq int, translated string")
