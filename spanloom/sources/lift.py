"""The layout lift: prose as blocks of raw lines of positioned spans, by arithmetic alone.

Documents are dealt by doc_id once, while they are still whole texts. A paragraph becomes a block, made in one row
with all its raw lines and spans as nested columns: no window, join or sort but the running count of a document's lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import nested

#: Fixed values of the lift.
LINE_WORDS, PAGE_LINES, PITCH, TOP, LEFT, INDENT, ADVANCE = 12, 35, 18, 72, 72, 24, 5
BLANK = "[ \\t\\n\\r\\f\\x0B]"
TOKEN, WORD, MATH = "[^ \\t\\r\\f\\x0B]+", "[^ \\t\\n\\r\\f\\x0B]", "[0-9#$%&*+=<>_/|@^~-]"
MATH_FONTS = ("CMMI10", "CMR10", "CMSY10", "CMEX10", "rsfs10", "MSBM10")
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
#: Raw lines of a visual line at most, twice its words and more: what a line's number is multiplied by to number them.
RAWS = 100


def _font(math: Column, wno: Column, head: Column) -> Column:
    fifth = F.floor(wno / 5)
    text = F.when(head, "SFBX1440").when(fifth % 7 == 3, "SFTI1000").when(fifth % 11 == 5, "SFBX1000").when(fifth % 13 == 6, "SFBI1000").otherwise("SFRM1000")
    drawn = F.get(F.array(*map(F.lit, MATH_FONTS)), ((F.col("doc_id") + wno) % 6).cast("int"))
    return F.concat(F.lit("ABCDEF+"), F.when(math, drawn).otherwise(text))


def _span(text: Column, font: Column, size: Column | float, x0: Column, y0: Column, width: Column | int, height: float = 10, base: float = 8) -> Column:
    num = lambda x: (F.lit(x) if isinstance(x, (int, float)) else x).cast("double")
    return F.struct(
        text.alias("text"), font.alias("font"), num(size).alias("size"), num(x0).alias("x0"), num(y0).alias("y0"), num(x0 + width).alias("x1"), num(y0 + height).alias("y1"), num(y0 + base).alias("oy")
    )


def _visual(line: Column) -> Column:
    """Raw lines (arrays of spans) of a visual line: its fragments of one class, and the small lines that stand over some of them."""
    words = F.slice("toks", line * LINE_WORDS + 1, F.lit(LINE_WORDS))
    start = LEFT + F.when(F.col("block_no") % 3 == 1, INDENT).otherwise(0)
    top = TOP + PITCH * ((F.col("first") + line) % PAGE_LINES)
    head = (F.col("block_no") == 0) & (line == 0)

    def raws(toks: Column) -> Column:
        before = lambda j: F.when(j == 0, 0).otherwise(F.length(F.array_join(F.slice(toks, F.lit(1), j), " ")) + 1)
        words = F.transform(
            toks, lambda t, j: F.struct(t.alias("t"), t.rlike(MATH).alias("math"), (line * LINE_WORDS + j).alias("wno"), (j + 1 == F.size(toks)).alias("last"), (start + ADVANCE * before(j)).alias("x"))
        )
        return F.flatten(F.transform(nested.runs(words, lambda a, b: a.math != b.math), raised))

    def raised(part: Column) -> Column:
        one = F.get(part, F.lit(0))
        even = (F.col("doc_id") + one.wno) % 2 == 0
        y = top + F.when(~one.math, 0).when(even, -3).otherwise(-8)
        own = F.transform(
            part, lambda a: _span(F.when(a.math | a.last, a.t).otherwise(F.concat(a.t, F.lit(" "))), _font(a.math, a.wno, head), F.when(head & ~a.math, 14.5).otherwise(10.0), a.x, y, ADVANCE * F.length(a.t))
        )
        small = F.array(_span(F.lit("d"), F.lit("ABCDEF+CMMI7"), 7.0, one.x, y - 3, 4, 5, 6))
        return F.when(one.math & even & (one.wno % 3 == 0), F.array(own, small)).otherwise(F.array(own))

    return F.transform(nested.let(words, raws), lambda s, k: F.struct(((F.col("first") + line) * RAWS + k).cast("int").alias("raw_no"), s.alias("spans")))


def _contents() -> Column:
    """The raw lines of a document's contents entry: words and leaders, and in documents of odd id the page number apart from them."""
    number = (F.col("doc_id") % 200).cast("string")
    even = F.col("doc_id") % 2 == 0
    apart = F.when(F.col("doc_id") % 3 == 0, 50.0).when(F.col("doc_id") % 3 == 1, 49.0).otherwise(51.0)
    entry = F.concat("para", F.lit(" . . . . . "), F.when(even, number).otherwise(""))
    line = lambda no, t, x, y: F.struct(F.lit(no).alias("raw_no"), F.array(_span(t, F.lit("ABCDEF+SFRM1000"), 10.0, x, y, ADVANCE * F.length(t))).alias("spans"))
    first = line(0, entry, F.lit(LEFT), F.lit(50.0))
    return F.when(even, F.array(first)).otherwise(F.array(first, line(1, number, F.lit(400), apart)))


def boxed(raws: Column) -> Column:
    """Raw lines (raw_no, spans) with the box of their spans."""
    low, high = (lambda c: lambda r: nested.least(r.spans, lambda s: s[c])), (lambda c: lambda r: nested.most(r.spans, lambda s: s[c]))
    return F.transform(raws, lambda r: F.struct(r.raw_no.alias("raw_no"), r.spans.alias("spans"), low("x0")(r).alias("x0"), low("y0")(r).alias("y0"), high("x1")(r).alias("x1"), high("y1")(r).alias("y1")))


@nested.once
def _raws() -> Column:
    return boxed(F.when(F.col("block_no") == -1, _contents()).otherwise(F.flatten(F.transform(F.sequence("begin", "stop"), _visual))))


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of rows that have both, dealt by doc_id."""
    # the number is given: what a text becomes is fifty times its size, so that few bytes are no reason for fewer tasks
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").repartition(n, "doc_id")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_no, raws) of ``docs`` (doc_id, text): the blocks of each page, raws in their order.

    Block -1 is a document's contents entry. ``raws`` are structs (raw_no, spans, box); rows without id or text have none.
    """
    known = dealt(docs)
    head = F.array_join(F.filter(F.array(*(F.regexp_extract("text", f"^{BLANK}*({WORD}*){BLANK}*({WORD}*){BLANK}*({WORD}*)", k) for k in (1, 2, 3))), lambda t: t != ""), " ")
    paras = known.select("doc_id", F.posexplode(F.concat(F.array(head), F.split("text", "\n"))).alias("place", "para"))
    paras = paras.withColumn("block_no", F.col("place") - 1)
    toks = paras.select("doc_id", "block_no", "para", F.when(F.col("block_no") >= 0, F.regexp_extract_all("para", F.lit(TOKEN), 0)).otherwise(F.array().cast("array<string>")).alias("toks"))
    w = W.partitionBy("doc_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    n = F.ceil(F.size("toks") / LINE_WORDS).cast("int")
    rows = toks.withColumn("n", n).withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("int")).filter("n > 0 OR block_no = -1")
    page = lambda line: F.floor(line / PAGE_LINES).cast("int")
    pages = F.when(F.col("block_no") == -1, F.array(F.lit(0))).otherwise(F.sequence(page(F.col("first")), page(F.col("first") + F.col("n") - 1)))
    rows = rows.withColumn("page_idx", F.explode(pages))
    begin = F.greatest(F.lit(0), F.col("page_idx") * PAGE_LINES - F.col("first"))
    stop = F.least(F.col("n") - 1, F.col("page_idx") * PAGE_LINES + PAGE_LINES - 1 - F.col("first"))
    return rows.withColumns({"begin": begin, "stop": stop}).select("doc_id", "page_idx", "block_no", _raws().alias("raws"))


# -- the same in plain Python, for a worker that holds a document ------------

_TOKENS, _MATHS = re.compile(TOKEN), re.compile(MATH)
_HEAD = re.compile(f"{BLANK}*({WORD}*)" * 3)
_DRAWN = tuple("ABCDEF+" + f for f in MATH_FONTS)
#: Fonts of text by a word's number: they repeat after 5 * 7 * 11 * 13 words; a line's words more, so that its fonts are a slice.
_PERIOD = 5 * 7 * 11 * 13
_TEXTS = tuple("ABCDEF+" + ("SFTI1000" if k % 7 == 3 else "SFBX1000" if k % 11 == 5 else "SFBI1000" if k % 13 == 6 else "SFRM1000") for k in (w // 5 % (_PERIOD // 5) for w in range(_PERIOD + LINE_WORDS)))
#: A raw line by columns, one value a span: text, font, size, x0, y0, x1, y1, oy.
Spans = tuple[Sequence[str], tuple[str | None, ...], Sequence[float], Sequence[float], Sequence[float], Sequence[float], Sequence[float], Sequence[float]]


def _rem(a: int, n: int) -> int:
    """Remainder with the sign of ``a``, as in SQL."""
    return a % n if a >= 0 else -(-a % n)


def _tokens(para: str) -> list[str]:
    if "\t" in para or "\r" in para or "\f" in para or "\x0b" in para:
        return _TOKENS.findall(para)
    toks = para.split(" ")
    return [t for t in toks if t] if "" in toks else toks


def _entry_lines(doc: int, head: str) -> list[Spans]:
    number, even = str(_rem(doc, 200)), doc % 2 == 0
    line = lambda t, x, y: ([t], ("ABCDEF+SFRM1000",), [10.0], [x], [y], [x + ADVANCE * len(t)], [y + 10], [y + 8])
    first = line(f"{head} . . . . . {number if even else ''}", LEFT, 50)
    return [first] if even else [first, line(number, 400, {0: 50, 1: 49}.get(_rem(doc, 3), 51))]


def _visual_lines(doc: int, toks: list[str], wno: int, start: int, top: int, head: bool) -> Iterator[Spans]:
    """``_visual`` of the words ``toks``, the first of which is word ``wno`` of its block."""
    size = len(toks)
    x0 = list(accumulate([ADVANCE * len(t) + ADVANCE for t in toks], initial=start))
    x1 = [x - ADVANCE for x in x0[1:]]
    x0.pop()
    said = [t + " " for t in toks]
    said[-1] = toks[-1]
    fonts = ("ABCDEF+SFBX1440",) * size if head else _TEXTS[wno % _PERIOD : wno % _PERIOD + size]
    em = 14.5 if head else 10.0
    if not _MATHS.search("".join(toks)):
        yield said, fonts, [em] * size, x0, [top] * size, x1, [top + 10] * size, [top + 8] * size
        return
    maths = [bool(_MATHS.search(t)) for t in toks]
    begin = 0
    for k in range(1, size + 1):
        if k < size and maths[k] == maths[begin]:
            continue
        n, part = k - begin, slice(begin, k)
        if maths[begin]:
            even = (doc + wno + begin) % 2 == 0
            y = top - 3 if even else top - 8
            drawn = tuple(_DRAWN[r] if (r := _rem(doc + wno + j, 6)) >= 0 else None for j in range(begin, k))
            yield toks[part], drawn, [10.0] * n, x0[part], [y] * n, x1[part], [y + 10] * n, [y + 8] * n
            if even and (wno + begin) % 3 == 0:
                yield ["d"], ("ABCDEF+CMMI7",), [7.0], [x0[begin]], [y - 3], [x0[begin] + 4], [y + 2], [y + 3]
        else:
            yield said[part], fonts[part], [em] * n, x0[part], [top] * n, x1[part], [top + 10] * n, [top + 8] * n
        begin = k


def pages(doc: int, texts: list[str]) -> Iterator[tuple[int, int, list[Spans]]]:
    """``blocks`` of one document, given as the texts of its rows: (page_idx, block_no, raws)."""
    for t in texts:
        yield 0, -1, _entry_lines(doc, " ".join(w for w in _HEAD.match(t).groups() if w))
    paras = [(block, p) for t in texts for block, p in enumerate(t.split("\n"))]
    if len(texts) > 1:
        paras.sort(key=lambda p: p[0])
    first = 0
    for block, para in paras:
        toks = _tokens(para)
        n = -(-len(toks) // LINE_WORDS)
        start = LEFT + (INDENT if block % 3 == 1 else 0)
        line = 0
        while line < n:
            page = (first + line) // PAGE_LINES
            stop = min(n, (page + 1) * PAGE_LINES - first)
            yield page, block, [
                spans
                for k in range(line, stop)
                for spans in _visual_lines(doc, toks[k * LINE_WORDS : (k + 1) * LINE_WORDS], k * LINE_WORDS, start, TOP + PITCH * ((first + k) % PAGE_LINES), block == 0 and k == 0)
            ]
            line = stop
        first += n


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def lift(spark, sf_dir: str) -> DataFrame:
    """``blocks`` of a folder's documents."""
    return blocks(documents(spark, sf_dir))
