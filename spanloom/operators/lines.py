"""From raw lines to lines: grouping, clustering, merging, templates.

The unit of work is a block of a page with its raw lines as a nested column (``raws``: raw_no, spans, box), as parsers give it.
What depends on order inside a block (first fit, attachment) is a fold over that column, evaluated in the
row: no join, no window and no exchange before lines are rows, and a block costs what its own lines cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import fonts, nested, text
from spanloom.functions.nested import let

BLOCK = ("doc_id", "page_idx", "block_no")
KEY = (*BLOCK, "line_no")
#: Gap in x that parts clusters, members of a merged cluster at most, width of the left margin, reach of tall symbols.
X_GAP, CLUSTER_MOST, MARGIN, TALL_REACH = 8, 8, 15, 20
#: Distance in y, and in x from the first mathematics, at which a line of mathematics alone is attached.
NEAR_Y, NEAR_X = 20, 15
SPAN = "struct<text:string,font:string,size:double,x0:double,y0:double,x1:double,y1:double,oy:double>"


def _tall(s: Column) -> Column:
    return s.font.contains("CMEX")


def _is_text(s: Column) -> Column:
    return fonts.is_text(s.font)


def cored(raws: Column) -> Column:
    """Raw lines with their core range of y (tall symbols left out, unless alone) and what their spans are."""

    def one(r: Column) -> Column:
        low = F.filter(r.spans, lambda s: ~_tall(s))
        mean = nested.total(r.spans, lambda s: s.oy) / F.size(r.spans)
        return F.struct(
            *(r[c].alias(c) for c in ("raw_no", "spans", "x0", "y0", "x1", "y1")),
            F.coalesce(nested.least(low, lambda s: s.y0), mean - 3).alias("c0"), F.coalesce(nested.most(low, lambda s: s.y1), mean + 3).alias("c1"), mean.alias("mean_oy"),
            F.exists(r.spans, _is_text).alias("has_text"), F.forall(r.spans, _tall).alias("tall"),
        )

    return F.transform(F.filter(raws, lambda r: F.size(r.spans) > 0), one)


def overlaps(a: Column, b: Column) -> Column:
    """Half of the lower one's height or more in common."""
    height = F.least(a.c1 - a.c0, b.c1 - b.c0)
    return F.coalesce((height > 0) & (2 * (F.least(a.c1, b.c1) - F.greatest(a.c0, b.c0)) >= height), F.lit(False))


def y_groups(rows: Column) -> Column:
    """Groups of the places of ``rows`` (cored): first fit against each group's first member; lines of tall symbols
    alone join the group of the line next to them in x, if that is near."""

    def into(groups: Column, k: Column, i: Column, c0: Column, c1: Column) -> Column:
        """``groups`` with place ``i`` in group ``k``, or in a new one where k is null."""
        grown = F.transform(groups, lambda g, n: F.struct(g.c0.alias("c0"), g.c1.alias("c1"), F.when(n == k, F.concat(g.m, F.array(i))).otherwise(g.m).alias("m")))
        fresh = F.concat(groups, F.array(F.struct(c0.alias("c0"), c1.alias("c1"), F.array(i).alias("m"))))
        return F.when(k.isNull(), fresh).otherwise(grown).cast(kind)

    def fit(groups: Column, i: Column) -> Column:
        r = F.get(rows, i)
        return let(F.array_position(F.transform(groups, lambda g: overlaps(r, g)), F.lit(True)), lambda at: into(groups, F.when(at > 0, at.cast("int") - 1), i, r.c0, r.c1))

    def reach(groups: Column, i: Column) -> Column:
        r = F.get(rows, i)
        gap = lambda m: F.least(F.abs(r.x0 - m.x1), F.abs(m.x0 - r.x1))
        near = F.flatten(F.transform(groups, lambda g, n: F.transform(g.m, lambda j: F.struct(gap(F.get(rows, j)).alias("gap"), n.alias("n")))))
        return let(F.array_min(near), lambda b: into(groups, F.when(b.gap < TALL_REACH, b.n), i, r.c0, r.c1))

    kind = "array<struct<c0:double,c1:double,m:array<int>>>"
    flat = lambda tall: F.filter(nested.indexes(rows), lambda i: F.get(rows, i).tall == tall)
    fitted = F.aggregate(flat(False), F.array().cast(kind), fit)
    return F.transform(F.aggregate(flat(True), fitted, reach), lambda g: g.m)


def clusters(rows: Column, group: Column) -> Column:
    """A group's places in order of x, cut where the gap to the line before (not to all before) is wide."""
    order = F.array_sort(F.transform(group, lambda i, p: F.struct(F.get(rows, i).x0.alias("x0"), p.alias("p"), i.alias("i"), F.get(rows, i).x1.alias("x1"))))
    return F.transform(nested.runs(order, lambda a, b: b.x0 - a.x1 >= X_GAP), lambda c: F.transform(c, lambda e: e.i))


def guard(rows: Column, cluster: Column) -> Column:
    """(n_members, n_margin, merged) of a cluster: merged if it has few members, text among them, one text at the left margin at most."""
    members = nested.picked(rows, cluster)
    left = nested.least(members, lambda r: r.x0)
    at_margin = let(left, lambda x: F.size(F.filter(members, lambda r: r.has_text & (r.x0 < x + MARGIN))))
    ok = (F.size(cluster) <= CLUSTER_MOST) & F.exists(members, lambda r: r.has_text) & (at_margin <= 1)
    return F.struct(F.size(cluster).alias("n_members"), at_margin.alias("n_margin"), ((F.size(cluster) > 1) & ok).alias("merged"))


def merged_places(rows: Column, groups: Column) -> Column:
    """(group, places) of a block's lines, in their order."""

    def of(group: Column, n: Column) -> Column:
        line = lambda places: F.struct(n.alias("y_group"), places.alias("m"))
        return F.flatten(F.transform(clusters(rows, group), lambda c: F.when(guard(rows, c).merged, F.array(line(c))).otherwise(F.transform(c, lambda i: line(F.array(i))))))

    return F.flatten(F.transform(groups, of))


def _line(rows: Column, place: Column) -> Column:
    """A line of one raw line or several: spans (of several: by x), box, and what decides its fate."""
    members = nested.picked(rows, place.m)
    spread = F.flatten(F.transform(place.m, lambda i, p: F.transform(F.get(rows, i).spans, lambda s, q: F.struct(s.x0.alias("x0"), p.alias("p"), q.alias("q"), s.alias("s")))))
    spans = F.when(F.size(place.m) == 1, F.get(rows, F.get(place.m, F.lit(0))).spans).otherwise(F.transform(F.array_sort(spread), lambda e: e.s))
    box = ((lambda c, f: f(members, lambda r: r[c]).alias(c))(c, f) for c, f in (("x0", nested.least), ("y0", nested.least), ("x1", nested.most), ("y1", nested.most)))
    return F.struct(spans.alias("spans"), *box)


def _words(spans: Column) -> Column:
    return F.array_join(F.transform(F.filter(spans, _is_text), lambda s: s.text), "")


def _judged(line: Column) -> Column:
    """A line with its fate: ``kept``, ``math`` (no text, but mathematics) or neither, its first run of mathematics and where that begins."""
    maths = nested.runs(line.spans, lambda a, b: _is_text(a) != _is_text(b))

    def fate(t: Column, first: Column) -> Column:
        blank, marks = text.is_blank(t), first.isNotNull()
        return F.struct(
            *(line[c].alias(c) for c in ("spans", "x0", "y0", "x1", "y1")), first.alias("first"),
            (~blank & ~text.is_numeric_only(t)).alias("kept"), (blank & marks).alias("alone"),
        )

    has = F.exists(line.spans, lambda s: ~_is_text(s))
    first = F.when(has, F.get(F.filter(maths, lambda run: ~_is_text(F.get(run, F.lit(0)))), F.lit(0)))
    return let(first, lambda f: let(_words(line.spans), lambda t: fate(t, f)))


def attachments(lines: Column) -> Column:
    """(line_no, to_line) of lines of mathematics alone, one after the other: to the line kept of the block that holds mathematics, whose
    middle is nearest (the first, on a tie), and whose first mathematics is near in x. What was attached comes first from then on."""
    ends = F.array().cast("array<struct<line_no:int,to_line:int>>")
    homes = F.filter(F.transform(lines, lambda l, n: F.struct(n.alias("n"), ((l.y0 + l.y1) / 2).alias("mid"), F.get(l.first, F.lit(0)).x0.alias("x"), l.kept.alias("kept"))), lambda h: h.kept & h.x.isNotNull())

    def step(state: Column, n: Column) -> Column:
        own = F.get(lines, n)
        mid = (own.y0 + own.y1) / 2
        near = F.filter(state.homes, lambda h: (F.abs(mid - h.mid) < NEAR_Y) & (F.abs(own.x0 - h.x) < NEAR_X))
        best = F.array_min(F.transform(near, lambda h: F.struct(F.abs(mid - h.mid).alias("far"), h.n.alias("n"))))
        x = F.get(own.first, F.lit(0)).x0
        return let(
            best,
            lambda b: F.when(b.isNull(), state).otherwise(
                F.struct(
                    F.transform(state.homes, lambda h: F.struct(h.n.alias("n"), h.mid.alias("mid"), F.when(h.n == b.n, x).otherwise(h.x).alias("x"), h.kept.alias("kept"))).alias("homes"),
                    F.concat(state.done, F.array(F.struct(n.alias("line_no"), b.n.alias("to_line")))).alias("done"),
                ).cast(kind)
            ),
        )

    kind = "struct<homes:array<struct<n:int,mid:double,x:double,kept:boolean>>,done:array<struct<line_no:int,to_line:int>>>"
    alone = F.filter(nested.indexes(lines), lambda n: F.get(lines, n).alone)
    fold = F.aggregate(alone, F.struct(homes.alias("homes"), ends.alias("done")).cast(kind), step, lambda s: s.done)
    return F.when(F.exists(lines, lambda l: l.alone), fold).otherwise(ends)


def _numbers(raws: Column) -> Column:
    """Raw lines that are nothing but a page number: (y, text, x1)."""
    said = lambda r: text.strip(F.array_join(F.transform(r.spans, lambda s: s.text), ""))
    return F.transform(F.filter(raws, lambda r: text.is_page_number(said(r))), lambda r: F.struct(r.y0.cast("int").alias("y"), said(r).alias("text"), r.x1.alias("x1")))


# -- relations --------------------------------------------------------------


def english(blocks: DataFrame) -> DataFrame:
    """(key, n_words, n_marks, is_english) of every block: its text without separators."""
    all_ = F.flatten(F.transform("raws", lambda r: r.spans))
    b = blocks.select(*BLOCK, _words(all_).alias("t"))
    words = text.english_words(F.col("t"))
    return b.select(*BLOCK, F.size(words).cast("long").alias("n_words"), text.english_hits(words).cast("long").alias("n_marks"), text.is_english(F.col("t")).alias("is_english"))


def foreign(blocks: DataFrame) -> DataFrame:
    """Blocks that are not English already."""
    return blocks.filter(let(_words(F.flatten(F.transform("raws", lambda r: r.spans))), lambda t: ~text.is_english(t)))


def fragments(blocks: DataFrame) -> DataFrame:
    """Raw lines as rows: box, core range of y, and what their spans are."""
    return blocks.select(*BLOCK, F.explode(cored(F.col("raws"))).alias("r")).select(*BLOCK, "r.*")


def raw_spans(blocks: DataFrame) -> DataFrame:
    """Spans as rows: (key, raw_no, span_no, is_text, span)."""
    raws = blocks.select(*BLOCK, F.explode("raws").alias("r")).select(*BLOCK, "r.raw_no", F.posexplode("r.spans").alias("span_no", "s"))
    return raws.select(*BLOCK, "raw_no", "span_no", fonts.is_text(F.col("s.font")).alias("is_text"), "s.*")


@nested.once
def _cored() -> Column:
    return cored(F.col("raws"))


@nested.once
def _y_groups() -> Column:
    return y_groups(F.col("rows"))


@nested.once
def _merged_places() -> Column:
    return merged_places(F.col("rows"), F.col("fits"))


def _placed(blocks: DataFrame, *keep: str) -> DataFrame:
    """Blocks with their raw lines (rows), y-groups (fits) and the places that make each line."""
    b = nested.step(blocks, (*BLOCK, *keep), rows=_cored())
    b = nested.step(b, (*BLOCK, *keep, "rows"), fits=_y_groups())
    return nested.step(b, (*BLOCK, *keep, "rows", "fits"), places=_merged_places())


@nested.once
def _homes() -> Column:
    return F.flatten(F.transform("places", lambda l, n: F.transform(l.m, lambda i: F.struct(F.get(F.col("rows"), i).raw_no.alias("raw_no"), l.y_group.alias("y_group"), n.alias("line_no")))))


def places(blocks: DataFrame) -> DataFrame:
    """(key, raw_no, y_group, line_no): the line that each raw line ends up in."""
    return _placed(blocks).select(*BLOCK, F.explode(_homes()).alias("p")).select(*BLOCK, "p.*")


@nested.once
def _verdicts() -> Column:
    rows = F.col("rows")
    one = lambda c, k, n: let(guard(rows, c), lambda v: F.struct(n.alias("y_group"), k.alias("cluster"), F.transform(c, lambda i: F.get(rows, i).raw_no).alias("raws"), v.n_members.alias("n_members"), v.n_margin.alias("n_margin"), v.merged.alias("merged")))
    return F.flatten(F.transform("fits", lambda g, n: F.transform(clusters(rows, g), lambda c, k: one(c, k, n))))


def verdicts(blocks: DataFrame) -> DataFrame:
    """(key, y_group, cluster, raws, n_members, n_margin, merged): clusters of every group with the guard's verdict."""
    return _placed(blocks).select(*BLOCK, F.explode(_verdicts()).alias("c")).select(*BLOCK, "c.*")


@nested.once
def _joined() -> Column:
    return F.transform("places", lambda p: _line(F.col("rows"), p))


@nested.once
def _fates() -> Column:
    return F.transform("joined", _judged)


@nested.once
def _attached() -> Column:
    return attachments(F.col("lines"))


@nested.once
def _page_numbers() -> Column:
    return _numbers(F.col("raws"))


@nested.once
def _kept() -> Column:
    """Lines kept, as they leave their block: number, spans, box, mathematics attached (the last first), and the block's page numbers."""
    lines, done = F.col("lines"), F.col("attached")
    before = lambda n: F.flatten(F.transform(F.reverse(F.filter(done, lambda a: a.to_line == n)), lambda a: F.get(lines, a.line_no).first))
    none = F.array().cast(f"array<{SPAN}>")
    one = lambda l, n: F.struct(l.kept.alias("kept"), n.alias("line_no"), l.spans.alias("spans"), *(l[c].alias(c) for c in ("x0", "y0", "x1", "y1")), F.when(F.size(done) > 0, before(n)).otherwise(none).alias("before"), F.col("numbers").alias("numbers"))
    return F.filter(F.transform(lines, one), lambda l: l.kept)


def _all_lines(blocks: DataFrame) -> DataFrame:
    """Blocks with their judged lines, what is attached to what, and their page numbers."""
    b = nested.step(_placed(blocks, "raws"), (*BLOCK, "raws"), joined=_joined())
    b = nested.step(b, BLOCK, lines=_fates(), numbers=_page_numbers())
    return nested.step(b, (*BLOCK, "lines", "numbers"), attached=_attached())


def attached(blocks: DataFrame) -> DataFrame:
    """(key of a line of mathematics alone, to_line)."""
    return _all_lines(blocks).select(*BLOCK, F.explode("attached").alias("a")).select(*BLOCK, "a.*")


def lines(blocks: DataFrame) -> DataFrame:
    """One row a line that is translated: template, spans, groups of mathematics, style runs, box, sizes, contents entry.

    ``groups``: runs of mathematics; what was attached to the line stands before the first, the last attached first. ``runs``: (n, style) over
    its text. A contents entry without a number takes the block's page number at its height, and reaches to that.
    Lines of digits and marks only, and those without text, are left out.
    """
    out = _all_lines(blocks).select(*BLOCK, F.explode(_kept()).alias("l")).select(*BLOCK, "l.*")
    return _described(out)


@nested.once
def _parts() -> Column:
    flat = F.transform("spans", lambda s: F.struct(_is_text(s).alias("is_text"), s.alias("s")))
    return nested.runs(flat, lambda a, b: a.is_text != b.is_text)


@nested.once
def _read() -> Column:
    """What a line's spans and their runs (``parts``) say: template, runs of mathematics, style runs, sizes."""
    is_math = lambda run: ~F.get(run, F.lit(0)).is_text
    maths = F.transform(F.filter("parts", is_math), lambda run: F.transform(run, lambda e: e.s))
    # text and mathematics take turns: a run's number is half its place
    skip = F.when(is_math(F.get(F.col("parts"), F.lit(0))), 0).otherwise(1)
    number = lambda k: F.floor((k - skip) / 2).cast("string")
    pieces = F.transform("parts", lambda run, k: F.when(is_math(run), F.concat(F.lit("{M"), number(k), F.lit("}"))).otherwise(F.array_join(F.transform(run, lambda e: e.s.text), "")))
    words = F.filter("spans", _is_text)
    styled = F.transform(words, lambda s: F.struct(fonts.style(s.font).alias("style"), F.length(s.text).alias("n")))
    runs = F.transform(nested.runs(styled, lambda a, b: a.style != b.style), lambda r: F.struct(nested.total(r, lambda e: e.n).cast("int").alias("n"), F.get(r, F.lit(0)).style.alias("style")))
    visible = F.get(F.filter(words, lambda s: ~text.is_blank(s.text)), F.lit(0))
    return F.struct(
        F.array_join(pieces, "").alias("template"), maths.alias("maths"), runs.alias("runs"), F.get(F.col("spans"), F.lit(0)).size.alias("first_size"),
        let(visible, lambda v: F.struct(v.size.alias("size"), v.oy.alias("oy"))).alias("seen"), dominant(F.col("spans")).alias("font_style"),
    )


@nested.once
def _entry() -> Column:
    """Contents entry: its words, its page number, its right edge, by the template and the block's page numbers."""
    template, y = F.col("r.template"), F.col("y0").cast("int")
    found = F.get(F.reverse(F.filter("numbers", lambda e: (y == e.y) | (y == e.y + 1))), F.lit(0))
    none = F.struct(F.lit(False).alias("is_toc"), F.lit("").alias("content"), F.lit("").alias("page"), F.col("x1").alias("x1"))

    def entry(own: Column) -> Column:
        far = let(found, lambda e: F.struct(F.lit(True).alias("is_toc"), text.toc_content(template).alias("content"), F.coalesce(e.text, F.lit("")).alias("page"), F.coalesce(e.x1, F.col("x1")).alias("x1")))
        return F.when(own != "", F.struct(F.lit(True).alias("is_toc"), text.toc_content(template).alias("content"), own.alias("page"), F.col("x1").alias("x1"))).otherwise(far)

    return F.when(text.is_toc(template), let(text.toc_page(template), entry)).otherwise(none)


@nested.once
def _grouped() -> Column:
    """Runs of mathematics; the first begins with what was attached."""
    joined = F.transform("r.maths", lambda run, k: F.when(k == 0, F.concat("before", run)).otherwise(run))
    return F.when(F.size("before") > 0, joined).otherwise(F.col("r.maths"))


def _described(l: DataFrame) -> DataFrame:
    # arrays of one, exploded: what follows reads a step's result instead of repeating it
    l = l.withColumn("parts", F.explode(F.array(_parts()))).withColumn("r", F.explode(F.array(_read())))
    l = l.withColumn("e", F.explode(F.array(_entry())))
    return l.select(
        *KEY, "r.template", F.size("r.maths").cast("long").alias("n_math"), "x0", "y0", "e.x1", "y1", "r.first_size", F.coalesce("r.seen.size", "r.first_size").alias("font_size"),
        F.coalesce("r.seen.oy", "y1").alias("baseline"), "r.font_style", "e.is_toc", F.col("e.content").alias("toc_content"), F.col("e.page").alias("toc_page_num"), _grouped().alias("groups"), "r.runs", "spans",
    )


def dominant(spans: Column) -> Column:
    """The style of most characters of a line's visible text spans; the one seen first on a tie, regular without any."""
    seen = F.transform(F.filter(spans, lambda s: _is_text(s) & ~text.is_blank(s.text)), lambda s, k: F.struct(fonts.style(s.font).alias("style"), F.length(s.text).alias("n")))

    def best(seen: Column) -> Column:
        sums = F.transform(
            F.array_distinct(F.transform(seen, lambda e: e.style)),
            lambda st, k: F.struct(nested.total(F.filter(seen, lambda e: e.style == st), lambda e: e.n).alias("n"), (-k).alias("k"), st.alias("style")),
        )
        return F.coalesce(F.array_max(sums).style, F.lit("regular"))

    return let(seen, best)


def group_text() -> Column:
    """What a line gives to its paragraph: a contents entry's words, else its template."""
    return F.when(F.col("is_toc"), F.col("toc_content")).otherwise(F.col("template"))
