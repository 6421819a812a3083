"""Hand-derived vectors for expressions and folds."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import charmaps, fonts, text
from spanloom.operators import layout, lines, paragraphs


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.mask, "a{M0}b", "a XXXM0XXX b"),
        (text.mask, "{M0}{M1}", "XXXM0XXX XXXM1XXX"),
        (text.unmask, "variable  XXXM0XXX-adic", "{M0}-adic variable"),
        (text.unmask, "the  xxxm0xxx  - x", "the {M0} - x"),
        (text.fix_terms, "compact open", "compact open set"),
        (text.fix_terms, "compact open set", "compact open set set"),
        (text.toc_content, "Introduction . . . . 12", "Introduction"),
        (text.toc_page, "Introduction . . . . 12", "12"),
        (text.toc_content, "Intro . . . .", "Intro . . . ."[:5]),
        (text.toc_page, "Intro . . . . ", ""),
        (text.is_numeric_only, "12.", True),
        (text.is_numeric_only, "a1", False),
        (text.is_page_number, " 12 ", True),
        (text.is_page_number, "1234", False),
        (text.is_english, "the this text alpha beta gamma delta epsilon zeta eta", False),
        (text.is_english, "the this text over beta gamma delta epsilon zeta eta", True),
        (text.is_english, "the this text over", False),
        (fonts.is_text, "XYZ+SFBI1000", True),
        (fonts.style, "XYZ+SFBI1000", "bolditalic"),
        (fonts.family, "FITVLG+CMMI10", "CMMI"),
        (fonts.family, "CMR17", "CMR1"),
        (fonts.family, "MSBM10", "MSBM"),
        (fonts.family, "CMR6", "CMR6"),
    ],
)
def test_expression(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(("t", "fam", "want"), [("h", "CMMI", "ℎ"), ("3", "CMMI", "3"), ("P", "CMEX", "∑"), ("A", "CMBX", "\U0001d400"), ("C", "EUFM", "ℭ"), ("B", "rsfs", "ℬ"), ("x", "CMSY", "x")])
def test_char_maps(spark, t, fam, want):
    assert one(spark, lambda c: charmaps.map_text(c, F.lit(fam)), t) == want


@pytest.mark.parametrize(("t", "fam", "want"), [("A", "rsfs", "copy"), (" ", "rsfs", "blank"), ("P", "CMEX", "draw"), ("q", "CMEX", "copy"), ("̸", "CMSY", "copy"), ("\x01", "CMSY", "copy"), ("x", "MSBM", "drop"), ("x", "CMMI", "draw")])
def test_routes(spark, t, fam, want):
    assert one(spark, lambda c: charmaps.route(c, F.lit(fam), fonts.family_style(F.lit(fam))), t) == want


def test_segments_rejoin(spark):
    for t in ("a{M0}b{M1}", "{M0}", "x{M}y{M12}\nz", ""):
        got = one(spark, text.segments, t)
        assert "".join(got) == t
    assert one(spark, text.segments, "a{M0}b") == ["a", "{M0}", "b"]


def test_shift_markers(spark):
    assert one(spark, lambda c: text.shift_markers(c, F.lit(2)), "a{M0} {M1}") == "a{M2} {M3}"


SPAN = "struct<text:string,font:string,size:double,x0:double,y0:double,x1:double,y1:double,oy:double>"
BLOCKS = f"doc_id long, page_idx int, block_no int, raws array<struct<raw_no:int,spans:array<{SPAN}>,x0:double,y0:double,x1:double,y1:double>>"
TEXT, MATH, TALL = "A+SFRM1000", "A+CMMI10", "A+CMEX10"


def raw(no, *spans):
    """A raw line of (text, font, x0, y0, x1, y1) spans, with the box around them."""
    box = [f(s[k] for s in spans) for f, k in ((min, 2), (min, 3), (max, 4), (max, 5))]
    return (no, [(t, f, 10.0, float(x0), float(y0), float(x1), float(y1), float(y1) - 2) for t, f, x0, y0, x1, y1 in spans], *map(float, box))


def block(spark, *raws, doc=1):
    return spark.createDataFrame([(doc, 0, 0, list(raws))], BLOCKS)


def brute_fold(raws):
    """(y-group, line) of every raw line, by the definitions, with plain lists."""
    core = {}
    for r in raws:
        low = [s for s in r[1] if "CMEX" not in s[1]]
        mean = sum(s[7] for s in r[1]) / len(r[1])
        core[r[0]] = (min(s[4] for s in low), max(s[6] for s in low)) if low else (mean - 3, mean + 3)
    tall = {r[0]: all("CMEX" in s[1] for s in r[1]) for r in raws}
    words = {r[0]: any("+SF" in s[1] for s in r[1]) for r in raws}
    box = {r[0]: r[2:] for r in raws}
    groups = []
    for no in [r[0] for r in raws if not tall[r[0]]]:
        a, b = core[no]
        for g in groups:
            c, d = core[g[0]]
            if min(b - a, d - c) > 0 and (min(b, d) - max(a, c)) / min(b - a, d - c) >= 0.5:
                g.append(no)
                break
        else:
            groups.append([no])
    for no in [r[0] for r in raws if tall[r[0]]]:
        gaps = [(min(abs(box[no][0] - box[m][2]), abs(box[m][0] - box[no][2])), k) for k, g in enumerate(groups) for m in g]
        if gaps and min(gaps)[0] < 20:
            groups[min(gaps)[1]].append(no)
        else:
            groups.append([no])
    out, line = {}, 0
    for k, g in enumerate(groups):
        chain = sorted(g, key=lambda m: box[m][0])
        parts = [[chain[0]]]
        for before, m in itertools.pairwise(chain):
            if box[m][0] - box[before][2] < 8:
                parts[-1].append(m)
            else:
                parts.append([m])
        for c in parts:
            left = min(box[m][0] for m in c)
            whole = 1 < len(c) <= 8 and any(words[m] for m in c) and sum(words[m] and box[m][0] < left + 15 for m in c) <= 1
            for n, m in enumerate(c):
                out[m] = (k, line if whole else line + n)
            line += 1 if whole else len(c)
    return out


def test_fold_by_brute_force(spark):
    rng, blocks = random.Random(3), []
    for d in range(150):
        raws = []
        for no in range(rng.randint(1, 14)):
            x, y, h = rng.choice([72, 75, 90, 140, 200, 260]) + rng.random() * 9, rng.choice([100, 101.3, 104, 107, 118]), rng.choice([5, 7, 10, 10, 24])
            spans = [(rng.choice("abc") * rng.randint(1, 5), rng.choice([TEXT, TEXT, MATH, TALL]), x, y, x + rng.randint(3, 60), y + h)]
            if rng.random() < 0.4:
                spans.append(("z", rng.choice([TEXT, MATH, TALL]), spans[0][4] + 1, y - 2, spans[0][4] + 9, y + 8))
            raws.append(raw(no, *spans))
        blocks.append((d, 0, 0, raws))
    got = {(r.doc_id, r.raw_no): (r.y_group, r.line_no) for r in lines.places(spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert got == {(d, no): v for d, _, _, raws in blocks for no, v in brute_fold(raws).items()}


def test_overlap_and_clusters(spark):
    two = lambda y: {r.raw_no: r.y_group for r in lines.places(block(spark, raw(0, ("a", TEXT, 0, 100, 1, 110)), raw(1, ("b", TEXT, 50, y, 51, y + 10)))).collect()}
    assert two(104) == {0: 0, 1: 0} and two(106) == {0: 0, 1: 1}
    v = lines.verdicts(block(spark, raw(0, ("c", TEXT, 28, 0, 30, 10)), raw(1, ("a", TEXT, 0, 0, 10, 10)), raw(2, ("b", MATH, 17, 0, 20, 10)))).collect()
    assert [(r.raws, r.merged) for r in v] == [([1, 2], True), ([0], False)]


def test_lines_at_any_height(spark):
    """A visual line in three raw lines, far from any grid: one template, the mathematics in its place."""
    b = block(spark, raw(0, ("Soit ", TEXT, 72, 101.3, 100, 111.3)), raw(1, ("x", MATH, 101, 100.1, 106, 110.1)), raw(2, ("une fonction", TEXT, 108, 101.3, 170, 111.3)))
    assert [(r.template, r.n_math, r.x0, r.x1) for r in lines.lines(b).collect()] == [("Soit {M0}une fonction", 1, 72.0, 170.0)]


def test_attached_one_after_the_other(spark):
    """What was attached first moves the first mathematics, and with it who is near next; the last attached comes first."""
    b = block(
        spark, raw(0, ("Soit ", TEXT, 72, 100, 100, 110), ("f", MATH, 101, 100, 106, 110)), raw(1, ("a", MATH, 90, 88, 95, 93)), raw(2, ("b", MATH, 78, 94, 82, 99)), raw(3, ("c", MATH, 130, 90, 134, 95)),
    )
    assert {(r.line_no, r.to_line) for r in lines.attached(b).collect()} == {(1, 0), (3, 0)}
    assert [[s.text for s in g] for g in lines.lines(b).first()["groups"]] == [["b", "a", "f"]]


def test_contents_entries(spark):
    entry = lambda y, *more: block(spark, raw(0, ("Intro . . . . . ", TEXT, 72, 50, 150, 60)), raw(1, ("12", TEXT, 400, y, 410, y + 10)), *more)
    got = lambda b: [(r.template, r.toc_content, r.toc_page_num, r.x1) for r in lines.lines(b).collect()]
    assert got(entry(50)) == got(entry(49)) == [("Intro . . . . . ", "Intro", "12", 410.0)]
    assert got(entry(51)) == [("Intro . . . . . ", "Intro", "", 150.0)]
    assert got(entry(50, raw(2, ("7", TEXT, 450, 50, 455, 60)))) == [("Intro . . . . . ", "Intro", "7", 455.0)]  # the last one counts
    groups = paragraphs.merged(paragraphs.grouped(lines.lines(entry(50)))).collect()
    assert [g.wire_text for g in groups] == ["Intro"]
    d = layout.toc_leaders(lines.lines(entry(50))).first()
    assert (d.dots_start, d.pn_x, d.n_dots) == (72 + 25 + 4, 400.0, 29)


def test_split_vector():
    assert paragraphs.split("aaaa bbbb cccc dddd", [10, 10], [0, 0]) == ["aaaa bbbb", "cccc dddd"]
    assert paragraphs.split("x", [5], [0]) == ["x"]
    assert paragraphs.split("x y", [0, 0], [0, 0]) == ["x y", ""]
    assert paragraphs.split("a {M1} b {M0}", [5, 5], [1, 1])[0].count("{M") <= 1


@given(st.text("ab \n", max_size=60), st.lists(st.integers(0, 30), min_size=2, max_size=5))
@settings(max_examples=200, deadline=None)
def test_split_keeps_text(t, lengths):
    got = paragraphs.split(t, lengths, [0] * len(lengths))
    assert len(got) == len(lengths)
    assert "".join("".join(got).split()) == "".join(t.split())


def test_batches(spark):
    sizes = [3000, 1000, 900, 4800, 10]
    df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(sizes)] + [(2, 0, "y")], "doc_id long, group_id long, wire_text string")
    got = {(r.doc_id, r.group_id): r.batch_no for r in paragraphs.batches(df).collect()}
    assert [got[1, k] for k in range(5)] == [0, 0, 0, 1, 2] and got[2, 0] == 0


def brute_boundaries(pieces):
    """Character by character: one style in each bracket, styles carried over labels, equal neighbours joined; placeholders part them."""
    chars = [(c, s) for t, s in pieces if s != "math" for c in t]
    styles, flat = [s for _, s in chars], "".join(c for c, _ in chars)
    if len(chars) > 1:
        for m in re.finditer(r"\[[^\]]*\]", flat):
            inside = styles[m.start() : m.end()]
            styles[m.start() : m.end()] = [max(dict.fromkeys(inside), key=inside.count)] * len(inside)
        carried = False
        for p in range(1, len(flat)):
            carried = flat[p] in ".,;:0123456789" and (carried or styles[p] != styles[p - 1])
            if carried:
                styles[p] = styles[p - 1]
    out, at = [], 0
    for t, s in pieces:
        if s == "math":
            out.append([t, s])
            continue
        for c in t:
            if out and out[-1][1] == styles[at]:
                out[-1][0] += c
            else:
                out.append([c, styles[at]])
            at += 1
    return [tuple(p) for p in out]


def boundaries(spark, many):
    """``layout.bounded`` on lists of pieces, as lines of their own."""
    rows = [(k, 0, 0, 0, [(0, 0, t, s) for t, s in pieces]) for k, pieces in enumerate(many)]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, block_no int, line_no int, pieces array<struct<seg_no:int,run_idx:int,piece:string,style:string>>")
    return [[(p.piece, p.style) for p in r.pieces] for r in layout.bounded(df).orderBy("doc_id").collect()]


def test_boundaries_by_brute_force(spark):
    rng = random.Random(5)
    one = lambda: ("{M0}", "math") if rng.random() < 0.2 else ("".join(rng.choice("ab[]. 1,") for _ in range(rng.randint(1, 7))), rng.choice(["regular", "bold", "italic"]))
    many = [[one() for _ in range(rng.randint(1, 6))] for _ in range(400)]
    many += [[("a[b", "regular"), ("cd] e", "bold")], [("I", "bold"), (".1. x", "regular")], [("ab", "bold"), ("{M0}", "math"), ("cd", "bold")], [("x", "bold")]]
    got = boundaries(spark, many)
    assert got == [brute_boundaries(p) for p in many]
    assert got[-4:] == [[("a", "regular"), ("[bcd] e", "bold")], [("I.1.", "bold"), (" x", "regular")], [("ab", "bold"), ("{M0}", "math"), ("cd", "bold")], [("x", "bold")]]


def group(spark, *spans):
    """A group of (text, font, size, x0, y0, x1, y1, oy) spans."""
    return spark.createDataFrame([(1, 0, 0, 0, 0, list(spans))], f"doc_id long, page_idx int, block_no int, line_no int, run int, spans array<{SPAN}>")


def test_stacked_and_bars(spark):
    two = [("a", "CMMI10", 7.0, 10.0, 90.0, 20.0, 100.0, 100.0), ("b", "CMMI10", 7.0, 10.0, 102.0, 20.0, 112.0, 110.0)]
    g = group(spark, *two)
    assert layout.stacked_pairs(g).count() == 1
    bar = layout.fraction_bars(g).first()
    assert (bar.bar_y, bar.dx0, bar.dx1) == (101.0, 0.0, 3.5)
    assert layout.placed_groups(g).first()["width"] == 3.5 + 1.5
    base = ("c", "CMMI10", 10.0, 0.0, 90.0, 9.0, 100.0, 100.0)
    assert layout.stacked_pairs(group(spark, *two, base)).count() == 0


def test_attached(spark):
    letter = ("C", "rsfs10", 10.0, 0.0, 0.0, 8.0, 10.0, 8.0)
    more = [(" ", "CMR10", 10.0, 8.0, 0.0, 9.0, 10.0, 8.0), ("r", "CMMI7", 7.0, 9.0, -2.0, 12.0, 7.0, 6.0), ("x", "CMMI10", 10.0, 12.0, 0.0, 17.0, 10.0, 8.0), ("y", "CMMI7", 7.0, 8.0, 0.0, 17.0, 10.0, 8.0)]
    g = group(spark, letter, *more)
    assert sorted(r.pos for r in layout.attached_scripts(g).collect()) == [1, 2]
    marks = {m.pos: m for m in layout.placed_groups(g).first()["marks"]}
    assert sorted(marks) == [0, 3, 4] and (marks[0].route, marks[0].width, marks[3].dx) == ("copy", 12.0, 12.0)
    assert tuple(marks[0].box) == (-1.5, -4.5, 13.5, 11.5)  # the letter and its script, padded


def test_metrics(spark):
    table = spark.createDataFrame([("regular", "a", 0.25), ("bold", "a", 0.75)], "style string, ch string, advance double")
    m = layout.Metrics(table)
    r = spark.createDataFrame([("aab",)], "t string").select(m.width(F.col("t"), F.lit(10.0)).alias("r"), m.width(F.col("t"), F.lit(10.0), "bold").alias("b"), layout.PLAIN.width(F.col("t"), F.lit(10.0)).alias("p")).first()
    assert tuple(r) == (10.0, 20.0, 15.0)
    with pytest.raises(ValueError, match="metrics"):
        layout.Metrics(table, most=1)
