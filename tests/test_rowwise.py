"""The row-wise steps give what the expressions over nested columns give."""

import random

from pyspark.sql import functions as F

from spanloom.operators import lines, paragraphs, rowwise, translate
from spanloom.plans import catalog
from spanloom.sources import lift
from test_vectors import BLOCKS, raw

ODD = (
    "", " ", "\n\n", "a", "12 34\n.", "x = y + 2 for all", "le {M0} de {M12} la", "a\tb\rc\x0bd\fe", "été \U0001d400   b", "one . . . . 12\ntwo", "\n" * 40 + "end",
    "un mot " * 300 + "\n" + "de 3 la x1 y " * 200 + "\n" + "que " * 13, "3 4 5 6 7 8 9 a b c d e f g", "d " + "%" * 90 + " la", "x" * 500 + " 1",
)


def by_columns(docs):
    g = paragraphs.grouped(lines.lines(lift.blocks(docs)))
    t = paragraphs.merged(g).select("doc_id", "group_id", translate.lexicon(F.col("template")).alias("translated"))
    return paragraphs.split_back(g, t).select("doc_id", "seq", "translated")


def test_pages_as_blocks(spark):
    rows = [(d * 20 + k, t) for d in range(7) for k, t in enumerate(ODD)] + [(-d, ODD[5]) for d in range(1, 8)]
    got = {(r.doc_id, r.page_idx, r.block_no): [[tuple(s) for s in x.spans] for x in r.raws] for r in lift.blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(d, p, b): [list(zip(*spans, strict=True)) for spans in raws] for d, t in rows for p, b, raws in lift.pages(d, [t])} == got


def test_lines_of_random_blocks(spark):
    rng, blocks = random.Random(8), []
    kinds = ["A+SFRM1000"] * 4 + ["A+SFBX1000", "A+SFTI1000", "A+SFBI1000", "A+CMMI10", "A+CMMI10", "A+CMEX10", None]
    words = ["a ", "bb ", "ccc", " ", "12", ". . . . ", "7 ", "été ", "{M3} "]
    for d in range(400):
        raws = []
        for no in range(rng.randint(1, 12)):
            x, y, h = rng.choice([72, 75, 90, 140, 200, 260]) + rng.random() * 9, rng.choice([100, 101.3, 104, 107, 118]), rng.choice([5, 7, 10, 10, 24])
            spans = [(rng.choice(words), rng.choice(kinds), x + 9 * k, y - rng.choice([0, 0, 2]), x + 9 * k + rng.randint(3, 30), y + h) for k in range(rng.randint(1, 4))]
            raws.append(raw(no, *spans))
        blocks.append((d, 0, 0, raws))
    ok = ~F.col("is_toc") & (F.col("font_style") != "bold") & (F.col("first_size") <= 11) & (F.col("n_math") == 0)
    rows = lines.lines(spark.createDataFrame(blocks, BLOCKS)).select("doc_id", "line_no", lines.group_text().alias("own"), "n_math", "x0", "y0", "y1", "first_size", ok.alias("ok")).collect()
    own = [(d, n, l.own, l.n_math, l.x0, l.y0, l.y1, l.first_size, l.mergeable) for d, _, _, raws in blocks for n, l in rowwise.lines([tuple(zip(*r[1], strict=True)) for r in raws])]
    assert own == sorted(map(tuple, rows)) and len(own) > 1000


def test_split_of_odd_texts(spark):
    rows = [(d * 20 + k, t) for d in range(7) for k, t in enumerate(ODD)] + [(-3, ODD[11]), (None, "a b"), (999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, rowwise.split_translation(docs).collect()))
    assert got == sorted(map(tuple, by_columns(docs).collect())) and len(got) > 400


def test_rows_that_share_an_id(spark):
    """No line is lost: each row gives its entry and its lines, numbered through."""
    docs = spark.createDataFrame([(2, "la a\nb c"), (2, "d e\nf g\nh i"), (3, "un")], "doc_id long, text string")
    rows = rowwise.split_translation(docs).collect()
    assert sorted(r.seq for r in rows if r.doc_id == 2) == list(range(7)) and {"the a", "d e", "b c", "f g", "h i"} < {r.translated for r in rows}


def test_split_reads_documents_once(spark, sf_dir):
    """One pass: whole texts are read and dealt once. It was two passes over all spans, joined."""
    plan = catalog.queries()["split_translation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
