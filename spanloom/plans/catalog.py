"""The library's registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import charmaps, fonts, text
from spanloom.operators import jobs, layout, lines, links, paragraphs, rowwise, translate
from spanloom.operators.lines import KEY
from spanloom.plans import oracle
from spanloom.sources import lift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _column(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*KEY, *names)


@query
def span_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, style and family of every span's font."""
    s = lines.raw_spans(lift.lift(spark, sf_dir))
    return s.select(*lines.BLOCK, "raw_no", "span_no", "is_text", fonts.style(F.col("font")).alias("style"), fonts.family(F.col("font")).alias("family"))


@query
def english_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's text without separators, and whether its words mark it as English."""
    return lines.english(lift.lift(spark, sf_dir))


@query
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their mathematics masked by placeholders."""
    return _column(_lines(spark, sf_dir), "template", "n_math")


@query
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one style over the text of a line."""
    return _lines(spark, sf_dir).select(*KEY, F.posexplode("runs").alias("run_idx", "r")).select(*KEY, "run_idx", "r.n", "r.style")


@query
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the style of most characters of a line."""
    return _column(_lines(spark, sf_dir), "font_style")


@query
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5, P6, P7 over raw lines."""
    b = lift.lift(spark, sf_dir).select(*lines.BLOCK, F.explode("raws").alias("r"))
    said = F.array_join(F.transform("r.spans", lambda s: s.text), "")
    b = b.select(*lines.BLOCK, "r.raw_no", said.alias("t"), F.exists("r.spans", lambda s: fonts.is_text(s.font)).alias("has_text"))
    t = F.col("t")
    return b.select(*lines.BLOCK, "raw_no", text.is_page_number(t).alias("is_page_number"), (~F.col("has_text")).alias("no_text"), text.is_numeric_only(t).alias("numeric_only"), text.is_toc(t).alias("is_toc"))


@query
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lines parted into words and page number, one that stands apart too; their box reaches to it."""
    return _column(_lines(spark, sf_dir).filter("is_toc"), "toc_content", "toc_page_num", "x1")


@query
def core_y_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core range of y of raw lines; tall symbols do not count unless alone."""
    return lines.fragments(lift.lift(spark, sf_dir)).select(*lines.BLOCK, "raw_no", "c0", "c1", "mean_oy", "tall")


@query
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of lines."""
    return _column(_lines(spark, sf_dir).filter("NOT is_toc"), "x0", "y0", "x1", "y1")


@query
def merge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by gaps in x, and which may become one line."""
    return lines.verdicts(lift.lift(spark, sf_dir)).select(*lines.BLOCK, "y_group", "cluster", F.array_join(F.transform("raws", lambda r: r.cast("string")), ",").alias("raws"), "n_members", "n_margin", "merged")


@query
def y_overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y-groups of a block's raw lines, and the line each ends up in."""
    return lines.places(lift.lift(spark, sf_dir))


@query
def attach_math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of mathematics alone, and the line each is attached to, one after the other."""
    return lines.attached(lift.lift(spark, sf_dir))


@query
def math_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's runs of mathematics, what was attached first."""
    return layout.group_spans(layout.math_groups(_lines(spark, sf_dir))).select(*layout.GROUP, "pos", "text", "x0", "oy")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(lift.lift(spark, sf_dir))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.merged(paragraphs.grouped(_lines(spark, sf_dir)))


@query
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in groups."""
    return _column(paragraphs.grouped(_lines(spark, sf_dir)), "seq", "group_id", "mergeable")


@query
def paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's text as it is sent; of contents entries, their words. The flagship query."""
    return _paragraphs(spark, sf_dir).select("doc_id", "group_id", "n_lines", F.length("template").alias("n_chars"), "wire_text")


@query
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of lines masked."""
    return _lines(spark, sf_dir).select(*KEY, text.mask(F.col("template")).alias("wire_text"))


@query
def unmask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked lines, their marks in small letters and with blanks added, back to placeholders."""
    noisy = F.regexp_replace(text.mask(F.col("template")), "XXXM([0-9]+)XXX", "  xxxm$1xxx  ")
    return _lines(spark, sf_dir).filter("n_math > 0").select(*KEY, text.unmask(noisy).alias("t"))


@query
def term_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered replacements, on each document's beginning with two wrong terms added."""
    wrong = F.array(*(F.lit(a) for a, _ in text.TERM_FIXES))
    pick = lambda k: F.get(wrong, ((F.col("doc_id") * k) % len(text.TERM_FIXES)).cast("int"))
    docs = lift.documents(spark, sf_dir).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return docs.select("doc_id", text.fix_terms(F.concat(pick(1), F.lit(" "), F.col("text"), F.lit(" "), pick(7))).alias("t"))


@query
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of paragraphs."""
    return paragraphs.batches(_paragraphs(spark, sf_dir))


def _cache(paras: DataFrame) -> DataFrame:
    """A cache that earlier runs might have left: paragraphs of every third document, marked; a few of them failed."""
    known = paras.filter("doc_id % 3 = 0").groupBy(translate.key(F.col("wire_text"), "fr", "en").alias("key")).agg(F.max("wire_text").alias("t"), F.max("doc_id").alias("d"))
    return known.select("key", F.lit("fr").alias("source"), F.lit("en").alias("target"), F.concat(F.lit("~"), F.col("t")).alias("raw"), F.when(F.col("d") % 7 == 0, "failed").otherwise("ok").alias("status"))


@query
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that the cache holds."""
    p = _paragraphs(spark, sf_dir)
    return translate.probe(p, _cache(p), "fr", "en")[0].select("doc_id", "group_id", "key", "raw")


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that it does not hold."""
    p = _paragraphs(spark, sf_dir)
    return translate.probe(p, _cache(p), "fr", "en")[1].select("doc_id", "group_id", "key")


@query
def lexicon_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs through the offline lexicon."""
    return _paragraphs(spark, sf_dir).select("doc_id", "group_id", translate.lexicon(F.col("wire_text")).alias("raw"))


@query
def split_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paragraphs' translations split back to their lines."""
    return rowwise.split_translation(lift.documents(spark, sf_dir))


@query
def changed_lines_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a page a translation changes."""
    changed = text.strip(translate.lexicon(lines.group_text())) != text.strip(lines.group_text())
    return _lines(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.count_if(changed).alias("n_changed"), F.count(F.lit(1)).alias("n_lines"))


def _math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.raw_spans(lift.lift(spark, sf_dir)).filter("NOT is_text")


@query
def math_char_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of mathematics, and of its words' letters, by every family's table."""
    m = layout.routed(_math(spark, sf_dir))
    return m.select(*lines.BLOCK, "raw_no", "span_no", "family", charmaps.map_text(F.col("text"), F.col("family")).alias("mapped"), charmaps.map_text(F.col("text"), F.lit("CMBX")).alias("bold"), charmaps.map_text(F.col("text"), F.lit("EUFM")).alias("fraktur"))


@query
def render_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How spans of mathematics are drawn."""
    return layout.routed(_math(spark, sf_dir)).select(*lines.BLOCK, "raw_no", "span_no", "route")


@query
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs of text and placeholders."""
    return layout.segment_rows(_lines(spark, sf_dir)).select(*KEY, "seg_no", "kind", "seg")


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines translated one by one, without their spans."""
    return _lines(spark, sf_dir).drop("spans").withColumn("translated", translate.lexicon(lines.group_text()))


@query
def style_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original's styles on the translation."""
    return layout.style_map(_translated(spark, sf_dir))


@query
def style_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style borders moved off brackets and labels."""
    return layout.style_boundaries(_translated(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of mathematics of the lines, and for each document a group of every kind that prose has none of: a fraction, a letter with scripts, both, an empty span."""
    own = layout.math_groups(_lines(spark, sf_dir))
    d = (F.col("doc_id") % 5).cast("double")
    made = lift.documents(spark, sf_dir).filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lit(0).alias("page_idx"), F.lit(-2).alias("block_no"), F.lit(0).alias("line_no"))
    box = lambda t, font, size, x0, y0, w, h: F.struct(F.lit(t).alias("text"), F.lit(f"ABCDEF+{font}").alias("font"), F.lit(float(size)).alias("size"), *((c).cast("double").alias(n) for c, n in ((F.lit(x0) + d, "x0"), (F.lit(y0), "y0"), (F.lit(x0 + w) + d, "x1"), (F.lit(y0 + h), "y1"), (F.lit(y0 + h - 2), "oy"))))
    fraction = F.array(box("a", "CMMI10", 10, 100, 100, 8, 10), box("n", "CMMI7", 7, 120, 94, 6, 7), box("2", "CMR7", 7, 120, 106, 6, 7), box("b", "CMMI10", 10, 150, 100, 8, 10))
    scripts = F.array(box("C", "rsfs10", 10, 100, 100, 8, 10), box("r", "CMMI7", 7, 108, 97, 4, 7), box(" ", "CMR10", 10, 112, 100, 3, 10), box("x", "CMMI10", 10, 130, 100, 8, 10))
    mixed = F.array(box("g", "EUFM10", 10, 80, 100, 8, 10), box("s", "CMSY7", 7, 89, 97, 4, 7), box("h", "CMMI10", 10, 110, 88, 9, 10), box("q", "CMMI10", 10, 110, 104, 9, 10), box("-", "CMSY10", 10, 140, 100, 0.25, 10), box("P", "CMEX10", 10, 150, 95, 12, 20), box("u", "CMMI7", 7, 170, 94, 5, 7), box("w", "CMMI7", 7, 170, 106, 5, 7))
    none = F.array(box("S", "CMEX10", 10, 100, 100, 6, 10), box("i", "CMMI7", 7, 106, 92, 4, 7), box("k", "CMMI7", 7, 106, 104, 4, 7))
    return own.unionByName(made.select(*KEY, F.posexplode(F.array(fraction, scripts, mixed, none)).alias("run", "spans")))


@query
def stacked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that stand over each other."""
    return layout.stacked_pairs(_groups(spark, sf_dir))


@query
def attached_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that belong to the letter before them."""
    return layout.attached_scripts(_groups(spark, sf_dir))


@query
def group_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a group's spans stand, and the boxes that copies are cut from."""
    return layout.placed_groups(_groups(spark, sf_dir)).select(*layout.GROUP, F.explode("marks").alias("m")).select(*layout.GROUP, "m.pos", "m.route", "m.drawn", "m.dx", "m.width", F.col("m.box.x0").alias("box_x0"), F.col("m.box.y0").alias("box_y0"), F.col("m.box.x1").alias("box_x1"), F.col("m.box.y1").alias("box_y1"))


@query
def fraction_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of stacked groups."""
    return layout.fraction_bars(_groups(spark, sf_dir))


@query
def pen_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each segment of a line begins."""
    own = _lines(spark, sf_dir).drop("spans")
    return layout.pen_advance(own, layout.math_groups(own))


@query
def whiteout_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to clear."""
    return layout.whiteout(_lines(spark, sf_dir), lift.PAGE_WIDTH)


@query
def font_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and baseline of a line, from its first span of visible text."""
    return _column(_lines(spark, sf_dir), "font_size", "baseline")


@query
def toc_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots of contents lines."""
    return layout.toc_leaders(_lines(spark, sf_dir).withColumn("x1", F.greatest("x1", F.lit(500.0))))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def _extents(l: DataFrame) -> DataFrame:
    """Extents of the rows that links stand in; some a row off, some missing."""
    row = l.select("doc_id", "page_idx", F.col("y0")).distinct()
    y = (F.col("y0") + 5).cast("int") + F.element_at(F.array(*map(F.lit, (0, 1, -1, 3))), (F.col("doc_id") % 4 + 1).cast("int"))
    return row.select("doc_id", "page_idx", y.alias("y"), F.lit(0).alias("ord"), F.lit(72.0).alias("orig_x0"), F.lit(472.0).alias("orig_x1"), F.lit(72.0).alias("new_x0"), F.lit(372.0).alias("text_end"))


@query
def link_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and borders of links."""
    l = _links(spark, sf_dir)
    return links.fixed_borders(l, links.colours(l))


@query
def link_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of links' lines."""
    l = _links(spark, sf_dir)
    return links.with_extents(l, _extents(l)).select("doc_id", "link_idx", "orig_x0", "text_end")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn text for the pages' links: one piece a row of links, of their texts, a mark between."""
    l = _links(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("link_idx", "text")))
    row = l.groupBy("doc_id", "page_idx", F.col("y0").alias("top")).agg(F.array_join(F.transform(rows, lambda r: r.text), " ; ").alias("piece"))
    return row.select("doc_id", "page_idx", F.lit(0).alias("block_no"), F.col("top").cast("int").alias("line_no"), F.lit(0).alias("item_no"), F.lit("text").alias("kind"), "piece", F.lit("regular").alias("style"), F.lit(80.0).alias("x"), (F.col("top") + 8).alias("y"), F.lit(10.0).alias("size"))


@query
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of the places where links' texts stand in what is drawn."""
    hits = layout.phrases(_pieces(spark, sf_dir), _links(spark, sf_dir).filter(F.length("text") <= links.SEARCH_CHARS))
    return hits.select("doc_id", "page_idx", "text", F.col("hit_no.line_no").alias("line_no"), F.col("hit_no.n").alias("n"), "hx0", "hx1", "hy0")


@query
def link_reposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rectangles of links, by search in what is drawn or by their line's extent."""
    l = _links(spark, sf_dir)
    hits = layout.phrases(_pieces(spark, sf_dir), l.filter(F.length("text") <= links.SEARCH_CHARS))
    return links.repositioned(l, _extents(l), hits, lift.PAGE_HEIGHT).select("doc_id", "link_idx", "rect")


@query
def links_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to put back."""
    l = _links(spark, sf_dir)
    return links.lost(l, l.filter("link_idx % 4 <> 0")).select("doc_id", "link_idx", "text")


@query
def text_under_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the document of the same id under each link's rectangle."""
    return links.under(_links(spark, sf_dir), lines.raw_spans(lift.lift(spark, sf_dir)).filter("block_no >= 0")).select("doc_id", "link_idx", "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")


@query
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state and progress of every job."""
    return jobs.latest(jobs.log(_events(spark, sf_dir)))


@query
def job_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs past their time on the second of January."""
    return jobs.expired(jobs.latest(jobs.log(_events(spark, sf_dir))), F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")).select("job_id", "status")


@query
def job_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: admission of submissions."""
    return jobs.admission(_events(spark, sf_dir), ttl=86_400)


@query
def job_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to downloads of known and unknown jobs."""
    e = _events(spark, sf_dir)
    asked = e.select((F.col("user_id") + F.col("event_id") % 2 * 1_000_000).alias("job_id")).distinct()
    return jobs.download(jobs.latest(jobs.log(e)), asked)


@query
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of uploads and names of results."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    name = F.concat(F.regexp_extract("url", "([^/?#]*)[^/]*$", 1), F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(""))
    return p.select("page_id", jobs.acceptable(name, F.octet_length("html")).alias("refused"), jobs.output_name(name).alias("served_name"), jobs.output_name(name, "en").alias("file_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
