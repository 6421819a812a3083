"""Link annotations: colours, extents, new rectangles, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distance in y of a search hit, characters of a searchable text, and distance in x of a link at its line's start.
NEAR_Y, SEARCH_CHARS, AT_START = 15, 20, 5
_RGB = "/C\\s*\\[\\s*([0-9.]+)\\s+([0-9.]+)\\s+([0-9.]+)\\s*\\]"


def from_pages(pages: DataFrame) -> DataFrame:
    """Links of web pages as annotations, with rectangles by arithmetic: doc_id, page_idx, link_idx, box, raw, text."""
    found = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)
    l = pages.filter(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("link_idx", "text"))
    i = F.col("link_idx")
    raw = F.when(i % 3 == 0, "<< /C [0.0 0.5 1.0] /W 1 >>").when(i % 3 == 1, "<< /Subtype /Link >>").otherwise("<< /C [ 1 0 0 ] /W 0 >>")
    x0, y0 = (72 + 48 * (i % 8)).cast("double"), (72 + 18 * F.floor(i / 8)).cast("double")
    return l.select("doc_id", F.lit(0).alias("page_idx"), "link_idx", x0.alias("x0"), y0.alias("y0"), (x0 + 5 * F.length("text")).alias("x1"), (y0 + 10).alias("y1"), raw.alias("raw"), "text")


def key(c: str) -> Column:
    """A coordinate as part of a link's key."""
    return F.bround(F.col(c), 1)


def colours(links: DataFrame) -> DataFrame:
    """Saved colours by link key (red without one); of links with one key, the last."""
    part = lambda k: F.regexp_extract("raw", _RGB, k)
    r, g, b = (F.when(part(1) != "", part(k).cast("double")).otherwise(F.lit(1.0 if k == 1 else 0.0)) for k in (1, 2, 3))
    s = links.select("doc_id", "page_idx", key("x0").alias("kx"), key("y0").alias("ky"), "link_idx", F.struct(r.alias("r"), g.alias("g"), b.alias("b")).alias("c"))
    return s.groupBy("doc_id", "page_idx", "kx", "ky").agg(F.max_by("c", "link_idx").alias("c")).select("doc_id", "page_idx", "kx", "ky", "c.*")


def fixed_borders(links: DataFrame, saved: DataFrame) -> DataFrame:
    """Links with the colour they are to get, and whether a colour or a width has to be set."""
    keyed = links.withColumn("kx", key("x0")).withColumn("ky", key("y0"))
    out = keyed.join(saved, ["doc_id", "page_idx", "kx", "ky"], "left")
    return out.select(
        "doc_id", "page_idx", "link_idx", F.coalesce("r", F.lit(1.0)).alias("r"), F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("b", F.lit(0.0)).alias("b"),
        (~F.col("raw").contains("/C ")).alias("set_colour"), F.col("raw").contains("/W 0").alias("set_width"),
    )


def with_extents(links: DataFrame, extents: DataFrame) -> DataFrame:
    """Links with the extent of their line: at their rounded middle, else one below, else one above; null without.

    ``extents`` (doc_id, page_idx, y, ord, orig_x0, orig_x1, new_x0, text_end); of those at one y, the last counts.
    """
    last = extents.groupBy("doc_id", "page_idx", "y").agg(F.max_by(F.struct("orig_x0", "orig_x1", "new_x0", "text_end"), "ord").alias("e"))
    mid = F.bround((F.col("y0") + F.col("y1")) / 2, 0).cast("int")
    probes = links.select("doc_id", "page_idx", "link_idx", F.posexplode(F.array(mid, mid + 1, mid - 1)).alias("prio", "y"))
    hit = probes.join(last, ["doc_id", "page_idx", "y"]).groupBy("doc_id", "page_idx", "link_idx").agg(F.min_by("e", "prio").alias("e"))
    return links.join(hit, ["doc_id", "page_idx", "link_idx"], "left").select(*links.columns, "e.*")


def searched(links: DataFrame, hits: DataFrame) -> DataFrame:
    """Of the places where a link's text stands (doc_id, page_idx, text, hit_no, hx0, hx1, hy0), the nearest on about its line."""
    far = F.abs(F.col("hx0") - F.col("x0")) + F.abs(F.col("hy0") - F.col("y0"))
    near = links.filter(F.length("text") > 0).join(hits, ["doc_id", "page_idx", "text"]).filter(F.abs(F.col("hy0") - F.col("y0")) <= NEAR_Y)
    return near.groupBy("doc_id", "page_idx", "link_idx").agg(F.min_by(F.struct("hx0", "hx1"), F.struct(far, "hit_no")).alias("h")).select("doc_id", "page_idx", "link_idx", "h.*")


def repositioned(links: DataFrame, extents: DataFrame, hits: DataFrame, height: float) -> DataFrame:
    """New rectangles, in the file's upward y: by search for short inline links, else from the line's start, else in proportion."""
    l = with_extents(links, extents).filter("orig_x1 > orig_x0").join(searched(links, hits), ["doc_id", "page_idx", "link_idx"], "left")
    inline = F.abs(F.col("x0") - F.col("orig_x0")) >= AT_START
    found = inline & F.col("hx0").isNotNull() & (F.length("text") <= SEARCH_CHARS)
    ratio = (F.col("text_end") - F.col("new_x0")) / (F.col("orig_x1") - F.col("orig_x0"))
    scaled = lambda c: F.col("new_x0") + (F.col(c) - F.col("orig_x0")) * ratio
    a = F.when(found, F.col("hx0") - 0.5).when(~inline, F.col("new_x0")).otherwise(scaled("x0"))
    b = F.when(found, F.col("hx1") + 0.5).when(~inline, F.col("text_end")).otherwise(scaled("x1"))
    box = F.format_string("[%.3f %.3f %.3f %.3f]", a, height - F.col("y1"), b, height - F.col("y0"))
    return l.select("doc_id", "page_idx", "link_idx", box.alias("rect"))


def lost(links: DataFrame, surviving: DataFrame) -> DataFrame:
    """Links whose key did not survive, to be put back."""
    mark = lambda d: d.withColumn("kx", key("x0")).withColumn("ky", key("y0"))
    keys = mark(surviving).select("doc_id", "page_idx", "kx", "ky")
    return mark(links).join(keys, ["doc_id", "page_idx", "kx", "ky"], "left_anti").drop("kx", "ky")


def under(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Text under each link's rectangle: spans of its page that meet it, in order; none if blank."""
    s = spans.select("doc_id", "page_idx", F.col("text").alias("t"), F.col("x0").alias("sx0"), F.col("x1").alias("sx1"), F.col("y0").alias("sy0"), F.col("y1").alias("sy1"), "block_no", "raw_no", "span_no")
    meets = (F.col("sx0") < F.col("x1")) & (F.col("sx1") > F.col("x0")) & (F.col("sy0") < F.col("y1")) & (F.col("sy1") > F.col("y0"))
    rows = F.array_sort(F.collect_list(F.struct("block_no", "raw_no", "span_no", "t")))
    out = links.drop("text").join(s, ["doc_id", "page_idx"]).filter(meets).groupBy("doc_id", "page_idx", "link_idx").agg(F.array_join(F.transform(rows, lambda r: r.t), "").alias("text"))
    out = out.withColumn("text", F.regexp_replace("text", "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", ""))
    return out.filter("text <> ''")


