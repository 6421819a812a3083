"""Readers: uploaded files, nested pages, caches, font metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.jobs import UPLOAD
from spanloom.operators.translate import CACHE

#: Nested pages as a parser of typeset files gives them.
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = f"struct<text:string,font:string,size:double,bbox:{BOX},origin:struct<x:double,y:double>>"
PAGES = f"""array<struct<width:double,height:double,
blocks:array<struct<type:int,lines:array<struct<bbox:{BOX},spans:array<{SPAN}>>>>>,
links:array<struct<xref:int,bbox:{BOX},raw:string>>>>"""
NESTED = f"doc_id long, pages {PAGES}"
METRICS = "style string, ch string, advance double"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a landing folder that may be worked on: their suffix and size are checked before their bytes are read on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".pdf") & (F.col("length") <= UPLOAD))


def nested(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents from JSON lines or Parquet, by the path's ending."""
    return spark.read.schema(NESTED).json(path) if path.rstrip("/").endswith(".json") else spark.read.schema(NESTED).parquet(path)


def blocks(docs: DataFrame) -> DataFrame:
    """Pages and their text blocks; blocks of another type go before their lines are touched."""
    pages = docs.select("doc_id", F.posexplode("pages").alias("page_idx", "page"))
    out = pages.select("doc_id", "page_idx", F.col("page.width").alias("width"), F.col("page.height").alias("height"), F.posexplode("page.blocks").alias("block_no", "block"))
    return out.filter("block.type = 0")


def blocks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_no, raws): text blocks of nested documents, their raw lines in order with the parser's boxes."""
    span = lambda s: F.struct(s.text.alias("text"), s.font.alias("font"), *(c.cast("double").alias(n) for c, n in ((s["size"], "size"), (s.bbox.x0, "x0"), (s.bbox.y0, "y0"), (s.bbox.x1, "x1"), (s.bbox.y1, "y1"), (s.origin.y, "oy"))))
    line = lambda l, k: F.struct(k.alias("raw_no"), F.transform(l.spans, span).alias("spans"), l.bbox.x0.alias("x0"), l.bbox.y0.alias("y0"), l.bbox.x1.alias("x1"), l.bbox.y1.alias("y1"))
    return blocks(docs).select("doc_id", "page_idx", "block_no", F.transform("block.lines", line).alias("raws"))


def link_annotations(docs: DataFrame) -> DataFrame:
    """Links of nested documents that have an object of their own."""
    pages = docs.select("doc_id", F.posexplode("pages").alias("page_idx", "page"))
    l = pages.select("doc_id", "page_idx", F.posexplode("page.links").alias("link_idx", "l")).filter(F.coalesce("l.xref", F.lit(0)) != 0)
    return l.select("doc_id", "page_idx", "link_idx", "l.bbox.x0", "l.bbox.y0", "l.bbox.x1", "l.bbox.y1", "l.raw", F.lit("").alias("text"))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """Translations kept by earlier runs, one row a key (a success before a failure); empty where there are none yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)
    best = F.max_by(F.struct("source", "target", "raw", "status"), F.struct((F.col("status") == "ok").cast("int"), "raw"))
    return rows.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def json_cache(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """A flat JSON file of digests and translations as cache rows; empty where it is missing."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    return pairs.select("key", F.lit(source).alias("source"), F.lit(target).alias("target"), "raw", F.lit("ok").alias("status"))


def font_metrics(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Advances in em by style and character; empty (all default) without a path."""
    return spark.read.schema(METRICS).parquet(path) if path else spark.createDataFrame([], METRICS)
