"""The whole way of a document: blocks, lines, paragraphs, translation, lines again, layout, links."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import layout, lines, links, paragraphs, translate
from spanloom.operators.lines import KEY
from spanloom.sources import readers, sinks


@dataclass
class Engine:
    """Parameters of a run. Without a backend, the offline lexicon translates inside the JVM; without a cache path a run keeps its translations only as long as it lasts."""

    spark: SparkSession
    source: str = "fr"
    target: str = "en"
    backend: translate.Backend | None = None
    cache_path: str | None = None
    metrics: layout.Metrics = layout.PLAIN
    send: dict = field(default_factory=dict)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written to the shared folder and read again: several steps use it, and a fold or a service's call is not repeated."""
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            folder = self.spark.conf.get("spark.checkpoint.dir", None)
            if not folder and not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanloom-"))
        return df.checkpoint()

    def lines(self, blocks: DataFrame) -> DataFrame:
        """Lines that are translated, of the blocks that are not English already."""
        return lines.lines(lines.foreign(blocks))

    def raw(self, merged: DataFrame) -> DataFrame:
        """Paragraphs with their raw translation; new ones are written first and read from there."""
        if self.backend is None:
            return merged.withColumn("raw", translate.lexicon(F.col("wire_text")))
        known = readers.cache(self.spark, self.cache_path) if self.cache_path else self.spark.createDataFrame([], translate.CACHE)
        keyed = merged.withColumn("key", translate.key(F.col("wire_text"), self.source, self.target))
        fresh = translate.fresh(keyed, known, self.backend, self.source, self.target, **self.send)
        # a call to a service must not run again when a result is used twice: what it gave is written, then read
        if self.cache_path:
            sinks.save_cache(fresh, self.cache_path)
            kept = readers.cache(self.spark, self.cache_path)
        else:
            kept = self.cut(fresh).filter("status = 'ok'")
        return keyed.join(kept.select("key", "raw"), "key", "left").withColumn("raw", F.coalesce("raw", "wire_text"))

    def translations(self, blocks: DataFrame) -> DataFrame:
        """Lines with their translation."""
        own = self.cut(self.lines(blocks).drop("spans"))
        grouped = paragraphs.grouped(own)
        done = self.raw(paragraphs.merged(grouped)).select("doc_id", "group_id", text.unmask(F.col("raw")).alias("translated"))
        return grouped.join(paragraphs.split_back(grouped, done).drop("seq"), list(KEY))

    def changed(self, blocks: DataFrame) -> DataFrame:
        """Lines that the translation changes, with their styled pieces."""
        done = self.translations(blocks).filter(text.strip(F.col("translated")) != text.strip(lines.group_text()))
        return self.cut(layout.mapped(done))

    def layout(self, blocks: DataFrame) -> DataFrame:
        """All that is drawn for the changed lines, see ``layout.rendered``."""
        return self.drawn(self.changed(blocks))

    def drawn(self, changed: DataFrame) -> DataFrame:
        """``layout`` of lines from ``changed``."""
        return layout.rendered(changed, self.metrics)

    def links(self, blocks: DataFrame, annotations: DataFrame, height: float) -> DataFrame:
        """New rectangles of link annotations (doc_id, page_idx, link_idx, box, raw, text): by search in what is drawn, by their line's extent otherwise."""
        own = self.changed(blocks)
        items = self.cut(self.drawn(own))
        wanted = annotations.filter(F.length("text") <= links.SEARCH_CHARS)
        return links.repositioned(annotations, layout.extents(own, items), layout.phrases(items, wanted, self.metrics), height)

    def counters(self, blocks: DataFrame) -> DataFrame:
        """(lines, pages, groups, cached, to_send): what a run is about to do."""
        grouped = paragraphs.grouped(self.lines(blocks))
        merged = paragraphs.merged(grouped)
        known = readers.cache(self.spark, self.cache_path) if self.cache_path else self.spark.createDataFrame([], translate.CACHE)
        hit = translate.probe(merged, known, self.source, self.target)[0].agg(F.count(F.lit(1)).alias("cached"))
        n = grouped.agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id", "page_idx").alias("pages"), F.countDistinct("doc_id", "group_id").alias("groups"))
        return n.join(F.broadcast(hit)).withColumn("to_send", F.col("groups") - F.col("cached"))

