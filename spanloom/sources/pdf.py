"""Typeset files through a parser: bytes in a column (``parsed``), or paths as a data source (``spark.read.format("pdf_spans")``).

``parsed`` takes files from any file system that Spark reads (``readers.uploads``) and parses them in the executors. The data source
lists and opens paths that the driver and all executors see.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.sources.readers import PAGES

COLUMNS = "path string, page_idx int, block_no int, line_seq int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, ox double, oy double"

#: Bytes of a file to its pages (dictionaries in the shape of ``readers.PAGES``); raises for what is no such file.
Parser = Callable[[bytes], Iterable[dict]]


def _package():
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading typeset files takes the pymupdf package, which is not installed; another parser can be given") from e
    return pymupdf


def _box(b: Iterable[float]) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True))


def _page(page, objects: Callable[[int], str]) -> dict:
    """One page of the package's as a dictionary."""
    span = lambda s: {"text": s["text"], "font": s["font"], "size": float(s["size"]), "bbox": _box(s["bbox"]), "origin": dict(zip("xy", map(float, s["origin"]), strict=True))}
    blocks = [{"type": b["type"], "lines": [{"bbox": _box(n["bbox"]), "spans": [span(s) for s in n["spans"]]} for n in b.get("lines", ())]} for b in page.get_text("dict")["blocks"]]
    links = [{"xref": a["xref"], "bbox": _box(a["from"]), "raw": objects(a["xref"]) if a["xref"] else ""} for a in page.get_links()]
    return {"width": float(page.rect.width), "height": float(page.rect.height), "blocks": blocks, "links": links}


def installed(content: bytes) -> Iterator[dict]:
    """Pages by the installed package."""
    with _package().open(stream=content, filetype="pdf") as doc:
        for page in doc:
            yield _page(page, doc.xref_object)


def parsed(files: DataFrame, parse: Parser = installed) -> DataFrame:
    """(doc_id, path, pages, error) of files (path, content); nested documents, as ``readers.blocks_of`` takes them.

    ``doc_id`` is a hash of the path. A file that does not parse has null pages and says why. A missing package fails the query.
    A batch is a task's files at most, which the binary reader bounds by ``spark.sql.files.maxPartitionBytes`` or one larger file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parse is installed:
            _package()
        for batch in batches:
            for k in range(batch.num_rows):  # a file's pages leave before the next one is parsed
                pages = error = None
                try:
                    pages = json.dumps(list(parse(batch.column(2)[k].as_py() or b"")))
                except Exception as e:  # whatever a parser makes of a broken file is that file's result
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], pa.array([pages], pa.string()), pa.array([error], pa.string())], names=["doc_id", "path", "json", "error"])

    named = files.select(F.xxhash64("path").alias("doc_id"), "path", "content")
    return named.mapInArrow(run, "doc_id long, path string, json string, error string").select("doc_id", "path", F.from_json("json", PAGES).alias("pages"), "error")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SpanReader(DataSourceReader):
    """One file is one partition; a page's spans are yielded as they are parsed."""

    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(options["path"]))

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        with _package().open(partition.path) as doc:
            for p, page in enumerate(doc):
                for b, block in enumerate(page.get_text("dict")["blocks"]):
                    for n, line in enumerate(block["lines"] if block["type"] == 0 else ()):
                        for k, s in enumerate(line["spans"]):
                            yield partition.path, p, b, n, k, s["text"], s["font"], float(s["size"]), *map(float, s["bbox"]), *map(float, s["origin"])


class PdfSpans(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_spans"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> SpanReader:
        return SpanReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSpans)
