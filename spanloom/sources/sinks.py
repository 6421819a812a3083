"""Sinks: caches, layout rows, documents as bytes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_cache(fresh: DataFrame, path: str) -> None:
    """Adds new rows to a cache. Rows are keyed, so a task or run that is repeated adds what is already there, and readers see one row a key."""
    fresh.filter("status = 'ok'").write.mode("append").parquet(path)


def save_json_cache(rows: DataFrame, path: str) -> None:
    """Cache rows as JSON lines, characters outside ASCII kept."""
    rows.write.mode("overwrite").json(path)


def save_layout(rows: DataFrame, path: str) -> None:
    """Layout rows by document, compressed."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _code(t: str, known: dict[str, int]) -> bytes:
    """A text as a string of two-byte codes; each character gets the next code when it is first seen."""
    return b"<" + "".join(f"{known.setdefault(c, len(known) + 1):04X}" for c in t).encode() + b">"


def _unicode_map(known: dict[str, int]) -> bytes:
    """What the codes stand for, so that text can be searched and copied."""
    rows = [f"<{n:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, n in known.items()]
    parts = [f"{len(rows[k : k + 100])} beginbfchar\n" + "\n".join(rows[k : k + 100]) + "\nendbfchar\n" for k in range(0, len(rows), 100)]
    head = "/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange\n"
    return (head + "".join(parts) + "endcmap end end").encode()


def pdf_bytes(pages: list[list[tuple[float, float, float, str]]], width: float = 612.0, height: float = 792.0) -> bytes:
    """A plain PDF: for each page, texts (x, baseline from the top, size, text) in one composite font with a map to Unicode, which any character passes; streams deflated."""
    known: dict[str, int] = {}
    bodies = [b"".join(f"BT /F1 {size:g} Tf {x:.3f} {height - y:.3f} Td ".encode() + _code(t, known) + b" Tj ET\n" for x, y, size, t in texts) for texts in pages]
    kids = " ".join(f"{7 + 2 * k} 0 R" for k in range(len(pages)))

    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data)
        return f"<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream"

    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Spanloom /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Spanloom /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /FontDescriptor 6 0 R >>",
        stream(_unicode_map(known)),
        b"<< /Type /FontDescriptor /FontName /Spanloom /Flags 4 /FontBBox [0 -200 1000 800] /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 700 /StemV 80 >>",
    ]
    for k, body in enumerate(bodies):
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F1 3 0 R >> >> /Contents {8 + 2 * k} 0 R >>".encode())
        objects.append(stream(body))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def documents(layout: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """(doc_id, content): each document's layout rows (doc_id, page_idx, x, y, size, piece) as PDF bytes, on pages of one size; bars and copied glyphs are left out. A document is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pages: list[list[tuple[float, float, float, str]]] = [[] for _ in range(int(pdf["page_idx"].max()) + 1)]
        for r in pdf.sort_values(["page_idx", "y", "x"]).itertuples():
            pages[r.page_idx].append((r.x, r.y, r.size_, r.piece))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [pdf_bytes(pages, width, height)]})

    rows = layout.filter(F.col("piece") != "").filter("kind <> 'copy'").select("doc_id", "page_idx", "x", "y", F.col("size").alias("size_"), "piece")
    return rows.groupBy("doc_id").applyInPandas(run, "doc_id long, content binary")
