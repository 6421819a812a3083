"""Backends, caches, the engine, sources, sinks, links, jobs and streams."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.operators import jobs, lines, links, translate
from spanloom.plans.engine import Engine
from spanloom.sources import lift, readers, sinks
from spanloom.streaming import jobs as streams


def test_retry_then_result():
    waits, tries = [], []

    def backend(texts, source, target):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return [t.upper() for t in texts]

    assert translate.call(backend, ["a"], "fr", "en", waits.append) == (["A"], "ok")
    assert waits == [2.0, 4.0]


def test_failure_falls_back():
    def backend(texts, source, target):
        raise OSError

    assert translate.call(backend, ["a"], "fr", "en", lambda s: None) == (["a"], "failed")
    assert translate.call(lambda t, s, g: [None, "x"], ["a", "b"], "fr", "en", lambda s: None) == (["a", "x"], "ok")


def shout(texts, source, target):
    return [t.upper() for t in texts]


def quiet(seconds):
    return None


def test_engine_with_cache(spark, sf_dir, tmp_path):
    blocks = lift.blocks(lift.documents(spark, sf_dir).filter("doc_id < 12"))
    path = str(tmp_path / "cache")
    e = Engine(spark, backend=shout, cache_path=path, send={"sleep": quiet})
    key = lambda r: (r.doc_id, r.page_idx, r.block_no, r.line_no)
    first = {key(r): r.translated for r in e.translations(blocks).collect()}
    kept = readers.cache(spark, path)
    n = kept.count()
    assert n and kept.select("key").distinct().count() == n

    def broken(texts, source, target):
        raise AssertionError("a full cache must not call")

    again = Engine(spark, backend=broken, cache_path=path, send={"sleep": quiet})
    assert {key(r): r.translated for r in again.translations(blocks).collect()} == first
    c = again.counters(blocks).first()
    assert c.cached == c.groups and c.to_send == 0 and c.lines == len(first)
    other = Engine(spark, target="de", backend=shout, cache_path=path, send={"sleep": quiet})
    other.translations(blocks).count()
    assert readers.cache(spark, path).count() == 2 * n  # languages are part of the key


def test_a_text_is_sent_once(spark, sf_dir, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(texts, source, target):
        import uuid

        for t in texts:
            (calls / uuid.uuid4().hex).write_text(t)
        return [t.upper() for t in texts]

    blocks = lift.blocks(lift.documents(spark, sf_dir).filter("doc_id < 4"))
    assert Engine(spark, backend=counting, send={"sleep": quiet}).layout(blocks).count()
    sent = [f.read_text() for f in calls.iterdir()]
    assert sent and len(sent) == len(set(sent))


def test_layout_and_bytes(spark, sf_dir):
    out = Engine(spark).layout(lift.blocks(lift.documents(spark, sf_dir).filter("doc_id < 30")))
    rows = out.collect()
    assert rows and all(r.x >= 72 for r in rows) and {"text", "math"} <= {r.kind for r in rows}
    pdf = sinks.documents(out).first()["content"]
    assert bytes(pdf).startswith(b"%PDF-1.4") and bytes(pdf).rstrip().endswith(b"%%EOF")


def test_pdf_bytes():
    data = sinks.pdf_bytes([[(72.0, 80.0, 10.0, "a (é) ∑漢a"), (72.0, 90.0, 10.0, "𝑓")], []])
    unicode_map, body = (zlib.decompress(p.split(b"\nendstream")[0]) for p in data.split(b"stream\n")[1:6:2][:2])
    codes = dict(line[1:].split(b"> <") for line in unicode_map.split(b"\n") if line.startswith(b"<") and b"> <" in line)
    said = [b"".join(codes[t[k : k + 4]].rstrip(b">") for k in range(0, len(t), 4)) for t in (row.split(b"<")[1].split(b">")[0] for row in body.splitlines())]
    assert [bytes.fromhex(t.decode()).decode("utf-16-be") for t in said] == ["a (é) ∑漢a", "𝑓"] and b"/Count 2" in data


def test_nested_reader(spark, tmp_path):
    box = {"x0": 0.0, "y0": 0.0, "x1": 5.0, "y1": 10.0}
    span = {"text": "Soit", "font": "A+SFRM1000", "size": 10.0, "bbox": box, "origin": {"x": 0.0, "y": 8.0}}
    math = {**span, "text": "f", "font": "A+CMMI10"}
    page = {"width": 600.0, "height": 800.0, "blocks": [{"type": 0, "lines": [{"bbox": box, "spans": [span, math]}]}, {"type": 1, "lines": []}], "links": [{"xref": 3, "bbox": box, "raw": "/C [0 1 0]"}, {"xref": 0, "bbox": box, "raw": ""}]}
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"doc_id": 1, "pages": [page]}) + "\n")
    docs = readers.nested(spark, str(f))
    assert readers.blocks(docs).count() == 1
    got = lines.raw_spans(readers.blocks_of(docs)).orderBy("span_no").collect()
    assert [r.is_text for r in got] == [True, False] and got[0].oy == 8.0
    l = readers.link_annotations(docs)
    assert l.count() == 1 and links.colours(l).first()["g"] == 1.0


def test_engine_merges_raw_lines_of_parsed_pages(spark, tmp_path):
    def line(t, font, x0, y0, x1, y1):
        box = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
        return {"bbox": box, "spans": [{"text": t, "font": font, "size": 10.0, "bbox": box, "origin": {"x": x0, "y": y1 - 2}}]}

    first = [line("Soit la fonction ", "A+SFRM1000", 72.0, 100.0, 150.0, 110.0), line("f", "A+CMMI10", 151.0, 101.0, 156.0, 111.0), line("d", "A+CMMI7", 151.0, 91.0, 154.0, 96.0), line(" continue", "A+SFRM1000", 157.0, 100.0, 200.0, 110.0)]
    second = [line("Une autre ligne", "A+SFRM1000", 72.0, 200.0, 150.0, 210.0)]
    page = {"width": 600.0, "height": 800.0, "blocks": [{"type": 0, "lines": b} for b in (first, second)], "links": []}
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"doc_id": 1, "pages": [page]}) + "\n")
    blocks, e = readers.blocks_of(readers.nested(spark, str(f))), Engine(spark, backend=shout, send={"sleep": quiet})
    got = {r.template: r for r in e.lines(blocks).collect()}
    assert set(got) == {"Soit la fonction {M0} continue", "Une autre ligne"}
    assert [[s.text for s in g] for g in got["Soit la fonction {M0} continue"].groups] == [["d", "f"]]
    drawn = e.layout(blocks).collect()
    assert {r.piece.strip() for r in drawn if r.kind == "text"} == {"SOIT LA FONCTION", "CONTINUE", "UNE AUTRE LIGNE"}
    assert [r.piece for r in sorted(drawn, key=lambda r: (r.block_no, r.item_no)) if r.kind == "math"] == ["\U0001d451", "\U0001d453"]
    box = {"doc_id": 1, "page_idx": 0, "link_idx": 0, "x0": 110.0, "y0": 100.0, "x1": 130.0, "y1": 110.0, "raw": "", "text": "CONTINUE"}
    l = spark.createDataFrame([box], "doc_id long, page_idx int, link_idx int, x0 double, y0 double, x1 double, y1 double, raw string, text string")
    # "SOIT LA FONCTION " is 17 half ems, a small letter over a large one 5 and the gap of a stack, a blank before the word 5
    assert e.links(blocks, l, 800.0).first()["rect"] == "[%.3f %.3f %.3f %.3f]" % (72 + 85 + 6.5 + 5 - 0.5, 690, 72 + 85 + 6.5 + 5 + 40 + 0.5, 700)


def test_caches(spark, tmp_path):
    assert readers.cache(spark, str(tmp_path / "none")).count() == 0
    assert readers.json_cache(spark, str(tmp_path / "none.json"), "fr", "en").count() == 0
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"k1": "é", "k2": "b"}), encoding="utf-8")
    assert {(r.key, r.raw) for r in readers.json_cache(spark, str(f), "fr", "en").collect()} == {("k1", "é"), ("k2", "b")}


def test_uploads(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert readers.uploads(spark, str(tmp_path)).count() == 2


def test_pdf_source_names_what_is_missing(spark, tmp_path):
    pytest.importorskip("pyspark.sql.datasource")
    from spanloom.sources import pdf

    pdf.register(spark)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    df = spark.read.format("pdf_spans").load(str(tmp_path / "*.pdf"))
    assert "font" in df.columns
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="pymupdf"):
            df.collect()


def test_link_tolerance(spark):
    l = spark.createDataFrame([(1, 0, 0, 72.0, 94.6, 90.0, 104.6, "", "x")], "doc_id long, page_idx int, link_idx int, x0 double, y0 double, x1 double, y1 double, raw string, text string")
    e = spark.createDataFrame([(1, 0, 100, 0, 1.0, 2.0, 3.0, 4.0), (1, 0, 101, 0, 5.0, 6.0, 7.0, 8.0)], "doc_id long, page_idx int, y int, ord int, orig_x0 double, orig_x1 double, new_x0 double, text_end double")
    assert links.with_extents(l, e).first()["orig_x0"] == 1.0
    assert links.with_extents(l, e.filter("y = 101")).first()["orig_x0"] == 5.0


def test_names(spark):
    df = spark.createDataFrame([("a.b.pdf",)], "n string")
    r = df.select(jobs.output_name(F.col("n")).alias("a"), jobs.output_name(F.col("n"), "en").alias("b"), jobs.acceptable(F.lit("x.PDF"), F.lit(jobs.UPLOAD + 1)).alias("c"), jobs.acceptable(F.lit("x.doc"), F.lit(1)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("a.b-translated.pdf", "a.b-en.pdf", "size", "suffix")


def test_stream_states(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in"))
    q = streams.states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    live = {r.job_id: r for r in spark.table("states").filter("NOT expired").collect()}
    want = {r.job_id: r.status for r in jobs.latest(jobs.log(events)).collect()}
    assert {k: r.status for k, r in live.items()} == want


def test_stream_states_of_late_rows(spark, tmp_path):
    """A late row of a later batch counts as a step and dates the job back, but does not undo a newer state."""
    t = "2024-01-01 00:{:02d}:00".format
    rows = [[(1, t(5), 7, "signup"), (2, t(30), 7, "purchase")], [(3, t(10), 7, "click"), (4, t(1), 7, "view")]]
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "0D AS value", "'' AS props")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in"))
        seen = []
        q = streams.states(stream, ttl=86_400).writeStream.foreachBatch(lambda df, n, seen=seen: seen.extend(df.collect())).outputMode("update")
        run = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    last = [r for r in seen if not r.expired][-1]
    assert (last.status, last.total, last.steps) == ("done", 4, 2)


def test_admission_of_refused_submissions(spark):
    """A refused submission never counts; an end of it frees nothing; old jobs leave when the next one asks."""
    t = "2024-01-01 {:02d}:{:02d}:00".format
    log = [(1, t(0, 0), 8, "signup"), (2, t(0, 1), 16, "signup"), (3, t(0, 2), 24, "signup"), (4, t(0, 3), 24, "purchase"), (5, t(0, 4), 32, "signup"), (6, t(0, 5), 8, "error"), (7, t(0, 6), 40, "signup"), (8, t(3, 0), 48, "signup")]
    e = spark.createDataFrame(log, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type")
    got = {r.event_id: (r.n_active, r.admitted) for r in jobs.admission(e, ttl=3600).collect()}
    assert got == {1: (0, True), 2: (1, True), 3: (2, False), 5: (2, False), 7: (1, True), 8: (0, True)}


def test_landing_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for k in range(3):
        (land / f"{k}.pdf").write_bytes(b"x")
    (land / "n.txt").write_bytes(b"y")
    seen = []
    q = streams.submit(streams.landing(spark, str(land)), lambda df, n: seen.append([r.path for r in df.select("path").collect()]), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(map(len, seen)) == 3 and len(seen) >= 2
