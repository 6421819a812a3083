"""Single documents over HTTP: submit, ask, fetch. Folders of many go through ``streaming.jobs.landing`` instead.

``POST /translate?source=&target=`` (a form with a part ``file``) answers ``job_id``; ``GET /status/<id>`` answers status, stage and, while there is any,
progress of total; ``GET /download/<id>`` answers the result. Refusals: 400 for another kind of file, one too large or a result that is not there yet,
404 for an unknown job, 503 while ``ACTIVE`` jobs run. A job is forgotten ``TTL`` seconds after it came, whatever became of it.

What the process holds is bounded by uploads: one a running job, and one result for each job of the last ``TTL`` seconds.
"""

from __future__ import annotations

import email
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.operators.jobs import ACTIVE, TTL, UPLOAD
from spanloom.plans.engine import Engine
from spanloom.sources import pdf, readers, sinks

#: (stage, steps done, steps in all) as a job goes on; (content, source, target, say) to a result.
Say = Callable[[str, int, int], None]
Work = Callable[[bytes, str, str, Say], bytes]
#: Bytes that a form may take beside its file.
FORM = 64 * 1024


def translator(spark: SparkSession, parse: pdf.Parser = pdf.installed, **engine) -> Work:
    """Work on one document by an ``Engine`` with the given parameters. Where nothing changes, the document comes back as it was."""

    def work(content: bytes, source: str, target: str, say: Say) -> bytes:
        e = Engine(spark, source, target, **engine)
        say("reading", 0, 3)
        docs = e.cut(pdf.parsed(spark.createDataFrame([(str(uuid.uuid4()), bytearray(content))], "path string, content binary"), parse))
        seen = docs.select("error", F.get("pages", F.lit(0)).alias("page")).first()
        if seen["error"]:
            raise ValueError(seen["error"])
        blocks = readers.blocks_of(docs)
        say("translating", 1, 3)
        changed = e.changed(blocks)
        if changed.isEmpty():
            if e.lines(blocks).isEmpty():
                raise ValueError("no text to translate")
            return content
        say("drawing", 2, 3)
        drawn = sinks.documents(e.drawn(changed), seen["page"]["width"], seen["page"]["height"]).first()
        return bytes(drawn["content"]) if drawn else content

    return work


@dataclass
class Job:
    name: str
    came: float
    status: str = "processing"
    stage: str = "waiting"
    progress: int = 0
    total: int = 0
    error: str | None = None
    result: bytes | None = field(default=None, repr=False)

    def say(self, stage: str, progress: int, total: int) -> None:
        self.stage, self.progress, self.total = stage, progress, total

    def told(self) -> dict:
        steps = {"progress": self.progress, "total": self.total} if self.total else {}
        return {"status": self.status, "stage": self.stage, **steps, **({"error": self.error} if self.error else {})}


class Desk:
    """Jobs and their states. Answers are (code, dictionary), those of ``fetch`` (200, (name, content)) if all is well."""

    def __init__(self, work: Work, active: int = ACTIVE, ttl: float = TTL, most: int = UPLOAD, clock: Callable[[], float] = time.monotonic):
        self.work, self.ttl, self.most, self.clock = work, ttl, most, clock
        self.places = threading.BoundedSemaphore(active)
        self.lock = threading.Lock()
        self.jobs: dict[str, Job] = {}

    def refusal(self, name: str | None, size: int) -> tuple[int, dict] | None:
        """The same rules as ``jobs.acceptable``."""
        if not (name or "").lower().endswith(".pdf"):
            return 400, {"detail": "not a PDF file"}
        if size > self.most:
            return 400, {"detail": f"larger than {self.most} bytes"}
        return None

    def submit(self, name: str | None, content: bytes, source: str, target: str) -> tuple[int, dict]:
        refused = self.refusal(name, len(content))
        if refused:
            return refused
        now = self.clock()
        with self.lock:
            self.jobs = {k: j for k, j in self.jobs.items() if now - j.came <= self.ttl}
        if not self.places.acquire(blocking=False):
            return 503, {"detail": "busy, try again later"}
        key, job = str(uuid.uuid4()), Job(name, now)
        with self.lock:
            self.jobs[key] = job
        threading.Thread(target=self._run, args=(job, content, source, target), daemon=True).start()
        return 200, {"job_id": key}

    def _run(self, job: Job, content: bytes, source: str, target: str) -> None:
        try:
            job.result = self.work(content, source, target, job.say)
            job.status = "done"
        except Exception as e:  # a job's failure is its state
            job.status, job.error = "error", str(e)
        finally:
            self.places.release()

    def status(self, key: str) -> tuple[int, dict]:
        job = self.jobs.get(key)
        return (200, job.told()) if job else (404, {"detail": "no such job"})

    def fetch(self, key: str) -> tuple[int, dict | tuple[str, bytes]]:
        job = self.jobs.get(key)
        if job is None:
            return 404, {"detail": "no such job"}
        if job.status != "done" or job.result is None:
            return 400, {"detail": "not ready"}
        return 200, (job.name.rpartition(".")[0] + "-translated.pdf", job.result)


def form_file(kind: str, body: bytes) -> tuple[str | None, bytes]:
    """(file name, content) of the part ``file`` of a form; no name where there is none."""
    head = email.message_from_string(f"Content-Type: {kind}\n\n")
    border = head.get_boundary()
    for part in (b"\r\n" + body).split(b"\r\n--" + border.encode())[1:-1] if border else ():
        top, _, content = part.partition(b"\r\n\r\n")
        told = email.message_from_bytes(top.lstrip(b"\r\n"))
        if told.get_param("name", header="content-disposition") == "file":
            return told.get_filename(), content
    return None, b""


def server(desk: Desk, host: str = "127.0.0.1", port: int = 8000, origins: tuple[str, ...] = ()) -> ThreadingHTTPServer:
    """An HTTP server for a desk; ``serve_forever()`` runs it. Pages of ``origins`` may call it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, said: dict | tuple[str, bytes]) -> None:
            name, data = (None, json.dumps(said).encode()) if isinstance(said, dict) else said
            self.send_response(code)
            self.send_header("Content-Type", "application/json" if name is None else "application/pdf")
            self.send_header("Content-Length", str(len(data)))
            if name is not None:
                self.send_header("Content-Disposition", f"attachment; filename*=UTF-8''{quote(name)}")
            self.allow()
            self.end_headers()
            self.wfile.write(data)

        def allow(self) -> None:
            origin = self.headers.get("Origin")
            if origin in origins:
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Vary", "Origin")

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            self.allow()
            self.send_header("Access-Control-Allow-Methods", "GET, POST")
            self.send_header("Access-Control-Allow-Headers", "*")
            self.end_headers()

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            size = self.headers.get("Content-Length", "")
            if url.path != "/translate":
                return self.answer(404, {"detail": "no such path"})
            if not size.isdigit():
                return self.answer(411, {"detail": "length required"})
            if int(size) > desk.most + FORM:  # refused unread
                self.close_connection = True
                return self.answer(400, {"detail": f"larger than {desk.most} bytes"})
            asked = parse_qs(url.query)
            name, content = form_file(self.headers.get("Content-Type", ""), self.rfile.read(int(size)))
            self.answer(*desk.submit(name, content, asked.get("source", ["fr"])[0], asked.get("target", ["en"])[0]))

        def do_GET(self) -> None:
            what, _, key = urlsplit(self.path).path.lstrip("/").partition("/")
            known = {"status": desk.status, "download": desk.fetch}.get(what)
            self.answer(*(known(key) if known else (404, {"detail": "no such path"})))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
