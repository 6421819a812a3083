"""Bytes through a parser, the service and the command line."""

import http.client
import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from spanloom import __main__ as command
from spanloom import service
from spanloom.operators import translate
from spanloom.sources import pdf, readers


def pages(content):
    """A stand-in for a parser: the bytes are the pages as JSON."""
    return json.loads(content)


def shout(texts, source, target):
    return [t.upper() for t in texts]


def document(*texts, font="A+SFRM1000"):
    lines = []
    for k, t in enumerate(texts):
        box = {"x0": 72.0, "y0": 100.0 + 30 * k, "x1": 150.0, "y1": 110.0 + 30 * k}
        lines.append({"bbox": box, "spans": [{"text": t, "font": font, "size": 10.0, "bbox": box, "origin": {"x": 72.0, "y": box["y1"] - 2}}]})
    return json.dumps([{"width": 600.0, "height": 800.0, "blocks": [{"type": 0, "lines": lines}], "links": []}]).encode()


def test_bytes_are_parsed_and_broken_files_say_why(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(document("Soit la fonction", "continue ici"))
    (tmp_path / "b.pdf").write_bytes(b"no pages")
    (tmp_path / "c.PDF").write_bytes(b"[]")
    (tmp_path / "d.txt").write_bytes(b"[]")
    got = {r.path[-5:]: r for r in pdf.parsed(readers.uploads(spark, str(tmp_path)), pages).collect()}
    assert set(got) == {"a.pdf", "b.pdf", "c.PDF"} and len({r.doc_id for r in got.values()}) == 3
    assert got["b.pdf"].pages is None and got["b.pdf"].error.startswith("JSONDecodeError") and got["c.PDF"].pages == [] and got["c.PDF"].error is None
    blocks = readers.blocks_of(pdf.parsed(readers.uploads(spark, str(tmp_path)), pages))
    assert [[s.text for s in raw.spans] for r in blocks.collect() for raw in r.raws] == [["Soit la fonction"], ["continue ici"]]
    with pytest.raises(Exception, match="pymupdf"):
        pdf.parsed(readers.uploads(spark, str(tmp_path))).collect()


def ask(url, data=None, kind=None):
    request = urllib.request.Request(url, data, {"Content-Type": kind} if kind else {})
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, r.read(), r.headers
    except urllib.error.HTTPError as e:
        return e.code, e.read(), e.headers


def form(name, content, border="b0rder"):
    head = f'--{border}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/pdf\r\n\r\n'
    return head.encode() + content + f"\r\n--{border}--\r\n".encode(), f"multipart/form-data; boundary={border}"


@pytest.fixture
def running():
    started = []

    def start(desk):
        s = service.server(desk, port=0, origins=("http://page",))
        threading.Thread(target=s.serve_forever, daemon=True).start()
        started.append(s)
        return f"http://127.0.0.1:{s.server_address[1]}"

    yield start
    for s in started:
        s.shutdown()
        s.server_close()


def wait(url, key):
    for _ in range(600):
        code, body, _ = ask(f"{url}/status/{key}")
        told = json.loads(body)
        if code != 200 or told["status"] != "processing":
            return told
        time.sleep(0.2)
    raise AssertionError("still running")


def test_service_end_to_end(spark, running):
    url = running(service.Desk(service.translator(spark, pages, backend=shout, send={"sleep": lambda s: None})))
    code, body, _ = ask(f"{url}/translate?source=fr&target=en", *form("a.b.pdf", document("Soit la fonction")))
    assert code == 200
    key = json.loads(body)["job_id"]
    assert wait(url, key)["status"] == "done"
    code, body, headers = ask(f"{url}/download/{key}")
    assert code == 200 and body.startswith(b"%PDF") and b"[0 0 600 800]" in body
    assert "a.b-translated.pdf" in headers["Content-Disposition"] and headers["Content-Type"] == "application/pdf"
    for content, error in ((document("12", "34"), "no text to translate"), (b"broken", "JSONDecodeError")):
        told = wait(url, json.loads(ask(f"{url}/translate", *form("x.pdf", content))[1])["job_id"])
        assert told["status"] == "error" and error in told["error"]
    # a document whose lines stay as they are comes back unchanged
    same = document("SOIT")
    key = json.loads(ask(f"{url}/translate", *form("x.pdf", same))[1])["job_id"]
    assert wait(url, key)["status"] == "done" and ask(f"{url}/download/{key}")[1] == same


def test_refusals_and_expiry(running):
    go, now = threading.Event(), [0.0]

    def work(content, source, target, say):
        say("waiting", 1, 4)
        go.wait(60)
        return content + f"{source}>{target}".encode()

    url = running(service.Desk(work, active=2, ttl=600, most=100, clock=lambda: now[0]))
    send = lambda name="a.PDF", content=b"\r\n--x\n\x00\xff": ask(f"{url}/translate?source=de", *form(name, content))
    assert send("a.doc")[0] == 400 and send(content=b"x" * 101)[0] == 400
    huge = http.client.HTTPConnection(url[len("http://") :], timeout=60)
    huge.putrequest("POST", "/translate")
    huge.putheader("Content-Length", str(10**12))
    huge.endheaders()  # answered before anything is read
    assert huge.getresponse().status == 400
    huge.close()
    keys = [json.loads(send()[1])["job_id"] for _ in range(2)]
    assert send()[0] == 503
    assert ask(f"{url}/download/{keys[0]}")[0] == 400 and ask(f"{url}/status/none")[0] == 404 and ask(f"{url}/download/none")[0] == 404 and ask(f"{url}/other")[0] == 404
    time.sleep(0.2)
    assert json.loads(ask(f"{url}/status/{keys[0]}")[1]) == {"status": "processing", "stage": "waiting", "progress": 1, "total": 4}
    go.set()
    assert [wait(url, k)["status"] for k in keys] == ["done", "done"]
    assert ask(f"{url}/download/{keys[1]}")[1] == b"\r\n--x\n\x00\xffde>en"
    now[0] = 600.0
    third = json.loads(send()[1])["job_id"]
    assert ask(f"{url}/status/{keys[0]}")[0] == 200
    now[0] = 600.1
    send()
    assert ask(f"{url}/status/{keys[0]}")[0] == 404 and wait(url, third)["status"] == "done"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in.put.pdf").write_bytes(document("Soit la fonction"))
    assert command.main(["translate", "in.put.pdf", "-s", "fr", "-t", "de", "--parser", "test_service:pages"], spark) == 0
    assert capsys.readouterr().out.strip() == "in.put-de.pdf" and (tmp_path / "in.put-de.pdf").read_bytes().startswith(b"%PDF")
    with pytest.raises(SystemExit):
        command.arguments(["translate", "in.put.pdf"])


def test_callers_share_one_rate(spark, tmp_path):
    """However many tasks call, all together send a batch a pause."""
    waits = str(tmp_path)

    def note(seconds):
        import uuid
        from pathlib import Path

        Path(waits, uuid.uuid4().hex).write_text(str(seconds))

    rows = spark.range(40).selectExpr("CAST(id AS string) AS key", "'x' AS text").repartition(16)
    out = translate.send(rows, shout, "fr", "en", sleep=note, callers=3, pause=0.5)
    assert out.count() == 40
    slept = [float(p.read_text()) for p in tmp_path.iterdir()]
    assert slept and len(slept) <= 3 and set(slept) == {1.5}
