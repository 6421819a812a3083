"""Command line: ``python -m spanloom translate FILE --source fr [--target en]`` and ``python -m spanloom serve [--port 8000]``.

A backend is named as ``module:function``; without one the offline lexicon translates. The result is
``<name>-<target>.pdf`` in the working folder, unless ``--output`` names another place.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from spanloom import service
from spanloom.sources import pdf


def named(what: str | None):
    """The function that ``module:function`` names."""
    if what is None:
        return None
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="spanloom", description="Documents of positioned text to another language")
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("--backend", help="translation service as module:function")
    both.add_argument("--parser", help="parser of files as module:function")
    sub = p.add_subparsers(dest="do", required=True)
    one = sub.add_parser("translate", parents=[both], help="one file")
    one.add_argument("input")
    one.add_argument("--source", "-s", required=True)
    one.add_argument("--target", "-t", default="en")
    one.add_argument("--output", "-o")
    one.add_argument("--cache", help="folder of kept translations; by default <input>.cache, used with a backend")
    all_ = sub.add_parser("serve", parents=[both], help="an HTTP service")
    all_.add_argument("--host", default="127.0.0.1")
    all_.add_argument("--port", type=int, default=8000)
    all_.add_argument("--origin", action="append", default=[], help="origin of pages that may call")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    backend, parse = named(a.backend), named(a.parser) or pdf.installed
    if a.do == "serve":
        service.server(service.Desk(service.translator(spark, parse, backend=backend)), a.host, a.port, tuple(a.origin)).serve_forever()
        return 0
    source = Path(a.input)
    cache = (a.cache or str(source.with_suffix(".cache"))) if backend else None
    work = service.translator(spark, parse, backend=backend, cache_path=cache)
    done = work(source.read_bytes(), a.source, a.target, lambda stage, k, n: print(f"{stage} ({k}/{n})", file=sys.stderr))
    out = Path(a.output or f"{source.stem}-{a.target}.pdf")
    out.write_bytes(done)
    print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
