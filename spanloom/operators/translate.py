"""Translation as an operator: cache probe, batches, a pluggable backend with retries, offline lexicons.

Order matters and is fixed by hand, as Catalyst cannot know what a call costs: equal texts are
sent once, what the cache holds is not sent, and what was sent is materialised before it is used twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts, base of the waits between them, and the pause after a batch, in seconds.
ATTEMPTS, WAIT_BASE, PAUSE = 3, 2.0, 0.3
CACHE = "key string, source string, target string, raw string, status string"

#: A small lexicon for offline runs.
LEXICON = {
    "de": "of", "la": "the", "le": "the", "les": "the", "et": "and", "est": "is", "en": "in", "pour": "for", "que": "that", "un": "a", "une": "a",
    "der": "the", "die": "the", "das": "the", "und": "and", "mit": "with", "von": "of", "ist": "is", "los": "the", "las": "the", "para": "for", "con": "with",
}


class Backend(Protocol):
    """What a translation service looks like: texts in, as many texts out."""

    def __call__(self, texts: list[str], source: str, target: str) -> list[str]: ...


def key(text: Column, source: str, target: str) -> Column:
    """Cache key: languages and text, so that one cache serves all directions."""
    return F.md5(F.concat_ws("\x1f", F.lit(source), F.lit(target), text).cast("binary"))


def lexicon(text: Column, words: dict[str, str] | None = None) -> Column:
    """Word by word, by look-up; other words stay. Runs in the JVM."""
    table = F.create_map(*(F.lit(x) for kv in (words or LEXICON).items() for x in kv))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def call(backend: Backend, texts: list[str], source: str, target: str, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str], str]:
    """Results and status: after the last failed attempt the texts themselves, marked ``failed``."""
    for attempt in range(ATTEMPTS):
        try:
            got = backend(texts, source, target)
            return [t if g is None else g for g, t in zip(got, texts, strict=True)], "ok"
        except Exception:
            if attempt + 1 < ATTEMPTS:
                sleep(WAIT_BASE ** (attempt + 1))
    return texts, "failed"


def send(texts: DataFrame, backend: Backend, source: str, target: str, limit: int = 4800, sleep: Callable[[float], None] = time.sleep, callers: int = 4, pause: float = PAUSE) -> DataFrame:
    """``texts`` (key, text) through the backend, in batches of about ``limit`` characters; CACHE rows.

    ``callers`` tasks call, whatever the size of ``texts``; each waits ``callers * pause`` after a batch, so that all together send one batch a ``pause``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []
        size = 0

        def flush() -> pd.DataFrame:
            got, status = call(backend, [t for _, t in held], source, target, sleep)
            sleep(pause * callers)
            return pd.DataFrame({"key": [k for k, _ in held], "source": source, "target": target, "raw": got, "status": status})

        for pdf in frames:
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                held.append((k, t))
                size += len(t)
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("key", "text").repartition(callers).mapInPandas(run, CACHE)


def probe(paragraphs: DataFrame, cache: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their raw translation, misses) of ``paragraphs`` (wire_text): only what once succeeded is a hit."""
    keyed = paragraphs.withColumn("key", key(F.col("wire_text"), source, target))
    good = cache.filter("status = 'ok'").select("key", "raw")
    return keyed.join(good, "key"), keyed.join(good, "key", "left_anti")


def fresh(keyed: DataFrame, cache: DataFrame, backend: Backend, source: str, target: str, **how) -> DataFrame:
    """New cache rows for ``keyed`` paragraphs (key, wire_text) that the cache does not hold: each text is sent once. They are to be written before they are used."""
    missing = keyed.join(cache.filter("status = 'ok'").select("key"), "key", "left_anti").select("key", F.col("wire_text").alias("text")).dropDuplicates(["key"])
    return send(missing, backend, source, target, **how)
