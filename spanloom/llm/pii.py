"""PII by anchor expansion.

One Aho-Corasick automaton walks each text once and reports *anchors*: at-signs,
URL schemes, digits, plus signs and identifier cues (schemes and cues in any case). Each anchor is handed to a
deterministic local parser which expands it to the left and right and validates
what it found. No parser looks further than the characters of its own kind, and what
may be asked again after a failure (the ends of a URL, its next slash and at-sign) is kept, so a
text of any length, of nothing but cues too, costs time in proportion to its length.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the *base* kinds: their spans
are the leftmost non-overlapping matches of the patterns in ``BASE_PATTERNS``
that pass validation. The method adds ``address`` (a URL which carries
credentials or a mailbox) and ``account`` (an identifier named by a cue, an IBAN
with right check digits, a social-security-like number after its cue, or a
credential assigned to a name such as ``token``).

Edge cases: a null text is an empty one; it has no spans, counts of 0 and the
digest of the empty string. Very long texts are scanned whole. Repeated rows give repeated results. Spans that start
together are ordered by kind, as listed, then by end. Offsets are code
points. Columns of the input other than those named are ignored by ``find`` and
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import slices

#: The base kinds, in the order which breaks ties of their starts, and the patterns that define them.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE_PATTERNS, "address", "account")
RANK = {k: i for i, k in enumerate(KINDS)}

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_PHONE = _DIGITS | frozenset(" ().-")
_SECRET = _ALNUM | frozenset("_-/+.")
_URL_STOP = re.compile("[ \t\n\r\x0b\x0c\"'<>]")
#: Words that announce an identifier, in lower case, and the characters that may stand between one and its value.
CUES = ("iban", "ssn", "account number", "account no", "account id", "acct", "passport", "tax id", "customer id", "user id", "member id")
#: Words that announce a credential in an assignment.
SECRETS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "private_key")
_BETWEEN = " :#=.\"'"
#: Characters between a cue and its value, and of a value, at most.
GAP, VALUE = 8, 34
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "postgres://", "mysql://", "redis://", "amqp://", "mongodb://")


def _automaton():
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for d in sorted(_DIGITS):
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES + SECRETS:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


_shared = None


def _anchors():
    global _shared
    if _shared is None:  # built once in each worker
        _shared = _automaton()
    return _shared


def _run(text: str, i: int, chars: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def _dotted(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The digit groups of a maximal dotted run that begins at ``start``, and its end."""
    parts, i = [], start
    while True:
        stop = _run(text, i, _DIGITS)
        parts.append((i, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS:
            i = stop + 1
        else:
            return parts, stop


def _octet(text: str) -> bool:
    short = text.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def _card_end(text: str, start: int) -> int:
    """The end of the maximal run of digits with single blanks or dashes between them."""
    i, n = start + 1, len(text)
    while i < n:
        if text[i] in _DIGITS:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in _DIGITS:
            i += 2
        else:
            break
    return i


def luhn(digits: str) -> bool:
    """The check-sum rule of payment cards."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _phone(text: str, plus: int) -> tuple[int, int, bool] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = _run(text, plus + 2, _PHONE)
    while end > plus and text[end - 1] not in _DIGITS:
        end -= 1
    if end < plus + 4:
        return None
    digits = sum(c in _DIGITS for c in text[plus:end])
    return plus, end, 9 <= digits <= 15


class _Urls:
    """Expands the schemes of one text, from left to right. A URL's ends, next slash and next at-sign serve every scheme before them."""

    __slots__ = ("text", "stop", "end", "slash", "at")

    def __init__(self, text: str):
        self.text, self.stop, self.end, self.slash, self.at = text, -1, -1, -1, -1

    def expand(self, start: int, body: int) -> tuple[int, int] | None:
        text = self.text
        if body > self.stop:  # beyond the last URL's characters: a new one
            hit = _URL_STOP.search(text, body)
            self.stop = hit.start() if hit else len(text)
            self.end = body + len(text[body : self.stop].rstrip(".,;:!?)"))
            self.slash = self.at = -1
        end = self.end
        if body >= end:
            return None
        if self.slash < body:
            self.slash = text.find("/", body, end) % (len(text) + 1)  # none: beyond any end
        if self.at < body:
            self.at = text.find("@", body, end) % (len(text) + 1)
        host_end = min(self.slash, end)
        if not body < self.at < host_end - 1:
            return None
        return (start, end) if text.find(":", body, self.at) >= 0 or text[start:body].lower() == "mailto:" else None


def _iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _account(text: str, cue: str, start: int, after: int) -> tuple[int, int] | None:
    if start and text[start - 1] in _ALNUM:
        return None
    i = after
    while i < len(text) and i < after + GAP and text[i] in _BETWEEN:
        i += 1
    if i == after:
        return None
    if cue in SECRETS:
        if not set("=:") & set(text[after:i]):  # asked first: no cue inside a value passes, so that a value is read once
            return None
        end = _run(text, i, _SECRET)
        word = text[i:end]
        good = len(word) >= 12 and any(c in _DIGITS for c in word) and any(c.isalpha() for c in word)
        return (i, end) if good else None
    if cue == "iban":
        code, stop, k = "", i, i
        while k < len(text) and len(code) <= VALUE and (text[k] in _ALNUM or text[k] in "- " and code and k - i < 3 * VALUE):
            if text[k] in _ALNUM:
                code += text[k].upper()
                if len(code) == 4 and not (code[:2].isalpha() and code[2:].isdigit()):
                    break
                if _iban(code):
                    stop = k + 1
            k += 1
        return (i, stop) if stop > i else None
    # up to the first blank: a cue in the middle of such a run has no separator after it
    end = _run(text, i, _LABEL)
    while end > i and text[end - 1] == "-":
        end -= 1
    word = text[i:end]
    digits = sum(c in _DIGITS for c in word)
    if cue == "ssn":
        good = [len(p) for p in word.split("-")] == [3, 2, 4] and digits == 9 or len(word) == 9 == digits
    else:
        good = 6 <= len(word) <= VALUE and digits >= 4
    return (i, end) if good else None


def _lowered(text: str) -> str:
    """``text`` with its letters lowered, as long as it was: the anchors' offsets are the text's."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) of one whole text, each sorted by start, then kind."""
    text = text or ""
    base: list[tuple[int, int, str]] = []
    added: list[tuple[int, int, str]] = []
    email_end = dotted_end = card_end = phone_end = address_end = account_end = 0
    low, urls = _lowered(text), _Urls(text)
    for last, (what, size) in _anchors().iter(low):
        at = last - size + 1
        if what == "digit":
            if at >= dotted_end:
                parts, dotted_end = _dotted(text, at)
                for k in range(0, len(parts) - 3, 4):
                    if all(_octet(text[a:b]) for a, b in parts[k : k + 4]):
                        base.append((parts[k][0], parts[k + 3][1], "ip"))
            if at >= card_end:
                card_end = _card_end(text, at)
                if card_end - at >= 12:
                    digits = "".join(c for c in text[at:card_end] if c in _DIGITS)
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append((at, card_end, "card"))
        elif what == "at":
            if at >= email_end and (found := _email(text, at, email_end)):
                base.append((*found, "email"))
                email_end = found[1]
        elif what == "plus":
            if at >= phone_end and (hit := _phone(text, at)):
                phone_end = hit[1]
                if hit[2]:
                    base.append((hit[0], hit[1], "phone"))
        elif what == "scheme":
            if at >= address_end and (found := urls.expand(at, last + 1)):
                added.append((*found, "address"))
                address_end = found[1]
        elif at >= account_end and (found := _account(text, low[at : last + 1], at, last + 1)):
            added.append((*found, "account"))
            account_end = found[1]
    order = lambda s: (s[0], RANK[s[2]], s[1])
    return sorted(base, key=order), sorted(added, key=order)


def digest(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` of each span, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame) -> DataFrame:
    """Every span of every whole text of ``docs`` (doc_id, text): one row a document, by streaming batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_PATTERNS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
        for batch in slices(batches):
            rows = []
            for text in batch.column(1):
                base, added = scan(text.as_py())
                kinds = [k for _, _, k in base]
                every = sorted(base + added, key=lambda s: (s[0], RANK[s[2]], s[1])) if added else base
                rows.append((*(kinds.count(k) for k in BASE_PATTERNS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def mask(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans make one replacement, named by the first."""
    if not text:
        return text
    base, added = scan(text)
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in sorted(base + added, key=lambda s: (s[0], -s[1])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with all its columns, each text masked and its length set anew; null stays null."""
    schema = docs.schema
    at = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = list(batch.columns)
            texts = [mask(x) for x in cols[at].to_pylist()]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)
