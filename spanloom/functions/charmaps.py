"""Character tables of mathematics fonts, as ``translate`` arguments."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _run(letters: str, first: int, odd: dict[str, int] | None = None) -> dict[str, str]:
    """Letters to consecutive code points from ``first``; ``odd`` names those that stand elsewhere."""
    return {c: chr((odd or {}).get(c, first + k)) for k, c in enumerate(letters)}


#: Extension-font control codes and letters, and the letters that stand outside their Unicode block.
EXTENSION = {
    "\x00": "(", "\x01": ")", "\x02": "[", "\x03": "]", "\x04": "⌊", "\x05": "⌋", "\x06": "⌈", "\x07": "⌉",
    "\x08": "{", "\x09": "}", "\x0a": "⟨", "\x0b": "⟩", "\x0c": "|", "\x10": "⎛", "\x11": "⎝", "\x12": "⎞", "\x13": "⎠",
    "(": "(", " ": " ", "P": "∑", "Q": "∏", "R": "∫", "X": "∑", "Y": "∏", "Z": "∫",
    "\uf8f1": "\u23a7", "\uf8f2": "\u23a8", "\uf8f3": "\u23a9", "\uf8f4": "\u23ab",
}
_SCRIPT_ODD = {"B": 0x212C, "E": 0x2130, "F": 0x2131, "H": 0x210B, "I": 0x2110, "L": 0x2112, "M": 0x2133, "R": 0x211B}
_FRAKTUR_ODD = {"C": 0x212D, "H": 0x210C, "I": 0x2111, "R": 0x211C, "Z": 0x2128}
_GREEK = "".join(map(chr, range(0x3B1, 0x3CA)))

TABLES: dict[str, dict[str, str]] = {
    "CMEX": EXTENSION,
    "rsfs": _run(string.ascii_uppercase, 0x1D49C, _SCRIPT_ODD),
    "CMMI": _run(string.ascii_uppercase, 0x1D434) | _run(string.ascii_lowercase, 0x1D44E, {"h": 0x210E}) | _run(_GREEK, 0x1D6FC) | {"\u03d5": "\U0001d719", "\u00b5": "\U0001d707"},
    "CMBX": _run(string.ascii_uppercase, 0x1D400) | _run(string.ascii_lowercase, 0x1D41A) | _run(string.digits, 0x1D7CE),
    "EUFM": _run(string.ascii_uppercase, 0x1D504, _FRAKTUR_ODD) | _run(string.ascii_lowercase, 0x1D51E),
}


def map_text(text: Column, family: Column) -> Column:
    """Text of a mathematics span as Unicode, by its family's table; other families keep it."""
    out = text
    for name, t in TABLES.items():
        out = F.when(family == name, F.translate(text, "".join(t), "".join(t.values()))).otherwise(out)
    return out


def route(text: Column, family: Column, style: Column) -> Column:
    """How a span is drawn: ``drop`` (unknown family), ``copy`` (its glyph, from the source), ``blank`` or ``draw``."""
    visible = F.regexp_replace(text, "[ \t\n\r\f]", "")
    unmapped = F.translate(visible, "".join(EXTENSION), "") != ""
    low = visible.rlike("[\\x00-\\x1f\\u0338]")
    return (
        F.when(style.isNull(), "drop")
        .when(family.isin("rsfs", "EUFM") & (visible != ""), "copy")
        .when((family == "CMEX") & unmapped, "copy")
        .when((family == "CMSY") & low, "copy")
        .when(visible == "", "blank")
        .otherwise("draw")
    )
