"""Expressions over font names."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of text fonts, of bold and of italic ones, and the style of each family of mathematics fonts.
TEXT, BOLD, ITALIC = ("SFRM", "SFBX", "SFBI", "SFTI"), ("SFBX", "SFBI"), ("SFTI", "SFBI")
FAMILIES = ("CMMI", "CMBX", "CMEX", "CMSY", "CMBS", "rsfs", "EUFM")
STYLE_OF_FAMILY = {
    "CMMI": "math", "CMBX": "bold", "CMR1": "regular", "CMR5": "regular", "CMR7": "regular", "CMR8": "regular",
    "CMBS": "math", "CMSY": "math", "CMEX": "math", "rsfs": "math", "EUFM": "math",
}


def _holds(font: Column, marks: tuple[str, ...]) -> Column:
    return functools.reduce(operator.or_, (font.contains(m) for m in marks))


def is_text(font: Column) -> Column:
    """A font of translatable text, whatever tag precedes its name; all others are mathematics."""
    return F.coalesce(_holds(font, TEXT), F.lit(False))


def style(font: Column) -> Column:
    """regular, bold, italic or bolditalic."""
    bold, italic = _holds(font, BOLD), _holds(font, ITALIC)
    return F.when(bold & italic, "bolditalic").when(bold, "bold").when(italic, "italic").otherwise("regular")


def family(font: Column) -> Column:
    """The family of a mathematics font: a known prefix after the last ``+``, else its first four letters."""
    name = F.substring_index(font, "+", -1)
    out = F.substring(name, 1, 4)
    for f in FAMILIES:
        out = F.when(name.startswith(f), F.lit(f)).otherwise(out)
    return out


def family_style(family: Column) -> Column:
    """How a family is drawn; null: not at all."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in STYLE_OF_FAMILY.items() for x in kv)), family)
