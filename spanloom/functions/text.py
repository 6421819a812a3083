"""Expressions over templates and translations.

Blanks are the class ``[ \\t\\n\\r\\f]`` and digits ``[0-9]`` throughout, so that other engines can agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

S = "[ \\t\\n\\r\\f]"
LETTER = "[a-zA-Z\\u00C0-\\u00ff]"
LEADER = "(\\.[ \\t\\n\\r\\f]){3,}"

#: Words that mark a block as English already.
ENGLISH = (
    "the", "this", "text", "compilation", "basic", "results", "functional", "analysis", "over", "stress", "mainly", "put", "space", "functions", "its",
    "dual", "distributions", "order", "point", "being", "that", "these", "spaces", "have", "come", "play", "important", "role", "theory", "abstract",
)

#: Replacements after translation, in the order in which they apply.
TERM_FIXES = (
    ("VARIABLE {M0}-ADIC", "{M0}-ADIC VARIABLE"), ("Variable {M0}-adic", "{M0}-adic Variable"), ("variable {M0}-adic", "{M0}-adic variable"),
    ("temperate distributions", "tempered distributions"), ("Temperate distributions", "Tempered distributions"),
    ("temperate distribution", "tempered distribution"), ("Temperate distribution", "Tempered distribution"),
    ("temperature distributions", "tempered distributions"), ("Temperature distributions", "Tempered distributions"),
    ("temperature distribution", "tempered distribution"), ("Temperature distribution", "Tempered distribution"),
    ("measurements", "measures"), ("Measurements", "Measures"),
    ("Table of contents", "Table of Contents"), ("table of contents", "Table of Contents"), ("TABLE OF CONTENTS", "TABLE OF CONTENTS"),
    ("Class functions", "Functions of class"), ("class functions", "functions of class"), ("Summary. —", "Abstract. —"),
    ("mirabolous", "mirabolic"), ("Mirabolous", "Mirabolic"), ("mirabolique", "mirabolic"), ("Mirabolique", "Mirabolic"),
    ("to infinity", "at infinity"), ("demonstrate the results", "prove the results"),
    ("Locally analytical", "Locally analytic"), ("locally analytical", "locally analytic"),
    ("Analytical functions", "Analytic functions"), ("analytical functions", "analytic functions"), ("analytical function", "analytic function"),
    ("Distribution operations", "Operations on distributions"), ("Point Support Distributions", "Distributions with point support"),
    ("point support distributions", "distributions with point support"), ("Point support distributions", "Distributions with point support"),
    ("compact open", "compact open set"), ("let us demonstrate", "let us prove"), ("let's demonstrate", "let us prove"), ("we demonstrate", "we prove"),
    ("one demonstrates", "one proves"), ("whatever ", "for all "), ("Whatever ", "For all "), ("Demonstration", "Proof"), ("demonstration", "proof"),
    ("Théorème", "Theorem"), ("théorème", "theorem"), ("Corollaire", "Corollary"), ("corollaire", "corollary"), ("Remarque", "Remark"),
    ("remarque", "remark"), ("Proposition", "Proposition"), ("Définition", "Definition"), ("définition", "definition"), ("Lemme", "Lemma"), ("lemme", "lemma"),
)


def strip(text: Column) -> Column:
    """``text`` without blanks at its ends."""
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike("[^ \\t\\n\\r\\f]")


def is_page_number(text: Column) -> Column:
    return strip(text).rlike("^[0-9]{1,3}$")


def is_numeric_only(text: Column) -> Column:
    """Digits, blanks and punctuation only: such a line stays as it is."""
    return strip(text).rlike(f"^({S}|[0-9.,;:!?()\\[\\]/*+=-])+$")


def is_toc(template: Column) -> Column:
    return template.rlike(LEADER)


def english_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0)


def english_hits(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*ENGLISH)))


def is_english(text: Column) -> Column:
    """Five words or more, over three tenths of them marks of English."""
    words = english_words(text)
    return (F.size(words) >= 5) & (10 * english_hits(words) > 3 * F.size(words))


def toc_content(template: Column) -> Column:
    """What stands before the first run of leaders."""
    return strip(F.when(is_toc(template), F.regexp_extract(template, f"(?s)^(.*?){LEADER}", 1)).otherwise(template))


def toc_page(template: Column) -> Column:
    """The page number after the first run of leaders, if nothing but dots and blanks stands before it; else empty."""
    after = strip(F.regexp_extract(template, f"(?s)^.*?{LEADER}(.*)$", 2))
    return F.when(is_toc(template), F.regexp_extract(after, f"^(?:\\.|{S})*([0-9]+){S}*$", 1)).otherwise("")


def mask(template: Column) -> Column:
    """Placeholders as opaque words, set apart from letters by a blank."""
    out = F.regexp_replace(template, "\\{M([0-9]+)\\}", "XXXM$1XXX")
    out = F.regexp_replace(out, f"({LETTER})(XXXM[0-9]+XXX)", "$1 $2")
    return F.regexp_replace(out, f"(XXXM[0-9]+XXX)({LETTER})", "$1 $2")


def fix_terms(text: Column, fixes: tuple[tuple[str, str], ...] = TERM_FIXES) -> Column:
    """Literal replacements, one after the other; later ones see what earlier ones made."""
    table = F.array(*(F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("right")) for a, b in fixes))
    return F.aggregate(table, text, lambda s, f: F.replace(s, f.wrong, f.right))


def unmask(text: Column, fixes: tuple[tuple[str, str], ...] = TERM_FIXES) -> Column:
    """Opaque words back to placeholders, blanks around them squeezed, terms fixed."""
    out = F.regexp_replace(text, "(?i)XXXM([0-9]+)XXX", "{M$1}")
    out = F.regexp_replace(out, f"{S}+(\\{{M[0-9]+\\}}){S}+", " $1 ")
    out = F.regexp_replace(out, f"{S}+(\\{{M[0-9]+\\}})-", " $1-")
    return fix_terms(out, fixes)


def segments(text: Column) -> Column:
    """Runs of text and placeholders, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit("(?s)\\{M[0-9]+\\}|(?:(?!\\{M[0-9]+\\}).)+"), 0), lambda x: x != "")


def shift_markers(template: Column, by: Column) -> Column:
    """Placeholders renumbered from ``by`` on (their own numbers run from 0)."""
    parts = segments(template)
    moved = F.transform(parts, lambda p: F.when(p.rlike("^\\{M[0-9]+\\}$"), F.concat(F.lit("{M"), (F.regexp_extract(p, "([0-9]+)", 1).cast("int") + by).cast("string"), F.lit("}"))).otherwise(p))
    return F.array_join(moved, "")
