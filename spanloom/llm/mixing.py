"""Mixing sources to target weights by raking (iterative proportional fitting).

1. Documents are counted into cells (source, language, topic): rows and tokens, one partial
   aggregation and a shuffle of cells.
2. Each dimension has target shares of tokens: those named for its values, what they leave (``REST`` at least) going to the
   unnamed values by their observed shares; or, where none are named, observed shares raised
   to a power below 1, which lifts the rare. Rounds of fitting scale the cells' weights to the targets of one dimension after the
   other: ``w <- w * target / sum of w over the dimension's value``. Rounds stop when no marginal is off by more than ``CLOSE``,
   or after ``ROUNDS`` of them; the largest error left is part of the result.
3. A cell's factor is its weight over its observed share. Documents of a cell are kept with probability
   ``min(1, level * factor)``, where ``level`` makes the expected kept tokens the wanted share of all tokens:
   cells that reach 1 are set apart until no other does.
4. A document is kept if a uniform number made of its id's digest is below its cell's probability: the same
   in every run, on every cluster.

All steps are DataFrame functions. Cells number at most the product of the dimensions' values. Up to ``CELLS`` of them (counted) are
fitted in one task, by windows, and broadcast; more are fitted by aggregations over all tasks, and joined by salted keys.
Only totals and errors, single numbers, reach the driver.

Tokens are a text's words, numbers and runs of other marks, the pieces that tokenizers begin with; a caller may name a column of counts.
Topic is, for want of a topic column, the form of a text: tabular, brief, article or long; a caller may name a column.
Edge cases: null source, language or topic is a value of its own;
null and empty texts have no tokens and are kept with their cell's probability; very long texts count whole; documents without
id are drawn by their text, those with neither are drawn alike. Where no text has a token every document is
kept. Rows that repeat share their fate. Equal factors share one probability. Targets for values that do not occur are left out and the rest scaled up.
An empty table gives an empty result. Other columns, whatever their names, are kept by ``sampled``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import cut

#: Rounds of fitting at most, rounds between two looks at the error, the error at which they stop, the power that flattens observed shares, the share of tokens to keep.
ROUNDS, STEP, CLOSE, POWER, KEEP = 40, 10, 1e-12, 0.7, 0.8
#: Share that named targets leave to the values they do not name; cells broadcast or fitted in one task at most; salts beyond.
REST, CELLS, SALTS = 0.02, 50_000, 32
DIMS = ("source", "lang", "topic")
#: Targets of the registered query and the pipeline. Sources, of any name and number, are flattened by ``POWER``.
TARGETS: dict[str, dict[str, float]] = {
    "lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15},
    "topic": {"long": 0.45, "article": 0.35, "brief": 0.15, "tabular": 0.05},
}
#: A word, a number, or a run of other marks.
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """Tokens of a text, before any vocabulary."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The form of a text, for want of a topic column."""
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(text.contains(" | "), F.lit("tabular")).when(size < 600, F.lit("brief")).when(size < 3000, F.lit("article")).otherwise(F.lit("long"))


def draw(doc_id: Column, text: Column) -> Column:
    """A uniform number from 0 to 1 (52 bits) from the digest of the id, or else of the text."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(2**52))


def targets_of(cells: DataFrame, dim: str, named: dict[str, float] | None, power: float) -> DataFrame:
    """(dim, to): the target share of each value of ``dim``, one row a value."""
    seen = cells.groupBy(dim).agg(F.sum("n_tokens").cast("double").alias("n"))
    if named is None:
        out = cut(seen.withColumn("raw", F.pow("n", F.lit(power))))
    else:
        share = F.lit(None).cast("double")
        for value, s in named.items():
            share = F.when(F.col(dim).eqNullSafe(F.lit(value)), F.lit(float(s))).otherwise(share)
        marked = cut(seen.withColumn("named", share))
        rest = marked.filter("named IS NULL").agg(F.sum("n")).first()[0] or 0.0
        over = max(REST, 1 - sum(named.values()))
        out = marked.withColumn("raw", F.coalesce("named", F.lit(over) * F.col("n") / F.lit(rest or 1.0)))
    total = out.agg(F.sum("raw")).first()[0] or 1.0
    return out.select(dim, (F.col("raw") / F.lit(total)).alias("to"))


def _joined(cells: DataFrame, values: DataFrame, dim: str, small: bool) -> DataFrame:
    """``cells`` with the other columns of ``values`` (one row a value of ``dim``); null is a value."""
    right = values.withColumnRenamed(dim, "its")
    out = cells.join(F.broadcast(right) if small else right.hint("merge"), F.col(dim).eqNullSafe(F.col("its")))
    return out.drop("its")


def _in_one_task(cells: DataFrame, rounds: int) -> DataFrame:
    for _ in range(rounds):
        for d in DIMS:
            mass = F.sum("w").over(W.partitionBy(d))
            cells = cells.withColumn("w", F.when(mass > 0, F.col("w") * F.col(f"to_{d}") / mass).otherwise(F.lit(0.0)))
    return cells


def _in_many_tasks(cells: DataFrame, rounds: int) -> DataFrame:
    """The same rounds by aggregation: a step's marginal masses are a table, joined back."""
    for _ in range(rounds):
        for d in DIMS:
            masses = cells.groupBy(d).agg(F.sum("w").alias("mass"))
            scaled = _joined(cells, masses, d, False).withColumn("w", F.when(F.col("mass") > 0, F.col("w") * F.col(f"to_{d}") / F.col("mass")).otherwise(F.lit(0.0)))
            cells = cut(scaled.drop("mass"))
    return cells


def marginal_error(cells: DataFrame) -> float:
    """The largest difference of a marginal share from its target."""
    off = [cells.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"to_{d}")).alias("off")).select("off") for d in DIMS]
    return off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, power: float = POWER, keep: float = KEEP, small: bool = True) -> DataFrame:
    """``cells`` (source, lang, topic, n_tokens; one row a cell) with weight factor, keep probability and the largest marginal error."""
    total = float(cells.agg(F.sum("n_tokens")).first()[0] or 0)
    out = cells.withColumn("share", F.col("n_tokens") / F.lit(total or 1.0))
    for d in DIMS:
        out = _joined(out, targets_of(cells, d, (targets or {}).get(d), power).withColumnRenamed("to", f"to_{d}"), d, small)
    out = cut((out.coalesce(1) if small else out).withColumn("w", F.col("share")))
    done, error = 0, 0.0
    while total and done < rounds:
        step = min(STEP if small else 1, rounds - done)
        out, done = cut((_in_one_task if small else _in_many_tasks)(out, step)), done + step
        error = marginal_error(out)
        if error <= CLOSE:
            break
    out = out.withColumn("factor", F.when(F.col("share") > 0, F.col("w") / F.col("share")).otherwise(F.lit(1.0)))
    # cells whose probability would pass 1 are kept whole; what is left is spread over the others
    level, sure = None, -1
    while total:
        over = F.lit(False) if level is None else F.col("factor") * F.lit(level) > 1
        r = out.agg(F.sum(F.when(over, F.col("share"))).alias("whole"), F.sum(F.when(~over, F.col("factor") * F.col("share"))).alias("spread"), F.count_if(over).alias("n")).first()
        if r["n"] == sure:
            break
        sure = r["n"]
        if not r["spread"] or r["spread"] <= 1e-12 or (r["whole"] or 0.0) >= keep and level is not None:
            break
        level = (keep - (r["whole"] or 0.0)) / r["spread"]
    prob = F.lit(1.0) if level is None else F.least(F.lit(1.0), F.lit(level) * F.col("factor"))
    return out.select(*DIMS, F.round("factor", 6).alias("weight"), F.round(prob, 6).alias("prob"), F.round(F.lit(float(error)), 6).alias("marginal_error"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, power: float = POWER, keep: float = KEEP, topic_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """(row, source, lang, topic, n_tokens, weight, prob, marginal_error, kept): each row of ``docs`` as a struct, whatever its columns, with its decision."""
    row, text = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text")
    n = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else tokens(text)
    marked = docs.select(row, F.col("source"), F.col("lang"), (F.col(topic_col) if topic_col else topic(text)).alias("topic"), n.alias("n_tokens"))
    counted = cut(marked.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n_tokens")))
    small = counted.count() <= CELLS
    right = cut(rake(counted, targets, rounds, power, keep, small)).withColumnsRenamed({d: f"its_{d}" for d in DIMS})
    same = F.lit(True)
    for d in DIMS:
        same = same & F.col(d).eqNullSafe(F.col(f"its_{d}"))
    if small:
        joined = marked.join(F.broadcast(right), same)
    else:
        salted = right.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = marked.withColumn("salt", F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(SALTS)))
        joined = dealt.join(salted, same & (F.col("salt") == F.col("its_salt")))
    return joined.select("row", *DIMS, "n_tokens", "weight", "prob", "marginal_error", (draw(F.col("row.doc_id"), F.col("row.text")) < F.col("prob")).alias("kept"))


def weights(docs: DataFrame, **how) -> DataFrame:
    """Weight, probability and decision of every document of ``docs`` (doc_id, text, source, lang)."""
    return mix(docs, **how).select("row.doc_id", *DIMS, "n_tokens", "weight", "prob", "kept", "marginal_error")


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The documents that the draw keeps, with all their columns."""
    return mix(docs, **how).filter("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
