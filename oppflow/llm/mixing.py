"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of source, language and topic; the cells'
weights are raked in turn to the target shares of each margin until all margins
hold. Margins that contradict each other cannot all hold: raking then ends after
``MOST_ROUNDS`` with the margin raked last met, :func:`raked` returns how far
each margin is off, and a warning says so. A document is then sampled with the calibrated probability of its cell by
a hash of its id (of its text if the id is null). Probabilities are
``min(1, c * weight / tokens)``: ``c`` makes the largest of them 1 if at least
``KEPT_SHARE`` of the tokens stay that way, so that all shares are met. Where
rare cells would push all others below that, ``c`` is raised until that share
stays, and cells that reach 1 are kept whole.

Only the cell table is iterated over, never the documents; while it has at most
``ONE_TASK_CELLS`` rows one task rakes it without a shuffle, beyond that each
margin is one shuffle of the cells.

Defined results: null source, language or topic is a value of its own; null and
wordless texts have no tokens and get the probability of their cell, or 1 where
the cell has no tokens at all; a target for a value that no document has is
left out and the others are scaled to 1; a value without a target keeps its
observed share; repeated ids of a cell are kept or dropped together; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oppflow.shared import materialize

#: Default targets: a margin's observed shares to this power, scaled to 1.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: At least this share of the tokens is expected to stay.
KEPT_SHARE = 0.5
#: Margins may differ from their targets by this share of them.
TOLERANCE = 1e-6
MOST_ROUNDS = 60
ONE_TASK_CELLS = 200_000
_ROUNDS_PER_WRITE = 6
MARGINS = ["source", "lang", "topic"]


def default_topic(text: Column) -> Column:
    """A coarse kind of content: ``legal``, ``contact``, ``table`` or ``prose``."""
    return F.when(text.rlike("(?i)licen[sc]e|copyright"), "legal").when(text.rlike(r"[\w.]@\w++\.\w"), "contact").when(F.contains(text, F.lit(" | ")), "table").otherwise("prose")


def _cell(topic: Column | None, text_col: str, source_col: str, lang_col: str) -> dict[str, Column]:
    """The cell of a row."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return {"source": none(F.col(source_col)), "lang": none(F.col(lang_col)), "topic": none(default_topic(F.coalesce(F.col(text_col), F.lit(""))) if topic is None else topic)}


def documents_in_cells(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 42) -> DataFrame:
    """``id, source, lang, topic, tokens`` and the sampling hash ``chance`` of every row."""
    cell = _cell(topic, text_col, source_col, lang_col)
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_col).alias("id"), *[cell[m].alias(m) for m in MARGINS], tokens.alias("tokens"), _chance(id_col, text_col, seed).alias("chance"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cells of :func:`raked`; a warning names the margins that do not hold."""
    out, off = raked(cells, targets)
    missed = {m: x for m, x in off.items() if x > TOLERANCE}
    if missed:
        warnings.warn("margins differ from their targets by a share of " + ", ".join(f"{x:.3g} ({m})" for m, x in missed.items()), stacklevel=2)
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``weight`` (the tokens that the cell should have) added to ``source, lang, topic, tokens``, and how far each margin is off.

    ``targets``: for a margin, its wanted shares as ``value, share``. A margin's
    deviation is the largest of its values', as a share of the value's target.
    """
    out = cells.filter("tokens > 0")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    if cells.count() <= ONE_TASK_CELLS:
        out = out.coalesce(1)
        out = out.withColumn("total", total)
    else:
        out = out.crossJoin(F.broadcast(out.agg(F.sum("tokens").alias("total"))))  # one row
    out = out.withColumn("weight", F.col("tokens").cast("double"))
    for m, power in TEMPER.items():
        mine = F.sum("tokens").over(Window.partitionBy(m))
        out = out.withColumn(f"sum_{m}", mine.cast("double"))
        if targets and m in targets:
            given = targets[m].groupBy(F.coalesce(F.col("value").cast("string"), F.lit("(none)")).alias(m)).agg(F.sum("share").cast("double").alias(f"wish_{m}"))
            out = out.join(given, m, "left").withColumn(f"wish_{m}", F.coalesce(f"wish_{m}", F.col(f"sum_{m}") / F.col("total")))
        else:
            out = out.withColumn(f"wish_{m}", F.pow(F.col(f"sum_{m}") / F.col("total"), F.lit(power)))
    out = materialize(out, "cells")
    # each value's wish counts once in the scale of its margin
    for m in TEMPER:
        scale = out.select(m, f"wish_{m}").distinct().agg(F.sum(f"wish_{m}")).first()[0] or 1.0
        out = out.withColumn(f"goal_{m}", F.col(f"wish_{m}") / F.lit(scale) * F.col("total"))
    keep = ["source", "lang", "topic", "tokens", "weight", *[f"goal_{m}" for m in TEMPER]]
    out, one = out.select(keep), cells.count() <= ONE_TASK_CELLS
    for _ in range(MOST_ROUNDS // _ROUNDS_PER_WRITE):
        out = out.coalesce(1) if one else out
        for _ in range(_ROUNDS_PER_WRITE):
            for m in TEMPER:
                now = F.sum("weight").over(Window.partitionBy(m))
                out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"goal_{m}") / now).otherwise(0.0))
        out = materialize(out, "cells")
        off = [F.max(F.abs(F.col(f"now_{m}") - F.col(f"goal_{m}")) / F.greatest(F.col(f"goal_{m}"), F.lit(1e-9))) for m in TEMPER]
        seen = out.coalesce(1) if one else out
        for m in TEMPER:
            seen = seen.withColumn(f"now_{m}", F.sum("weight").over(Window.partitionBy(m)))
        left = {m: x or 0.0 for m, x in zip(TEMPER, seen.agg(*off).first(), strict=True)}
        if max(left.values()) <= TOLERANCE:
            break
    return out.select("source", "lang", "topic", "tokens", "weight"), left


def scale(ratios: DataFrame, kept_share: float = KEPT_SHARE) -> float:
    """The factor ``c`` of the probabilities ``min(1, c * ratio)``, solved over ``tokens, ratio`` of the cells."""
    total, largest = ratios.agg(F.sum("tokens"), F.max("ratio")).first()
    if not largest:
        return 1.0
    c = 1.0 / largest
    while True:  # each round some cells more are whole, until c fits those that are
        whole = F.col("ratio") * F.lit(c) >= 1
        kept, rest, steps = ratios.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("ratio"))), F.count(F.when(~whole, True))).first()
        if not steps or not rest:
            return c
        wanted = (kept_share * total - kept) / rest
        if wanted <= c * (1 + 1e-12):
            return c
        c = wanted


def _chance(id_col: str, text_col: str, seed: int) -> Column:
    """A number from 0 to 1 by a hash of the id, or of the text of a row without one."""
    of = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    none = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(seed))
    return F.pmod(F.when(F.col(id_col).isNull(), none).otherwise(of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _calibrated(rows: DataFrame, targets: dict[str, DataFrame] | None, kept_share: float) -> DataFrame:
    """``source, lang, topic, probability`` of the cells of ``rows``."""
    cells = materialize(rows.groupBy(MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    ratios = rake(cells, targets).select(*MARGINS, "tokens", (F.col("weight") / F.col("tokens")).alias("ratio"))
    return ratios.select(*MARGINS, F.least(F.col("ratio") * F.lit(scale(ratios, kept_share)), F.lit(1.0)).alias("probability"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", kept_share: float = KEPT_SHARE) -> DataFrame:
    """Every row's cell, its calibrated ``probability`` and whether it is ``kept``."""
    rows = materialize(documents_in_cells(docs, topic, id_col, text_col, source_col, lang_col, seed), "in_cells")
    got = rows.join(_calibrated(rows, targets, kept_share), MARGINS, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return got.select("id", *MARGINS, "tokens", "probability", (F.col("chance") < F.col("probability")).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query."""
    return sample(docs).withColumnRenamed("id", "doc_id")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The sampled rows of ``docs``, with all their columns; each row is judged by itself."""
    cells = _calibrated(documents_in_cells(docs, id_col=id_col), targets, KEPT_SHARE).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("probability").alias("_probability"))
    cell = _cell(None, "text", "source", "lang")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of the input can clash
    placed = docs.select(row, *[cell[m].alias(f"_{m}") for m in MARGINS], _chance(id_col, "text", 42).alias("_chance"))
    out = placed.join(cells, [f"_{m}" for m in MARGINS], "left").filter(F.col("_chance") < F.coalesce("_probability", F.lit(1.0)))
    return out.select("row.*")
