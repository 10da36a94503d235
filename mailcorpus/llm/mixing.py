"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic; sources and languages without a target of
their own are one class, so the table has a bounded number of cells. Raking scales the cells
until the tokens' shares meet the targets of each margin; classes that no target speaks of keep
their own share. A cell's documents are then taken ``expected = scale * raked / tokens`` times,
with the scale that spends ``keep`` of the tokens: documents of scarce cells are repeated by the
whole part, and the remainder is sampled. So the expected tokens of all cells are proportional to
the raked ones, whatever ``keep`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
MARGINS = ("source", "lang", "topic")
#: The production targets, in shares of tokens.
TARGETS = {
    "source": {"src0": 0.2, OTHER: 0.8},
    "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    "topic": {"table": 0.1, "record": 0.1, "note": 0.2, "article": 0.6},
}


def topic() -> Column:
    """The kind of text: a table, a record with numbers, a short note or an article."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(text.contains(" | "), "table").when(text.rlike("[0-9]{4}"), "record").when(F.length(text) < 800, "note").otherwise("article")


def _class(column: str, targets: dict[str, float]) -> Column:
    value = F.col(column).cast("string")
    return F.when(value.isin([k for k in targets if k != OTHER]), value).otherwise(OTHER)


def rake(cells: dict[tuple, float], targets: dict[str, dict[str, float]], rounds: int = 200, within: float = 1e-9) -> dict[tuple, float]:
    """Cells scaled so that each margin's shares meet its targets, as far as there are cells.

    Targets of classes without tokens are shared out over the others; classes without a target keep
    their share of the tokens, and the targets hold among the rest.
    """
    raked = {k: v for k, v in cells.items() if v > 0}
    own = [{c: sum(v for k, v in raked.items() if k[m] == c) for c in {k[m] for k in raked} if c not in targets[name]} for m, name in enumerate(MARGINS)]
    for _ in range(rounds):
        worst = 0.0
        for m, name in enumerate(MARGINS):
            sums: dict[str, float] = {}
            for k, v in raked.items():
                sums[k[m]] = sums.get(k[m], 0.0) + v
            goal = {c: targets[name].get(c, 0.0) for c in sums if sums[c] > 0}
            total = sum(goal.values())
            if not total:
                continue
            every = sum(sums.values())
            free = every - sum(own[m].values())
            factor = {c: (own[m][c] if c in own[m] else g / total * free) / sums[c] for c, g in goal.items()}
            worst = max([worst, *(abs(f - 1) for f in factor.values() if f)])
            raked = {k: v * factor.get(k[m], 0.0) for k, v in raked.items()}
        if worst < within:
            break
    return raked


def expectations(cells: dict[tuple, float], raked: dict[tuple, float], keep: float) -> dict[tuple, float]:
    """How often each document of a cell is taken on average, so that ``keep`` of all tokens are spent."""
    spent = sum(raked.values())
    scale = keep * sum(cells.values()) / spent if spent else 0.0
    return {k: scale * raked.get(k, 0.0) / v for k, v in cells.items() if v > 0}


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, keep: float = 0.5, seed: int = 11) -> DataFrame:
    """``docs(doc_id, text, source, lang)`` -> ``(doc_id, tokens, source_class, lang_class, topic, weight, expected, probability, copies, kept)``.

    A row for each row, to be used ``copies`` times: ``expected`` times on average, which the whole
    part of it guarantees and a sampled remainder makes up. ``probability`` is the chance of one copy
    at least, and ``kept`` tells whether there is one. Null sources and languages belong to the class of all others; null and
    empty texts have no tokens and weigh nothing: they are taken as often as their cell, never if
    the cell has no token. Sampling compares the remainder with a hash of doc_id and text, so
    repeated rows stay or go together and any rerun keeps the same rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        _class("source", targets["source"]).alias("source_class"), _class("lang", targets["lang"]).alias("lang_class"), topic().alias("topic"),
        (F.pmod(F.xxhash64("doc_id", text, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u"),
    )
    keys = ("source_class", "lang_class", "topic")
    # No more cells than targets allow: (sources + 1) * (languages + 1) * topics.
    cells = {tuple(r[k] for k in keys): float(r.tokens) for r in rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).orderBy(*keys).collect()}
    raked = rake(cells, targets)
    times = expectations(cells, raked, keep)
    table = [(*k, raked.get(k, 0.0) / v if v else 0.0, times.get(k, 0.0)) for k, v in cells.items()]
    table = docs.sparkSession.createDataFrame(table, "source_class string, lang_class string, topic string, weight double, expected double")
    whole = F.floor("expected")
    out = rows.join(F.broadcast(table), list(keys)).withColumn("copies", whole + (F.col("u") < F.col("expected") - whole).cast("long"))
    return out.select("doc_id", "tokens", *keys, "weight", "expected", F.least(F.lit(1.0), "expected").alias("probability"), "copies", (F.col("copies") > 0).alias("kept"))
