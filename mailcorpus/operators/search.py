"""Composable predicates over ``message_facts`` and the ranking of their results.

A ``Predicate`` is a boolean column that is never null, with the warnings of leaves that could not
be resolved (these match nothing) and the positive leaves, by field, for scoring.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X
from mailcorpus.shared import written

#: Text fields of a search: the columns of message_facts that they read, joined by blanks.
TEXT_FIELDS = {
    "subject": ["subject"], "from": ["from_name", "from_address"], "to": ["to_text"], "cc": ["cc_text"], "bcc": ["bcc_text"], "replyto": ["reply_text"], "returnpath": ["return_text"],
    "attachment": ["att_names_text"], "body": ["body"], "url": ["urls_text"], "header": ["headers_text"], "ocr": ["ocr_text"],
}
REGEX_FIELDS = ["subject", "from", "to", "cc", "bcc", "replyto", "returnpath", "attachment"]
NUMBERS = {"attachment.count": "attachment_count", "size": "size", "urls": "url_count", "recipients": "recipient_count", "duplicates": "duplicate_count", "urgency": "urgency_score"}
UNITS = {"": 1, "b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}


@dataclass(frozen=True)
class Predicate:
    column: Column
    hits: tuple[tuple[str, Column], ...] = ()
    warnings: tuple[str, ...] = field(default=())

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(self.column & other.column, self.hits + other.hits, self.warnings + other.warnings)

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(self.column | other.column, self.hits + other.hits, self.warnings + other.warnings)

    def __invert__(self) -> Predicate:
        """Negated leaves do not score."""
        return Predicate(~self.column, (), self.warnings)


class Search:
    """Predicates for a facts table; fields whose columns it lacks match nothing."""

    def __init__(self, facts: DataFrame):
        self.facts, self.have = facts, set(facts.columns)

    def text(self, name: str) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXT_FIELDS.get(name, []) if c in self.have]
        return F.concat_ws(" ", *parts) if parts else F.lit("")

    def _nothing(self, why: str) -> Predicate:
        return Predicate(F.lit(False), (), (why,))

    def term(self, x: str) -> Predicate:
        if len(x.strip()) < 2:
            return self._nothing(f"too short: {x!r}")
        hits = tuple((f, F.lower(self.text(f)).contains(x.lower())) for f, cols in TEXT_FIELDS.items() if set(cols) & self.have)
        return Predicate(C.any_of([h for _, h in hits]), hits)

    phrase = term

    def field_contains(self, name: str, x: str) -> Predicate:
        if name not in TEXT_FIELDS or len(x.strip()) < 2:
            return self._nothing(f"cannot search {name} for {x!r}")
        hit = F.lower(self.text(name)).contains(x.lower())
        return Predicate(hit, ((name, hit),))

    def header_contains(self, name: str, x: str) -> Predicate:
        if "header_texts" not in self.have:
            return self._nothing(f"no header {name}")
        hit = F.coalesce(F.col("header_texts")[name.lower()].contains(x.lower()), F.lit(False))
        return Predicate(hit, (("header", hit),))

    def _pattern(self, pattern: str, case: bool) -> str | None:
        try:
            re.compile(pattern)
        except re.error:
            return None
        return pattern if case else f"(?i){pattern}"

    def field_regex(self, name: str, pattern: str, case: bool = False) -> Predicate:
        p = self._pattern(pattern, case)
        if p is None or name not in REGEX_FIELDS:
            return self._nothing(f"bad pattern for {name}: {pattern!r}")
        if name == "attachment" and "att_names" in self.have:
            hit = F.coalesce(F.exists("att_names", lambda n: n.rlike(p)), F.lit(False))
        else:
            hit = self.text(name).rlike(p)
        return Predicate(hit, ((name, hit),))

    def any_regex(self, pattern: str, case: bool = False) -> Predicate:
        found = [self.field_regex(f, pattern, case) for f in REGEX_FIELDS]
        return Predicate(C.any_of([p.column for p in found]), sum((p.hits for p in found), ()), sum((p.warnings for p in found), ())[:1])

    def num(self, name: str, op: str, value: str | float) -> Predicate:
        m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*(b|kb|mb|gb)?", str(value).lower())
        if name not in NUMBERS or not m or op not in (">", ">=", "<", "<=", "!=", "="):
            return self._nothing(f"bad number: {name} {op} {value}")
        left, right = F.coalesce(F.col(NUMBERS[name]), F.lit(0)), F.lit(float(m[1]) * UNITS[m[2] or ""])
        return Predicate({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "!=": left != right, "=": left == right}[op])

    def _listed(self, column: str, value: str, name: str) -> Predicate:
        hit = F.coalesce(F.array_contains(column, value), F.lit(False))
        return Predicate(hit, ((name, hit),))

    def att_ext(self, x: str) -> Predicate:
        return self._listed("att_exts", x.lower() if x.startswith((".", "(")) else f".{x.lower()}", "attachment")

    def att_sha256(self, x: str) -> Predicate:
        return self._listed("att_sha256s", x.lower(), "attachment")

    def message_id(self, x: str) -> Predicate:
        return Predicate(F.coalesce(F.lower("message_id") == x.lower(), F.lit(False)))

    def script(self, name: str, s: str) -> Predicate:
        return self._listed(f"{name}_scripts", s.lower(), name) if s.lower() in X.SCRIPTS else self._nothing(f"unknown script {s}")

    def meta_contains(self, column: str, x: str) -> Predicate:
        """A part of a domain, an address or, for lists, of any of their elements."""
        array = dict(self.facts.dtypes)[column].startswith("array")
        hit = F.exists(column, lambda e: F.lower(e).contains(x.lower())) if array else F.lower(column).contains(x.lower())
        return Predicate(F.coalesce(hit, F.lit(False)))

    def flag(self, id_: str) -> Predicate:
        return Predicate(F.coalesce(F.array_contains("flags", id_), F.lit(False)))

    def auth(self, method: str, result: str) -> Predicate:
        if method not in ("spf", "dkim", "dmarc"):
            return self._nothing(f"unknown method {method}")
        hit = F.col(method).isNull() if result == "missing" else F.coalesce(F.lower(method) == result.lower(), F.lit(False))
        return Predicate(hit & ~F.coalesce(F.col("skipped"), F.lit(False)) if "skipped" in self.have else hit)

    def tag(self, name: str) -> Predicate:
        """Needs ``tags`` on the facts: see ``with_tags``."""
        return Predicate(F.coalesce(F.array_contains("tags", name.lower()), F.lit(False)))

    def match_case(self, p: Predicate, x: str) -> Predicate:
        raw = C.any_of([self.text(f).contains(x) for f in REGEX_FIELDS + ["body", "url"]])
        return Predicate(p.column & raw, p.hits, p.warnings)

    def paths(self, include: str = "", exclude: str = "") -> Predicate:
        """Parts of paths with * and ?, split at commas and line feeds; what is excluded wins."""
        patterns = lambda text: [f"(?i){''.join('.*' if c == '*' else '.' if c == '?' else re.escape(c) for c in p)}" for p in (q.strip() for q in re.split(r"[,\n]", text)) if p]
        inside, outside = patterns(include), patterns(exclude)
        hit = C.any_of([F.col("path").rlike(p) for p in inside]) if inside else F.lit(True)
        return Predicate(hit & ~C.any_of([F.col("path").rlike(p) for p in outside]))

    def same_as(self, name: str, values: str | list[str]) -> Predicate:
        """Any of the values, each in all its pieces between quotes."""
        out = None
        for value in [values] if isinstance(values, str) else values:
            pieces = [p.strip() for p in value.split('"') if len(p.strip()) >= 2]
            one = None
            for p in pieces:
                leaf = self.field_contains(name, p)
                one = leaf if one is None else one & leaf
            if one is not None:
                out = one if out is None else out | one
        return out or self._nothing(f"nothing to compare {name} with")

    def where(self, p: Predicate) -> DataFrame:
        return self.facts.where(p.column)

    def ranked(self, p: Predicate, limit: int = 500) -> DataFrame:
        """The best rows with ``score``, ``matched_fields``, the ``total`` they are the best of, and whether that is more: ``truncated``.

        Rows are found and counted in one scan: the count is a metric observed below the ranking.
        The ranking runs at once; its ``limit`` rows are a table in the shared folder, best first.
        """
        by: dict[str, list[Column]] = {}
        for name, hit in p.hits:
            by.setdefault(name, []).append(hit)
        score = sum((F.when(C.any_of(h), X.WEIGHTS.get(f, 1)).otherwise(0) for f, h in by.items()), F.lit(0))
        matched = F.array_compact(F.array(*(F.when(C.any_of(h), F.lit(f)) for f, h in by.items()))) if by else F.array().cast("array<string>")
        seen = Observation()
        found = self.where(p).withColumn("score", score).withColumn("matched_fields", matched).observe(seen, F.count("*").alias("total"))
        best = written(found.orderBy(F.desc("score"), F.desc(F.coalesce("date_ms", F.lit(0))), "path").limit(limit), "ranked")
        total = seen.get["total"]
        return best.withColumn("total", F.lit(total).cast("long")).withColumn("truncated", F.lit(total > limit))


def with_tags(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Facts with the set of each message's tags."""
    return facts.join(tags.groupBy("email_id").agg(F.sort_array(F.collect_set("tag")).alias("tags")), "email_id", "left")


def test_rule(facts: DataFrame, expression: str, limit: int = 2000, samples: int = 8) -> DataFrame:
    """A dry run over the first ``limit`` messages: checked, matched and some paths."""
    rows = facts.orderBy("path").limit(limit).select("path", F.coalesce(F.expr(expression), F.lit(False)).alias("hit"))
    return rows.agg(F.count("*").alias("checked"), F.count_if("hit").alias("matched"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("path")))), 1, samples), ";").alias("samples"))
