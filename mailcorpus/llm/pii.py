"""Personal data by weak supervision, in DataFrame functions alone.

Four kinds have exact rules (email, ip, card, phone). Other candidates, tokens of eight or more
characters with a digit, get votes from labelers: regular expressions, gazetteers and the words
before them. Expectation-maximisation over the vote patterns, whose number is bounded, estimates
how reliable each labeler is; its posteriors train a naive-Bayes classifier of span features
that the labelers do not name, and that classifier adds spans of kind ``other``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns; possessive and anchored, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{7,}[A-Za-z0-9]"
CONTEXT = 24

#: Words that announce private or secret values, and words that announce other numbers.
CUES = "e-?mail|mail|phone|tel|call|mobile|card|visa|account|iban|ip|host|user|login|pass(?:word|wd)?|token|secret|key|ssn|passport|id"
PLAIN = "page|section|vol|volume|chapter|fig|figure|table|year|version|isbn|issn|ref|line|item|no"
PREFIXES = "AKIA|ASIA|ghp_|gho_|sk-|pk_|xox[abp]-|AIza|eyJ"
DOMAINS = "example\\.(?:com|org|net)|gmail\\.|yahoo\\.|hotmail\\.|outlook\\.|proton\\."


def _votes(span: Column, before: Column) -> list[Column]:
    """Each labeler's vote on a span: 1 private, -1 not, 0 no opinion."""
    digits = F.length(F.regexp_replace(span, "[^0-9]", ""))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    return [
        vote(span.rlike(r"^[A-Z0-9]{16,}$|^[0-9a-f]{16,}$|@[A-Za-z0-9-]+\."), span.rlike(r"^[0-9]{1,4}([.-][0-9]{1,4}){1,2}$")),  # shape
        vote(span.rlike(f"^(?:{PREFIXES})|{DOMAINS}"), never),  # gazetteer
        vote(before.rlike(f"(?i)(?:^|[^a-z])(?:{CUES})[\"' ]*[:=]?[\"' ]*$"), before.rlike(f"(?i)(?:^|[^a-z])(?:{PLAIN})[.: ]*$")),  # context
        vote((digits >= 4) & span.rlike("[A-Za-z]") & ~span.rlike("-"), span.rlike("^[a-z]+-[0-9]+$|^[0-9]+[a-z]{1,3}$")),  # mixture
        vote(digits >= 9, digits <= 2),  # amount of digits
    ]


def _features(span: Column) -> list[Column]:
    """Small categorical features of a span."""
    n = F.length(span)
    digits = F.length(F.regexp_replace(span, "[^0-9]", ""))
    case = F.when(~span.rlike("[A-Za-z]"), "none").when(~span.rlike("[a-z]"), "upper").when(~span.rlike("[A-Z]"), "lower").otherwise("mixed")
    marks = F.when(span.contains("@"), "at").when(span.contains("-"), "dash").when(span.rlike("[._%+]"), "dot").otherwise("none")
    return [F.least(F.floor(n / 4), F.lit(8)).cast("string"), F.floor(digits * 4 / n).cast("string"), case, marks, F.when(span.rlike("[^0-9A-Fa-f]"), "other").otherwise("hex")]


def _starts(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places: array of (start, end, span), in code points."""
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(spans)), spans, lambda gap, span: F.struct(F.length(gap).alias("gap"), span.alias("span")))
    kind = "array<struct<start:int,end:int,span:string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["span"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), p["span"].alias("span"))).cast(kind)
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    return F.aggregate(pairs, first, add, lambda acc: acc["found"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,span:string>>")


def _base(text: Column) -> dict[str, Column]:
    """Valid spans of the four kinds. Cheap tests come first: most texts hold none."""
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    within = lambda s, lo, hi: F.length(digits(s)).between(lo, hi)
    checks = {
        "email": (text.contains("@"), lambda s: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), lambda s: ~F.exists(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("int") > 255, F.lit(True)))),
        "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda s: within(s, 16, 19) & F.call_function("luhn_check", digits(s))),
        "phone": (text.contains("+"), lambda s: within(s, 8, 15)),
    }
    return {kind: F.when(test, F.filter(_starts(text, PATTERNS[kind]), _on_span(ok))).otherwise(_none()) for kind, (test, ok) in checks.items()}


def _on_span(f):
    return lambda x: f(x["span"])


def _candidates(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), _starts(text, CANDIDATE)).otherwise(_none())


def _before(text: Column, start: Column) -> Column:
    at = F.greatest(start - CONTEXT, F.lit(0))
    return F.substring(text, at + 1, start - at)


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over vote patterns and their counts: prior and vote weights, both log odds.

    Labelers are taken as independent given the truth, and to start with as right four times in five.
    """
    labelers = len(patterns[0][0]) if patterns else 0
    right = {1: math.log(4), 0: 0.0, -1: -math.log(4)}
    prior, weights = -1.0, [dict(right) for _ in range(labelers)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        posterior = [1 / (1 + math.exp(-prior - sum(w[v] for w, v in zip(weights, votes)))) for votes, _ in patterns]
        yes = sum(p * n for p, (_, n) in zip(posterior, patterns))
        prior = math.log((yes + 1) / (total - yes + 1))
        for k in range(labelers):
            for v in (1, 0, -1):
                a = sum(p * n for p, (votes, n) in zip(posterior, patterns) if votes[k] == v)
                b = sum((1 - p) * n for p, (votes, n) in zip(posterior, patterns) if votes[k] == v)
                # A vote keeps its direction, whatever the counts say.
                w = math.log((a + 1) / (yes + 3)) - math.log((b + 1) / (total - yes + 3))
                weights[k][v] = max(w, 0.1) if v > 0 else min(w, -0.1) if v < 0 else w
    return prior, weights


def _pick(values: dict, key: Column) -> Column:
    out = F.lit(0.0)
    for value, weight in sorted(values.items()):
        out = F.when(key == value, F.lit(weight)).otherwise(out)
    return out


def fit_classifier(texts: DataFrame) -> tuple[float, list[dict[str, float]]]:
    """Log odds of the span classifier, from all candidates in ``texts.text``.

    Two passes, each giving back a table whose size the labelers and features bound.
    """
    spans = texts.select("text", F.explode(_candidates(F.col("text"))).alias("c")).select(F.col("c.span").alias("span"), _before(F.col("text"), F.col("c.start")).alias("before"))
    names = [f"v{k}" for k in range(5)]
    voted = spans.select("span", *(v.alias(n) for v, n in zip(_votes(F.col("span"), F.col("before")), names)))
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    if not patterns:
        return -10.0, [{} for _ in range(5)]
    prior, weights = reliabilities(patterns)
    logit = F.lit(prior)
    for w, n in zip(weights, names):
        logit = logit + _pick(w, F.col(n))
    features = F.array(*(F.struct(F.lit(k).alias("feature"), f.alias("value")) for k, f in enumerate(_features(F.col("span")))))
    trained = voted.select((1 / (1 + F.exp(-logit))).alias("p"), F.explode(features).alias("f")).groupBy("f.feature", "f.value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).orderBy("feature", "value").collect()
    yes = sum(r.yes for r in trained if r.feature == 0)
    no = sum(r.no for r in trained if r.feature == 0)
    odds = [{r.value: math.log((r.yes + 1) / (yes + 8)) - math.log((r.no + 1) / (no + 8)) for r in trained if r.feature == k} for k in range(5)]
    return math.log((yes + 1) / (no + 1)), odds


def find(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``docs`` with ``found``: arrays of (start, end, span) by kind, also ``other`` for added spans.

    Null and empty texts hold none. Added spans never overlap one of the four kinds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    prior, odds = fit_classifier(docs.select(text.alias("text")))
    base = docs.withColumn("_base", F.struct(*(spans.alias(kind) for kind, spans in _base(text).items())))
    taken = F.concat(*(F.col("_base")[kind] for kind in KINDS))
    limit = math.log(threshold / (1 - threshold))

    def private(c: Column) -> Column:
        logit = F.lit(prior)
        for values, f in zip(odds, _features(c["span"])):
            logit = logit + _pick(values, f)
        return (logit >= limit) & ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    other = F.filter(_candidates(text), private)
    return base.withColumn("found", F.struct(*(F.col("_base")[kind].alias(kind) for kind in KINDS), other.alias("other"))).drop("_base")


def _listed(kinds) -> Column:
    def name(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    return F.concat_ws(",", *(F.transform(F.col("found")[kind], name(kind)) for kind in kinds))


def pii_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, a row for each row.

    Counts and digest are of the four kinds; ``spans`` also lists added ones, last. Repeated rows and
    null ids are kept as they are; other columns are ignored.
    """
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.size(F.col("found")[kind]).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, "other")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind, as ``<EMAIL>``; null texts stay null.

    Of overlapping spans the first, then the longest, is replaced.
    """
    found = find(docs)

    def mark(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"<{kind.upper()}>").alias("mark"))

    marked = F.array_sort(F.concat(*(F.transform(F.col("found")[kind], mark(kind)) for kind in (*KINDS, "other"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["mark"])
        return F.struct(F.when(skip, acc["at"]).otherwise(-s["back"]).alias("at"), F.when(skip, acc["out"]).otherwise(out).alias("out"))

    clean = F.aggregate(marked, first, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    return found.withColumn("text", F.when(F.size(marked) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
