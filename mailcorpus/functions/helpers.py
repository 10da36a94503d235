"""Helpers that rule text can call: SQL functions defined in SQL, which Spark inlines into plans.

Their names begin with ``h_``. Like all rule conditions they never give null: what is missing does
not match. ``register`` defines them for a session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed as X


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


_ORG = """CASE WHEN size({0}) <= 2 THEN array_join({0}, '.')
  WHEN array_contains({1}, array_join(slice({0}, -2, 2), '.')) THEN array_join(slice({0}, -3, 3), '.') ELSE array_join(slice({0}, -2, 2), '.') END""".format("filter(split(lower(host), '[.]'), x -> x <> '')", _strings(X.TWO_LABEL_SUFFIXES))
_HIDDEN = "".join(f"\\u{ord(c):04x}" for c in X.HIDDEN_CHARS)
#: Bits per letter of {0}: letters in order, one fold over the lengths of their runs.
_ENTROPY = """(CASE WHEN length({0}) > 0 THEN log2(length({0})) - aggregate(array_sort(split({0}, '')), named_struct('c', '', 'run', CAST(0 AS DOUBLE), 'sum', CAST(0 AS DOUBLE)),
  (s, c) -> CASE WHEN c = s.c THEN named_struct('c', c, 'run', s.run + 1, 'sum', s.sum) ELSE named_struct('c', c, 'run', CAST(1 AS DOUBLE), 'sum', s.sum + CASE WHEN s.run > 0 THEN s.run * log2(s.run) ELSE CAST(0 AS DOUBLE) END) END,
  s -> s.sum + CASE WHEN s.run > 0 THEN s.run * log2(s.run) ELSE CAST(0 AS DOUBLE) END) / length({0}) ELSE CAST(0 AS DOUBLE) END)"""

#: Name, parameters, type and body. Null arguments give false, 0 or an empty string.
FUNCTIONS = {
    # Texts
    "h_equals": ("a STRING, b STRING, exactly BOOLEAN DEFAULT false", "BOOLEAN", "coalesce(CASE WHEN exactly THEN a = b ELSE lower(a) = lower(b) END, false)"),
    "h_contains": ("a STRING, b STRING, exactly BOOLEAN DEFAULT false", "BOOLEAN", "coalesce(CASE WHEN exactly THEN contains(a, b) ELSE contains(lower(a), lower(b)) END, false)"),
    "h_starts_with": ("a STRING, b STRING, exactly BOOLEAN DEFAULT false", "BOOLEAN", "coalesce(CASE WHEN exactly THEN startswith(a, b) ELSE startswith(lower(a), lower(b)) END, false)"),
    "h_ends_with": ("a STRING, b STRING, exactly BOOLEAN DEFAULT false", "BOOLEAN", "coalesce(CASE WHEN exactly THEN endswith(a, b) ELSE endswith(lower(a), lower(b)) END, false)"),
    "h_matches": ("a STRING, pattern STRING, flags STRING DEFAULT 'i'", "BOOLEAN", "coalesce(rlike(a, CASE WHEN coalesce(flags, '') = '' THEN pattern ELSE concat('(?', flags, ')', pattern) END), false)"),
    "h_includes_any": ("a STRING, words ARRAY<STRING>", "BOOLEAN", "coalesce(exists(words, w -> contains(lower(a), lower(w))), false)"),
    # Domains
    "h_levenshtein": ("a STRING, b STRING", "INT", "levenshtein(coalesce(a, ''), coalesce(b, ''))"),
    "h_looks_like": ("host STRING, known STRING, most INT DEFAULT 2", "BOOLEAN", "coalesce(host <> '' AND known <> '' AND lower(host) <> lower(known) AND levenshtein(lower(host), lower(known)) <= most, false)"),
    "h_looks_like_any": ("host STRING, known ARRAY<STRING>, most INT DEFAULT 2", "BOOLEAN", "coalesce(host <> '' AND exists(known, d -> d <> '' AND lower(host) <> lower(d) AND levenshtein(lower(host), lower(d)) <= most), false)"),
    "h_domains_match": ("a STRING, b STRING", "BOOLEAN", "coalesce(a <> '' AND lower(a) = lower(b), false)"),
    "h_registrable": ("host STRING", "STRING", f"coalesce({_ORG}, '')"),
    "h_domains_align": ("a STRING, b STRING", "BOOLEAN", "h_registrable(a) <> '' AND h_registrable(a) = h_registrable(b)"),
    "h_trusted": ("host STRING, known ARRAY<STRING>", "BOOLEAN", "coalesce(host <> '' AND exists(known, d -> CASE WHEN rlike(d, '(?i)^/.*/[a-z]*$') THEN rlike(lower(host), regexp_extract(d, '^/(.*)/', 1)) ELSE lower(host) = lower(d) OR endswith(lower(host), concat('.', lower(d))) END), false)"),
    "h_punycode": ("host STRING", "BOOLEAN", "coalesce(exists(split(lower(host), '[.]'), x -> startswith(x, 'xn--')), false)"),
    "h_in_category": ("host STRING, keyword STRING", "BOOLEAN", "coalesce(host <> '' AND keyword <> '' AND CASE WHEN startswith(keyword, '.') THEN endswith(lower(host), lower(keyword)) WHEN contains(keyword, '.') THEN lower(host) = lower(keyword) OR endswith(lower(host), concat('.', lower(keyword))) ELSE contains(lower(host), lower(keyword)) END, false)"),
    # Attachments, by their names
    "h_extension": ("name STRING", "STRING", "coalesce(regexp_extract(lower(name), '[.][^.]*$', 0), '')"),
    "h_dual_extension": ("name STRING", "BOOLEAN", f"coalesce(size(split(name, '[.]')) >= 3 AND array_contains({_strings(X.DOCUMENT_EXTENSIONS)}, try_element_at(split(lower(name), '[.]'), -2)), false)"),
    "h_count_extensions": ("names ARRAY<STRING>, extensions ARRAY<STRING>", "INT", "coalesce(size(filter(names, n -> array_contains(transform(extensions, e -> lower(e)), regexp_extract(lower(n), '[.][^.]*$', 0)))), 0)"),
    "h_any_extension": ("names ARRAY<STRING>, extensions ARRAY<STRING>", "BOOLEAN", "h_count_extensions(names, extensions) > 0"),
    "h_any_dual_extension": ("names ARRAY<STRING>", "BOOLEAN", f"coalesce(exists(names, n -> size(split(n, '[.]')) >= 3 AND array_contains({_strings(X.DOCUMENT_EXTENSIONS)}, try_element_at(split(lower(n), '[.]'), -2))), false)"),
    # Odd texts
    "h_hidden_count": ("text STRING", "INT", f"coalesce(length(text) - length(translate(text, '{_HIDDEN}', '')), 0)"),
    "h_has_hidden": ("text STRING, least INT DEFAULT 1", "BOOLEAN", "h_hidden_count(text) >= least"),
    "h_entropy": ("text STRING", "DOUBLE", _ENTROPY.format("text")),
    "h_looks_random": ("text STRING, least INT DEFAULT 12, bits DOUBLE DEFAULT 3.5", "BOOLEAN", "coalesce(length(text) >= least AND h_entropy(text) > bits, false)"),
    "h_any_random": ("text STRING, least INT DEFAULT 12, bits DOUBLE DEFAULT 3.5", "BOOLEAN", f"coalesce(exists(split(text, '[ \\\\t\\\\n\\\\r]+'), w -> length(w) >= least AND {_ENTROPY.format('w')} > bits), false)"),
}


def register(spark: SparkSession) -> None:
    """Define the functions in this session, unless it has them.

    Spark does not inline them inside lambdas, so lists have helpers of their own (``h_any_...``).
    """
    if spark.catalog.functionExists("h_any_random"):
        return
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
