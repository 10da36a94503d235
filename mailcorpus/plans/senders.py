"""Queries on sender domains against long lists, on links and references of pages, and on the helpers of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import helpers
from mailcorpus.operators import domains

from . import fixtures as V
from .registry import query

# A listed domain for every customer; senders spell one of them: rightly, with one or two edits, or with three.
_LISTED = "SELECT substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 9) || '.example' AS listed FROM customer"
_SPELLED = """SELECT path, CASE doc_id % 6 WHEN 0 THEN h WHEN 1 THEN substr(h, 2) WHEN 2 THEN 'z' || substr(h, 2) WHEN 3 THEN substr(h, 1, 3) || 'qq' || substr(h, 4)
  WHEN 4 THEN 'mail.' || h ELSE 'zzz' || substr(h, 4) END || CASE WHEN doc_id % 12 = 1 THEN '.EXAMPLE' ELSE '.example' END AS host
FROM (SELECT path, doc_id, substr(md5(CAST(doc_id * 7 % 997 AS VARCHAR(20))), 1, 9) AS h FROM m)"""
_SAFE = "SELECT 'z' || substr(md5(CAST(c_custkey AS VARCHAR(20))), 2, 8) || '.example' AS listed FROM customer WHERE c_custkey % 3 = 0"


def _senders(spark, d):
    spelled = V.messages(spark, d)
    return spark.sql(_SPELLED.replace("FROM m)", "FROM {m})"), m=spelled)


@query(f"""SELECT path, min(listed) AS near FROM (SELECT path, lower(host) AS h FROM ({_SPELLED})) s, ({_LISTED}) l WHERE levenshtein(h, listed) <= 2 AND h <> listed
  AND h NOT IN ({_SAFE}) GROUP BY path""", "m")
def lookalikes_of_a_long_list(spark, d):
    """Senders near one of thousands of domains, but for those that are listed as safe."""
    table = lambda sql: V.view(spark, d, sql, "customer")
    return domains.lookalikes(_senders(spark, d), table(_LISTED), table(_SAFE), "host").select("path", "near")


@query(f"SELECT DISTINCT lower(host) AS host FROM ({_SPELLED}) s JOIN ({_LISTED}) l ON lower(host) = listed OR ends_with(lower(host), '.' || listed)", "m")
def hosts_under_a_long_list(spark, d):
    hosts = _senders(spark, d).select(F.lower("host").alias("host")).distinct()
    return domains.under(hosts, V.view(spark, d, _LISTED, "customer"))


@query("SELECT path, email_id, from_domain IN ('paypa1.com', 'bit.ly') AS lookalike_domain FROM m", "m")
def lookalike_flags(spark, d):
    m = V.messages(spark, d).select("path", "email_id", "from_domain")
    return domains.with_lookalike_flag(m, ["bit.io", "amazom.com", "/^mail[.]firm/"]).select("path", "email_id", "lookalike_domain")


# Helpers of rules, each with null arguments in some rows -------------------------------------------
def _helped(spark, d, **columns: str):
    helpers.register(spark)
    return V.messages(spark, d).select("path", *(F.expr(e).alias(n) for n, e in columns.items()))


@query("""SELECT path, coalesce(lower(x_mailer) = 'outlook', false) AS equal, coalesce(x_mailer = 'outlook', false) AS same, coalesce(contains(lower(att_list), 'pdf'), false) AS has,
  false AS has_exactly, coalesce(starts_with(lower(reply_domain), 'firm'), false) AS begins, coalesce(ends_with(lower(reply_domain), 'example'), false) AS ends,
  coalesce(regexp_matches(x_mailer, '(?i)bulk|phish'), false) AS fits, false AS fits_case, subject LIKE '%Urgent%' OR subject LIKE '%lunch%' AS includes FROM m""", "m")
def helper_texts(spark, d):
    return _helped(
        spark, d, equal="h_equals(x_mailer, 'outlook')", same="h_equals(x_mailer, 'outlook', true)", has="h_contains(att_list, 'PDF')", has_exactly="h_contains(att_list, 'PDF', true)",
        begins="h_starts_with(reply_domain, 'FIRM')", ends="h_ends_with(reply_domain, 'Example')", fits="h_matches(x_mailer, 'bulk|phish')", fits_case="h_matches(x_mailer, 'bulk|phish', '')",
        includes="h_includes_any(subject, array('URGENT', 'lunch'))",
    )


_CATEGORY = "return_domain = 'sendgrid.net'"


@query(f"""SELECT path, levenshtein(from_domain, coalesce(reply_domain, '')) AS edits, from_domain = 'paypa1.com' AS near, from_domain IN ('paypa1.com', 'amazom.com') AS near_any,
  coalesce(from_domain = reply_domain, false) AS equal, CASE WHEN reply_domain IS NULL THEN '' ELSE reply_domain END AS org, coalesce(reply_domain = 'shop.co.uk' AND from_domain LIKE '%shop.co.uk', false)
    OR coalesce(reply_domain = 'firm.example' AND from_domain LIKE '%firm.example', false) AS aligned,
  coalesce(return_domain LIKE '%firm.example' OR return_domain LIKE 'bounce%', false) AS known, from_domain LIKE 'xn--%' AS punycode, coalesce({_CATEGORY}, false) AS sends,
  from_domain LIKE '%.xyz' AS cheap, contains(from_domain, 'shop') AS shop FROM m""", "m")
def helper_domains(spark, d):
    return _helped(
        spark, d, edits="h_levenshtein(from_domain, reply_domain)", near="h_looks_like(from_domain, 'PayPal.com')", near_any="h_looks_like_any(from_domain, array('paypal.com', 'amazon.com', null))",
        equal="h_domains_match(from_domain, upper(reply_domain))", org="h_registrable(reply_domain)", aligned="h_domains_align(from_domain, reply_domain)",
        known="h_trusted(return_domain, array('firm.example', '/^bounce/'))", punycode="h_punycode(from_domain)", sends="h_in_category(return_domain, 'sendgrid.net')",
        cheap="h_in_category(from_domain, '.XYZ')", shop="h_in_category(from_domain, 'Shop')",
    )


@query("""SELECT path, CASE att_list WHEN 'report.docm' THEN '.docm' WHEN 'README;a.iso' THEN '.iso' WHEN 'a.pdf;b.pdf' THEN '.pdf' WHEN 'invoice.pdf.exe;logo.png' THEN '.png' ELSE '' END AS ext,
  false AS dual, CAST(CASE att_list WHEN 'a.pdf;b.pdf' THEN 2 WHEN 'invoice.pdf.exe;logo.png' THEN 1 ELSE 0 END AS INTEGER) AS n, coalesce(att_list LIKE '%.iso', false) AS image,
  coalesce(att_list LIKE '%.pdf.exe%', false) AS any_dual FROM m""", "m")
def helper_attachments(spark, d):
    return _helped(
        spark, d, ext="h_extension(att_list)", dual="h_dual_extension(x_mailer)", n="h_count_extensions(att_names, array('.PDF', '.exe'))", image="h_any_extension(att_names, array('.iso'))",
        any_dual="h_any_dual_extension(att_names)",
    )


_HIDDEN = "(length({0}) - length(replace(replace({0}, chr(8203), ''), chr(160), '')))"
_SHARE = "(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0}))"
_BITS = f"coalesce(-list_sum(list_transform(list_distinct(string_split({{0}}, '')), lambda c: {_SHARE} * log2({_SHARE}))), 0)"
_ODD = "CASE doc_id % 4 WHEN 0 THEN subject WHEN 1 THEN chr(8203) || subject || chr(160) WHEN 2 THEN md5(CAST(doc_id AS VARCHAR(20))) || ' ' || subject END"


@query(f"""SELECT path, CAST(coalesce({_HIDDEN.format("t")}, 0) AS INTEGER) AS hidden, coalesce({_HIDDEN.format("t")}, 0) >= 1 AS any_hidden, coalesce({_HIDDEN.format("t")}, 0) >= 3 AS three_hidden,
  round({_BITS.format("t")}, 9) AS bits, coalesce(length(t) >= 20 AND {_BITS.format("t")} > 4, false) AS random, coalesce(len(list_filter(string_split(t, ' '), lambda w: length(w) >= 12 AND {_BITS.format("w")} > 3.4)) > 0, false) AS any_random
  FROM (SELECT path, {_ODD} AS t FROM m)""", "m")
def helper_oddities(spark, d):
    helpers.register(spark)
    odd = spark.sql("SELECT path, " + _ODD.replace("chr(8203)", "'\\u200b'").replace("chr(160)", "'\\u00a0'") + " AS t FROM {m}", m=V.messages(spark, d))
    return odd.select("path", *(F.expr(e).alias(n) for n, e in {
        "hidden": "h_hidden_count(t)", "any_hidden": "h_has_hidden(t)", "three_hidden": "h_has_hidden(t, 3)", "bits": "round(h_entropy(t), 9)", "random": "h_looks_random(t, 20, 4D)", "any_random": "h_any_random(t, 12, 3.4D)"
    }.items()))


# Pages ---------------------------------------------------------------------------------------------
#: References and what they mean; other text of a row is the address of a page.
_REFERENCES = {
    "caf&eacute; &Eacute;t&eacute; &euro;99": "café Été €99", "it&#8217;s &#150; 5&nbsp;km &apos;": "it’s – 5 km '", "&#1089;&#x44F;&#X1F600 &#0; &#55296; &#99999999999;": "ся\U0001f600 � � �",
    "&AMP; &bogus; &amp;lt; a&ampb &amp c": "& &bogus; &lt; a&ampb & c", "R&D & &; &#; &#x; 100&#37": "R&D & &; &#; &#x; 100%", "&hearts;&Alpha;&alpha;&there4;&lsaquo;": "♥Αα∴‹",
}
_PICK = lambda values: "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN '" + v.replace("'", "''") + "'" for k, v in enumerate(values)) + " END"
_WITH_REFERENCES = f"SELECT page_id, {_PICK(_REFERENCES)} || ' ' || url AS t FROM pages"


@query(f"SELECT page_id, {_PICK(_REFERENCES.values())} || ' ' || url AS text FROM pages")
def decoded_references(spark, d):
    pages = V.view(spark, d, "SELECT page_id, url FROM pages", "pages")
    raw = F.element_at(F.array(*map(F.lit, _REFERENCES)), (F.col("page_id") % 6 + 1).cast("int"))
    return pages.select("page_id", C.decode_references(F.concat(raw, F.lit(" "), "url")).alias("text"))


_LINKED = """SELECT path, 'see https://text.example/a).' AS t, CASE WHEN path LIKE '%1' THEN '<a href=http://bare.example/x?b=1>b</a>' WHEN path LIKE '%2' THEN '<img SRC=''ftp://one.example/p.png''>'
  WHEN path LIKE '%3' THEN '<a href = "hxxp://double.example/q,">q</a> www.said.example!' WHEN path LIKE '%4' THEN '<a href="mailto:a@b.example">m</a><a href="//rel.example/">r</a>' ELSE '' END || html AS h FROM html"""
_FOUND = r"""list_concat(regexp_extract_all(t, '(?i)\b(?:https?|hxxps?|ftp)://[^\s"''<>()\[\]]+|\bwww\.[^\s"''<>()\[\]]+'),
  list_transform(regexp_extract_all(h, '(?i)\s(?:href|src)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)'), lambda a: regexp_replace(regexp_replace(a, '(?is)^\s(?:href|src)\s*=\s*', ''), '(?s)^["''](.*)["'']$', '\1')),
  regexp_extract_all(h, '(?i)\b(?:https?|hxxps?|ftp)://[^\s"''<>()\[\]]+|\bwww\.[^\s"''<>()\[\]]+'))"""


@query(f"""SELECT path, array_to_string(list_sort(list_distinct(list_filter(list_transform({_FOUND}, lambda u: regexp_replace(trim(u), '[.,;:!?)\\]}}''"]+$', '')), lambda u: regexp_matches(u, '(?i)^(?:https?|hxxps?|ftp|www\\.)')))), ' ') AS urls
  FROM ({_LINKED})""", "html")
def message_links(spark, d):
    """Links of a text and its page, those of unquoted attributes too."""
    both = spark.sql(_LINKED.replace("FROM html", "FROM {html}"), html=V.pages(spark, d))
    return both.select("path", F.array_join(F.array_sort(C.message_urls(F.col("t"), F.col("h"))), " ").alias("urls"))


