"""Message files as bytes, written by SQL expressions so that their contents are known, and read by the decoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailcorpus.operators import domains, summaries
from mailcorpus.sources import mail

from . import evidence as E
from . import fixtures as V
from .registry import query

_HEAD = "From: =?utf-8?Q?Ann_L=C3=A9e?= <Ann@Firm.example>\nTo: b@x.example,\n  C <c@y.example>\nMessage-ID: <i{id}@firm.example>\nMIME-Version: 1.0\n"
_MIXED = """Subject: mixed {id}
Content-Type: multipart/mixed; boundary="out"

not shown
--out
Content-Type: multipart/alternative; boundary="out-in"

--out-in
Content-Type: text/plain; charset=utf-8

first {id}
--out-in
Content-Type: text/html; charset=utf-8

<p>first {id}</p>
--out-in--
--out
Content-Type: text/plain

second
--out
Content-Type: text/html

<p>more</p>
--out
Content-Type: application/octet-stream; name*=utf-8''%C3%A4{id}.pdf
Content-Disposition: attachment; filename*=utf-8''%C3%A4{id}.pdf
Content-Transfer-Encoding: base64

{data}
--out
Content-Type: text/calendar
Content-Disposition: inline
Content-ID: <cal@x>

BEGIN:VCALENDAR
--out--
"""
#: The five kinds of files; {id} is the id, {text} and {data} are base64 of a text and of bytes with the id.
_FILES = [
    _HEAD + "Subject: note\n {id}\nContent-Type: text/plain; charset=utf-8\n\nline one {id}\nline two\n",
    _HEAD + "Subject: =?utf-8?B?R3LDvMOfZQ==?= {id}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{text}\n",
    _HEAD + "Subject: =?iso-8859-1?Q?caf=E9?= {id}\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\ncaf=E9 =3D {id}=\n joined\n",
    _HEAD + _MIXED,
    _HEAD + "Subject: page {id}\nContent-Type: text/html; charset=windows-1252\nContent-Transfer-Encoding: quoted-printable\n\n<p>=93{id}=94</p>\n",
]


def _files(spark, d):
    """``(path, content)`` of a file for each document."""
    ids = V.spread(V.view(spark, d, "SELECT doc_id FROM documents", "documents"), "doc_id")
    name = F.col("doc_id").cast("string")
    text = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % 5 + 1).cast("int"))
    for mark, value in (("{id}", name), ("{text}", F.base64(F.encode(F.concat(F.lit("Grüße aus Köln "), name), "UTF-8"))), ("{data}", F.base64(F.encode(F.concat(F.lit("MZ "), name), "UTF-8")))):
        text = F.replace(text, F.lit(mark), value)
    return ids.select(F.concat(F.lit("in/m"), name, F.lit(".eml")).alias("path"), F.encode(text, "UTF-8").alias("content"))


_TEXT = "CASE doc_id % 5 WHEN 0 THEN 'line one ' || doc_id || chr(10) || 'line two' || chr(10) WHEN 1 THEN 'Grüße aus Köln ' || doc_id WHEN 2 THEN 'café = ' || doc_id || ' joined' || chr(10) WHEN 3 THEN 'first ' || doc_id || chr(10) || chr(10) || 'second' END"
_PAGE = "CASE doc_id % 5 WHEN 3 THEN '<p>first ' || doc_id || '</p><hr><p>more</p>' WHEN 4 THEN '<p>“' || doc_id || '”</p>' || chr(10) END"


@query(f"""SELECT 'in/m' || doc_id || '.eml' AS path, 'mid:<i' || doc_id || '@firm.example>' AS email_id, CASE doc_id % 5 WHEN 0 THEN 'note ' WHEN 1 THEN 'Grüße ' WHEN 2 THEN 'café ' WHEN 3 THEN 'mixed ' ELSE 'page ' END || doc_id AS subject,
  'Ann Lée' AS name, 'firm.example' AS domain, 'b@x.example;c@y.example' AS people, {_TEXT} AS text_body, {_PAGE} AS html_body, CAST(CASE WHEN doc_id % 5 = 3 THEN 2 ELSE 0 END AS INTEGER) AS attachments FROM documents""")
def parse_messages(spark, d):
    """Folded and encoded headers, base64, quoted-printable, three character sets, parts within parts."""
    m = mail.parse_messages(_files(spark, d))
    return m.select("path", "email_id", "subject", "from.name", "from.domain", F.array_join(F.transform("to", lambda p: p["address"]), ";").alias("people"), "text_body", "html_body", F.size("attachments").alias("attachments"))


@query("""SELECT 'in/m' || doc_id || '.eml' AS path, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'ä' || doc_id || '.pdf' ELSE 'attachment-2.ics' END AS filename, CASE pos WHEN 0 THEN 'application/octet-stream' ELSE 'text/calendar' END AS mime_type,
  CASE pos WHEN 0 THEN CAST(length('MZ ' || doc_id) AS BIGINT) ELSE 15 END AS size, CASE pos WHEN 0 THEN sha256('MZ ' || doc_id) ELSE sha256('BEGIN:VCALENDAR') END AS sha256, pos = 1 AS is_inline, CASE pos WHEN 1 THEN 'cal@x' END AS content_id
  FROM documents, (VALUES (0), (1)) v(pos) WHERE doc_id % 5 = 3""")
def bodies(spark, d):
    """Parts that are no text of the message are its attachments, numbered, those without a name with a guessed ending."""
    m = mail.parse_messages(_files(spark, d))
    return m.select("path", F.explode("attachments").alias("a")).select("path", "a.pos", "a.filename", "a.mime_type", "a.size", "a.sha256", "a.is_inline", "a.content_id")


# Counts that need several tables -------------------------------------------------------------------
_CATEGORY = "CASE WHEN from_domain IN ('paypal.com') THEN 'Payment Processor' WHEN from_domain = 'bit.ly' THEN 'URL Shortener' WHEN from_domain LIKE '%.xyz' THEN 'Suspicious / Free TLD' END"
_LINKED = "CASE WHEN doc_id % 11 = 5 AND doc_id % 4 = 3 THEN 'URL Shortener' END"


def _with_categories(spark, d):
    f = E._boxed(spark, d).withColumn("url_domains", V.C.url_hosts(V.C.message_urls(F.col("text_body"), F.col("html_body"))))
    hosts = f.select("path", "from_domain", F.array_union(F.array("from_domain"), F.coalesce("url_domains", F.array().cast("array<string>"))).alias("domains"))
    return hosts.join(domains.categories(hosts), "path", "left")


@query(f"SELECT 'categories' AS type, value, count(*) AS email_count FROM (SELECT path, {_CATEGORY} AS value FROM b UNION SELECT path, {_LINKED} FROM b) WHERE value IS NOT NULL GROUP BY value", "m", "b")
def indicator_categories(spark, d):
    """Messages by category of any of their domains, as the export lists them."""
    return summaries.indicators(_with_categories(spark, d).drop("from_domain"))


@query(f"SELECT value, count(*) AS email_count FROM (SELECT path, {_CATEGORY} AS value FROM b UNION SELECT path, {_LINKED} FROM b) WHERE value IS NOT NULL GROUP BY value", "m", "b")
def facet_categories(spark, d):
    return summaries.facets(_with_categories(spark, d), "categories")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE size <= 5000) AS indexed, count(*) FILTER (WHERE size > 5000) AS skipped, count(*) FILTER (WHERE doc_id % 8 IN (0, 3)) AS with_images,
  count(*) FILTER (WHERE doc_id % 8 = 0) AS with_text FROM m""", "m")
def corpus_coverage(spark, d):
    """Messages read and skipped, those with images, and those of whose images a text is known."""
    m = V.messages(spark, d)
    key = lambda name: F.sha2(name, 256)
    images = F.filter(F.coalesce("att_names", F.array().cast("array<string>")), lambda n: n.rlike(r"(?i)\.(?:png|pdf)$"))
    pictures = m.select("path", F.explode(F.transform(images, key)).alias("sha256"))
    known = spark.createDataFrame([("logo.png", "a logo")], "name string, ocr_text string").select(key(F.col("name")).alias("sha256"), "ocr_text")
    return summaries.coverage(m.select("path", (F.col("size") > 5000).alias("skipped")), pictures, known)
