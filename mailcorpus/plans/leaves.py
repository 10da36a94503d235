"""Queries on single predicates and columns that the other queries do not reach."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import hosts
from mailcorpus.operators import domains, search, tags
from mailcorpus.shared import new_folder
from mailcorpus.sources import mail

from . import evidence as E
from . import fixtures as V
from .registry import query


def _searched(name: str, build, condition: str, *more):
    """Paths that a predicate finds in assembled messages, and the same in SQL."""

    def run(spark, d):
        s = search.Search(_wide(spark, d))
        return s.where(build(s)).select("path")

    run.__name__ = name
    query(f"SELECT path FROM b WHERE {condition}", "m", "b", *more)(run)


def _wide(spark, d):
    b = E._boxed(spark, d)
    sums = F.transform(F.coalesce(F.split("att_list", ";"), F.array().cast("array<string>")), lambda n: F.sha2(n, 256))
    named = F.create_map(F.lit("x-team"), F.concat(F.lit("team "), (F.col("doc_id") % 3).cast("string")), F.lit("received"), F.lit("from a.example"))
    public = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("203.0.113."), (F.col("doc_id") % 200).cast("string")))
    return b.withColumns({"att_sha256s": sums, "header_texts": named, "message_id": F.concat(F.lit("<Id"), "doc_id", F.lit("@Firm.example>")), "origin_ip": public, "connecting_ip": public})


_searched("search_header", lambda s: s.header_contains("X-Team", "TEAM 2"), "doc_id % 3 = 2")
_searched("search_attachment_digest", lambda s: s.att_sha256(hashlib.sha256(b"README").hexdigest().upper()), "att_list LIKE 'README%'")
_searched("search_message_id", lambda s: s.message_id("<id21@firm.EXAMPLE>") | s.message_id("<id22@firm.example>"), "doc_id IN (21, 22)")
_searched("search_address", lambda s: s.meta_contains("origin_ip", "113.17") & ~s.meta_contains("connecting_ip", "113.177"), "doc_id % 4 <> 0 AND contains('203.0.113.' || (doc_id % 200), '113.17') AND doc_id % 200 <> 177")


@query(f"SELECT path FROM ({E._FLAGS}) WHERE flag IN ('confusable-domain', 'punycode', 'auth-results-planted') GROUP BY path HAVING bool_or(flag <> 'punycode')", "m", "b")
def search_flag(spark, d):
    """``flag(id)`` over all flags of a message, those of the sender too."""
    s = search.Search(E._flagged(spark, d))
    return s.where((s.flag("confusable-domain") & s.flag("punycode")) | s.flag("auth-results-planted")).select("path")


_HEADS = ["4D5A90000300", "7F454C4601010100", "CFFAEDFE07000001", "4C0000000114020000", "23212F62696E2F7368", "255044462D312E", "4D5A", ""]
_KINDS = ["exe", "elf", "macho", "lnk", "script", "", "", ""]


@query("SELECT doc_id, list_extract([" + ", ".join(f"'{k}'" for k in _KINDS) + "], CAST(doc_id % 8 + 1 AS INTEGER)) AS kind FROM documents")
def sniffed_types(spark, d):
    m = V.messages(spark, d)
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 8 + 1).cast("int")))
    return m.select("doc_id", C.sniffed_type(head).alias("kind"))


@query("""SELECT path, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'REQUEST' END AS method, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'Lunch ' || doc_id END AS summary,
  CASE doc_id % 4 WHEN 0 THEN '20240101T100000Z' WHEN 1 THEN '20240101T100000' WHEN 2 THEN '20240101' END AS dtstart, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'a@x.example' END AS organizer,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'b@x.example;u' || doc_id || '@y.example' END AS people, CASE WHEN doc_id % 4 = 3 THEN 'no event' END AS reason FROM m""", "m")
def calendar_events(spark, d):
    """Folded lines, UTC, local and all-day starts, and texts that hold no event."""
    start = F.expr("CASE doc_id % 4 WHEN 0 THEN ':20240101T100000Z' WHEN 1 THEN ';TZID=Europe/Berlin:20240101T100000' ELSE ';VALUE=DATE:20240101' END")
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nMETHOD:REQUEST\r\nBEGIN:VEVENT\r\nSUMMARY:Lun\r\n ch "), "doc_id", F.lit("\r\nDTSTART"), start, F.lit("\r\nORGANIZER;CN=A:mailto:a@x.example\r\nATTENDEE;CN=B:mailto:b@x.example\r\nATTENDEE:MAILTO:u"), "doc_id", F.lit("@y.example\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    rows = mail.calendar_events(V.messages(spark, d).select("path", F.when(F.col("doc_id") % 4 == 3, "BEGIN:VCALENDAR").otherwise(text).alias("text")))
    found = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return rows.select("path", "method", "summary", "dtstart", found("organizer"), F.array_join("attendees", ";").alias("people"), "reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'Registrar ' || (doc_id % 5) END AS registrar, CASE WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS created,
  CASE WHEN doc_id % 3 = 0 THEN CAST(31 - doc_id % 28 AS INTEGER) END AS days FROM documents""")
def domain_ages(spark, d):
    """Stored registration answers: complete, without a date, and unreadable."""
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    who = F.concat(F.lit('{"entities":[{"roles":["abuse"],"name":"Q"},{"roles":["registrar"],"name":"Registrar '), (F.col("doc_id") % 5).cast("string"), F.lit('"}]'))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(who, F.lit(',"events":[{"eventAction":"registration","eventDate":"2024-01-'), day, F.lit('T00:00:00Z"}]}'))).when(F.col("doc_id") % 3 == 1, F.concat(who, F.lit("}"))).otherwise("no json")
    return V.messages(spark, d).select("doc_id", C.domain_age(answer, F.to_date(F.lit("2024-02-01"))).alias("a")).select("doc_id", "a.registrar", F.col("a.created").cast("string").alias("created"), "a.days")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'b.gif' WHEN 1 THEN 'c.png' END AS name FROM documents")
def picked_images(spark, d):
    """The first image of a size that is worth reading."""
    part = lambda name, kind, size: F.struct(F.lit(name).alias("filename"), F.lit(kind).alias("mime_type"), F.lit(size).cast("long").alias("size"))
    some = F.when(F.col("doc_id") % 4 == 0, F.array(part("a.png", "image/png", 512), part("b.gif", "image/gif", 513), part("c.png", "image/png", 900)))
    some = some.when(F.col("doc_id") % 4 == 1, F.array(part("t.txt", "text/plain", 900), part("d.png", "image/png", 8 << 20), part("c.png", "image/png", 9000))).when(F.col("doc_id") % 4 == 2, F.array(part("t.txt", "text/plain", 900)))
    return V.messages(spark, d).select("doc_id", C.pick_image(some)["filename"].alias("name"))


@query("SELECT path, 'paypal.com' AS imitates FROM b WHERE doc_id % 36 = 3", "m", "b")
def confusable_senders(spark, d):
    """Domains that look like a listed one once their letters are replaced by the Latin ones they imitate."""
    b = E._boxed(spark, d).select("path", "from_domain")
    return domains.confusables(b, ["paypal.com", "amazon.com"], hosts.host_table(b, "from_domain")).select("path", "imitates")


@query("SELECT DISTINCT email_id, tag, source, rule_id FROM tagged", "tagged")
def tags_on_disk(spark, d):
    """All tag records written as JSON lines and read again."""
    folder = new_folder(spark, "tags")
    tags.write_tags(V.tags(spark, d), folder)
    return tags.read_tags(spark, folder).distinct()


@query("SELECT 'header' AS facet, lower(name) AS value, count(DISTINCT path) AS email_count FROM (" + E.HEADERS + ") GROUP BY 2", "m", "b")
def facet_headers(spark, d):
    """Messages with each header name."""
    table = E.header_rows(spark, d)
    return table.groupBy("path", "lower").agg(F.count("*").alias("n")).groupBy(F.col("lower").alias("value")).agg(F.count("*").alias("email_count")).select(F.lit("header").alias("facet"), "value", "email_count")
