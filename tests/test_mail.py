"""Parsing, calendars, streams, tags on disk, and clean messages that raise no flag."""

from email.message import EmailMessage

from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.operators import checks, domains, headers, search, tags
from mailcorpus.sources import mail
from mailcorpus.streaming.ingest import ingest


def _write(folder):
    folder.mkdir(exist_ok=True)
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = "Ann Lee <ann@firm.example>", "b@x.example, C <c@y.example>", "Grüße aus Köln", "<1@firm.example>"
    m["Date"] = "Mon, 01 Jan 2024 10:00:00 +0100"
    m.set_content("Hello there\n")
    m.add_alternative("<p>Hello <b>there</b></p>", subtype="html")
    m.add_attachment(b"MZ\x90\x00rest", maintype="application", subtype="octet-stream", filename="a.pdf")
    (folder / "one.eml").write_bytes(m.as_bytes())
    (folder / "two.eml").write_bytes(b"Subject: =?utf-8?B?w6k=?=\r\nReceived: from a.net.example (x [203.0.113.5]) by b.net.example with ESMTP id 7; Mon, 1 Jan 2024 10:00:00 +0000\r\n\r\nbody")
    (folder / "empty.eml").write_bytes(b"")
    (folder / "note.txt").write_bytes(b"no mail")


def test_parse(spark, tmp_path):
    _write(tmp_path / "box")
    files = mail.mail_files(mail.scan_corpus(spark, str(tmp_path / "box")))
    rows = {r.path.rsplit("/", 1)[1]: r for r in mail.parse_messages(files).collect()}
    assert set(rows) == {"one.eml", "two.eml"}  # Spark lists no empty files
    one = rows["one.eml"]
    assert one.subject == "Grüße aus Köln" and one["from"].domain == "firm.example" and [p.address for p in one.to] == ["b@x.example", "c@y.example"]
    assert one.email_id == "mid:<1@firm.example>" and one.text_body == "Hello there\n" and one.html_body.startswith("<p>Hello") and one.date.hour == 9
    assert [(a.filename, a.size, bytes(a.head8)[:2]) for a in one.attachments] == [("a.pdf", 8, b"MZ")]
    assert rows["two.eml"].subject == "é" and rows["two.eml"].email_id.startswith("hash:")
    table = headers.headers_table(spark.createDataFrame([rows["two.eml"]], mail.parse_messages(files).schema))
    hop = headers.hops(table.where("lower = 'received'").select("path", "pos", "value")).first()
    assert (hop.from_host, hop.from_ip, hop.by_host, hop.with_, hop.id) == ("a.net.example", "203.0.113.5", "b.net.example", "ESMTP", "7") and hop.ts is not None


def test_stream_reads_each_file_once(spark, tmp_path):
    _write(tmp_path / "in")
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "progress")).awaitTermination(120)
    assert spark.read.schema(mail.MESSAGES).parquet(str(tmp_path / "table")).count() == 2


def test_calendar(spark):
    text = "BEGIN:VCALENDAR\r\nMETHOD:REQUEST\r\nBEGIN:VEVENT\r\nSUMMARY:Long\r\n  title\r\nDTSTART;TZID=Europe/Berlin:20240101T100000\r\nORGANIZER;CN=A:mailto:a@x.example\r\nATTENDEE;CN=B:mailto:b@x.example\r\nEND:VEVENT\r\nEND:VCALENDAR"
    good, bad = sorted(mail.calendar_events(spark.createDataFrame([("a", text), ("b", "nothing")], "path string, text string")).collect())
    assert (good.method, good.summary, good.dtstart, good.organizer, good.attendees, good.reason) == ("REQUEST", "Long title", "20240101T100000", "a@x.example", ["b@x.example"], None)
    assert bad.reason == "no event" and bad.summary is None


def test_tags_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", "x", "manual", None), ("a", "y", "rule", "r1")], "email_id string, tag string, source string, rule_id string")
    tags.write_tags(t, str(tmp_path / "tags"))
    assert sorted(tags.read_tags(spark, str(tmp_path / "tags")).collect()) == sorted(t.collect())
    off = tags.switched_off(spark.createDataFrame([("r1", "y", True), ("r2", "z", True)], "rule_id string, tag string, enabled boolean"), "y")
    assert {r.rule_id: r.enabled for r in off.collect()} == {"r1": False, "r2": True}


def test_a_bad_rule_is_reported(spark):
    facts = spark.createDataFrame([("p", "e", 3)], "path string, email_id string, n int")
    rows = {r.rule_id: r for r in tags.run_rules(facts, [("ok", "n > 2"), ("bad", "nosuch > 1")]).collect()}
    assert rows["ok"].matched and not rows["bad"].matched and rows["bad"].error


def test_clean_message_has_no_strong_flag(spark):
    row = [("p", "Team lunch", "Ann Lee", "firm.example", "firm.example", "firm.example", "<1@firm.example>", ["menu.pdf"], "See you at noon in the hall", None, None)]
    facts = spark.createDataFrame(row, "path string, subject string, from_name string, from_domain string, reply_domain string, return_domain string, message_id string, att_names array<string>, body string, in_reply_to string, x string")
    assert checks.check_rows(facts).where("status = 'flag'").count() == 0


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(C.sniffed_type(lit(bytearray(b"MZ\x90\x00")))) == "exe" and one(C.sniffed_type(lit(bytearray(b"#!/b")))) == "script"
    assert tuple(one(C.hidden_chars(lit("a‍b‮c​")))) == (2, 1, 1)
    assert one(C.script_profile(lit("привет мир abc"))) == ["cyrillic", "latin"] and one(C.mixed_script_words(lit("pаypal ok"))) == 1
    assert one(C.financial_indicators(lit("Send an Apple gift card, routing no. 123456789"))) == ["routing_number", "gift_card_request"]
    assert one(C.is_private_ip(lit("172.20.1.1"))) and not one(C.is_private_ip(lit("8.8.8.8"))) and one(C.is_private_ip(lit("fe80::1")))
    age = one(C.domain_age(lit('{"entities":[{"roles":["registrar"],"name":"R"}],"events":[{"eventAction":"registration","eventDate":"2024-01-01T00:00:00Z"}]}'), F.to_date(lit("2024-01-11"))))
    assert (age.registrar, age.days) == ("R", 10)
    assert one(C.domain_age(lit("no json"), F.current_date())).days is None


def test_unresolved_leaves_match_nothing_and_warn(spark):
    s = search.Search(spark.createDataFrame([("p", "hello", 1)], "path string, subject string, size int"))
    for p in (s.term("x"), s.num("size", ">", "many"), s.field_regex("subject", "("), s.script("subject", "runic"), s.header_contains("x-a", "b")):
        assert p.warnings and s.where(p).count() == 0 and s.where(~p).count() == 1


def test_confusable_domains(spark):
    m = spark.createDataFrame([("a", "paypal.com"), ("b", "pаypal.com"), ("c", "other.example")], "path string, from_domain string")
    skeletons = spark.createDataFrame([("pаypal.com", "paypal.com"), ("paypal.com", "paypal.com")], "host string, skeleton string")
    assert [r.path for r in domains.confusables(m, ["paypal.com"], skeletons).collect()] == ["b"]


def test_pick_image(spark):
    a = [("image/png", 100), ("text/plain", 9000), ("image/gif", 9000), ("image/png", 9001)]
    df = spark.createDataFrame([("p", [x for x in a]), ("q", [])], "path string, attachments array<struct<mime_type:string,size:long>>")
    assert {r.path: r.x and r.x.size for r in df.select("path", C.pick_image(F.col("attachments")).alias("x")).collect()} == {"p": 9000, "q": None}
