"""Mail-like views that Spark derives from the given tables; the SQL also runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C

_ID = "'mid:' || CAST(CASE WHEN doc_id % 10 < 2 THEN doc_id - doc_id % 10 ELSE doc_id END AS VARCHAR(20))"
M = f"""
SELECT doc_id, {_ID} AS email_id,
  'box' || CAST(doc_id % 7 AS VARCHAR(20)) || '/m' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.eml' END AS path,
  CASE doc_id % 6 WHEN 0 THEN 'Re: invoice' WHEN 1 THEN 'Urgent payment' WHEN 2 THEN 'Team lunch' WHEN 3 THEN 'Your order' WHEN 4 THEN 'pаypal notice' ELSE 'note' END || ' ' || CAST(doc_id % 97 AS VARCHAR(20)) AS subject,
  CASE doc_id % 5 WHEN 0 THEN 'PayPal Support' WHEN 1 THEN 'Ann Lee' WHEN 2 THEN 'ceo@firm.example' ELSE '' END AS from_name,
  CASE doc_id % 9 WHEN 0 THEN 'paypal.com' WHEN 1 THEN 'paypa1.com' WHEN 2 THEN 'mail.firm.example' WHEN 3 THEN 'xn--e1afmkfd.example' WHEN 4 THEN 'shop.co.uk' WHEN 5 THEN 'news.shop.co.uk' WHEN 6 THEN 'bit.ly' WHEN 7 THEN 'amazom.com' ELSE 'free.xyz' END AS from_domain,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'firm.example' WHEN 2 THEN 'shop.co.uk' ELSE 'elsewhere.example' END AS reply_domain,
  CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'softfail' ELSE NULL END AS spf,
  CASE doc_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' ELSE 'pass' END AS dkim,
  CASE doc_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN NULL ELSE 'pass' END AS dmarc,
  CASE doc_id % 6 WHEN 0 THEN 'sendgrid.net' WHEN 1 THEN 'mail.firm.example' WHEN 2 THEN NULL ELSE 'bounce.example' END AS return_domain,
  'a@x.example;B@x.example;b@x.example;u' || CAST(doc_id % 31 AS VARCHAR(20)) || '@y.example' AS recipients,
  doc_id * 7 % 700 AS recipient_count_hint,
  CASE doc_id % 12 WHEN 0 THEN 'BulkMailer 2' WHEN 1 THEN 'Outlook' ELSE NULL END AS x_mailer,
  CASE doc_id % 8 WHEN 0 THEN 'invoice.pdf.exe;logo.png' WHEN 1 THEN 'report.docm' WHEN 2 THEN 'README;a.iso' WHEN 3 THEN 'a.pdf;b.pdf' ELSE NULL END AS att_list,
  1704067200000 + doc_id * 60000 AS date_ms, n_chars AS size,
  text || CASE WHEN doc_id % 11 = 0 THEN ' urgent: wire transfer to GB29NWBK60161331926819 asap' WHEN doc_id % 11 = 5 THEN ' see http://bit.ly/x1 and www.shop.co.uk/a?b=1.' ELSE '' END AS body
FROM documents
"""
HOPS = """
SELECT 'm' || CAST(event_id - event_id % 5 AS VARCHAR(20)) AS path, event_id % 5 + 1 AS idx,
  CASE WHEN event_id % 23 = 0 THEN 'odd.example' WHEN event_id % 5 = 4 THEN 'localhost' ELSE 'mx' || CAST(event_id % 5 AS VARCHAR(20)) || '.net.example' END AS by_host,
  CASE WHEN event_id % 5 = 0 THEN 'home.lan' WHEN event_id % 19 = 0 THEN 'relay.other.example' ELSE 'mx' || CAST(event_id % 5 - 1 AS VARCHAR(20)) || '.net.example' END AS from_host,
  CASE event_id % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '203.0.113.' WHEN 2 THEN '192.168.1.' ELSE '198.51.100.' END || CAST(event_id % 250 AS VARCHAR(20)) AS from_ip,
  CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL '1' HOUR WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS ts
FROM events
"""
AUTH = """
SELECT 'm' || CAST(event_id - event_id % 5 AS VARCHAR(20)) AS path, event_id % 5 AS pos, CASE WHEN event_id % 3 = 0 THEN 'mx1.net.example' ELSE 'mx2.net.example' END AS authserv,
  CASE event_id % 2 WHEN 0 THEN 'spf' ELSE 'dkim' END AS method, CASE WHEN event_id % 7 = 0 THEN 'fail' ELSE 'pass' END AS result
FROM events
"""
TAGS = f"""
SELECT {_ID} AS email_id, 'toxic' AS tag, 'rule' AS source, 'r1' AS rule_id FROM labels WHERE toxic = 1
UNION ALL SELECT {_ID}, CASE WHEN doc_id % 3 = 0 THEN 'toxic' ELSE 'good' END, 'manual', NULL FROM labels WHERE quality = 1
"""
HTML = """
SELECT 'p' || CAST(page_id AS VARCHAR(20)) AS path, url,
  CASE page_id % 3
    WHEN 0 THEN '<p>Hi <a href="http://evil.example/x?a=1">www.paypal.com</a></p><span style="display:none">secret words</span>'
    WHEN 1 THEN '<a href="https://www.shop.example/">shop.example</a><img src="http://track.example/p.gif">'
    ELSE '<div style="color:#fff;background:#fff">hidden text</div><a href="/rel">local</a>' END || html AS html
FROM pages
"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A view over the given tables, without names in the session's catalog."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def spread(ids: DataFrame, key: str) -> DataFrame:
    """Ids dealt over all cores before work is made of them: a file of one row group is read by one task."""
    return ids.repartition(4 * ids.sparkSession.sparkContext.defaultParallelism, key)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, M, "documents")
    people = F.split("recipients", ";")
    return m.withColumns({"att_names": F.split("att_list", ";"), "to_text": F.col("recipients"), "from_address": F.concat(F.lit("u@"), "from_domain"), "reply_text": F.col("reply_domain"), "return_text": F.col("return_domain"), "att_names_text": F.col("att_list"), "recipient_count": F.size(F.array_distinct(F.transform(people, F.lower)))})


def facts(spark: SparkSession, sf_dir: str, scanned: int | None = None) -> DataFrame:
    """Messages with the derived columns that searches and summaries read.

    Signs of urgency and money are looked for in whole bodies, or in the ``scanned`` first characters of them.
    """
    m = messages(spark, sf_dir)
    body = F.substring("body", 1, scanned) if scanned else F.col("body")
    names = F.coalesce("att_names", F.array().cast("array<string>"))
    m = m.withColumns({"urls": C.urls(C.strip_invisible(F.col("body"))), "att_exts": F.transform(names, C.extension), "attachment_count": F.size(names), "urgency_score": C.urgency_score(body), "financial": C.financial_indicators(body), "subject_scripts": C.script_profile(F.col("subject"))})
    return m.withColumns({"url_domains": C.url_hosts(F.col("urls")), "url_count": F.size("urls"), "urls_text": F.array_join("urls", " ")})


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HOPS, "events")


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, AUTH, "events")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TAGS, "labels")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HTML, "pages")
