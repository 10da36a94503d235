"""Profiles of letters and hidden characters against plain Python, and the plan of the checklist's assembly."""

import re

from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X
from mailcorpus.operators import checks, evidence

TEXTS = [
    "", "plain words only", "123 ... !", "été déjà vu œuvre", "привет мир abc", "αβγδ ελ", "aа аb", "한국어 텍스트 입니다", "漢字とひらがなとカタカナ", "ไทย ก", "שלום עולם", "مرحبا بالعالم",
    "नमस्ते दुनिया", "Բարեւ", "mostly latin words and then one more sentence of them, and д", "é", "д", "﻿word ​of‍ ‮⁦ a‍b", "🙂 smile 🙂", "ﬀ ℝ ⅷ ǆ ʰ", "x" * 500 + "д" * 20,
    "www.a.example", "see HTTPS://b.example/x, ok", "WWW.C.example.", "​http://d.example", "SWIFT code DEUTDEFF500", "gift", "Apple GIFT cards", "bic ABCDEFGH", "0x" + "a" * 40, "routing 123456789",
]


def profile(text):
    counts = {s: len(re.findall(f"[{r}]", text)) for s, r in X.SCRIPTS.items()}
    used = sorted((s for s in counts if counts[s]), key=lambda s: (-counts[s], list(X.SCRIPTS).index(s)))
    large = [s for s in used if counts[s] >= 3 and counts[s] >= 0.05 * sum(counts.values())]
    if text.isascii():
        return ["latin"] if counts["latin"] else []
    return large or used[:1]


def hidden(text):
    text = re.sub("^﻿", "", text)
    zero = len(re.findall("[​⁠-⁤﻿]", text)) + len(re.findall("(?<=[A-Za-z0-9])[‌‍](?=[A-Za-z0-9])", text))
    over = len(re.findall("[‭‮]", text))
    return zero, over + len(re.findall("[‪-‬⁦-⁩]", text)), over


def links(text):
    found = [re.sub(r"[.,;:!?)\]}'\"]+$", "", u) for u in re.findall(C.URL, text)]
    return list(dict.fromkeys(u for u in found if u))


def test_profiles(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").repartition(2)
    t = F.col("t")
    rows = df.select("t", C.script_profile(t).alias("s"), C.hidden_chars(t).alias("h"), C.urls(t).alias("u"), C.financial_indicators(t).alias("f"), C.strip_invisible(t).alias("v"), C.mixed_script_words(t).alias("m")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if r.t is None:
            assert r.s == [] and r.u is None and r.v is None and r.f == []
            continue
        assert r.s == profile(r.t), r.t
        assert tuple(r.h) == hidden(r.t), r.t
        assert r.u == links(r.t), r.t
        assert r.v == re.sub(X.INVISIBLE, "", r.t), r.t
        assert r.f == [k for k, p in X.FINANCIAL.items() if re.search(p, r.t)], r.t


def _stored(spark, rows, heads):
    messages = spark.createDataFrame(rows, "path string, from_domain string, url_domains array<string>, subject string, text_body string, html_body string")
    table = spark.createDataFrame(heads, "path string, pos int, name string, value string").withColumn("lower", F.lower("name"))
    return evidence.stored(messages, table, 4)


def test_assembly_shuffles_no_headers(spark):
    """Only hosts of links, and what is known of them, change places."""
    rows = [(f"m{k}", "a.example", ["b.example"], "s", "some text", None) for k in range(40)] + [(None, None, None, None, None, None)]
    heads = [(f"m{k}", p, n, v) for k in range(40) for p, (n, v) in enumerate([("Received", "from a by b.example; Mon, 1 Jan 2024 10:00:00 +0000"), ("Authentication-Results", "b.example; spf=pass"), ("Authentication-Results", "b.example; spf=fail"), ("Subject", "x")])]
    messages, table = _stored(spark, rows, heads)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evidence.assemble(messages, table, ["a.example"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(path", plan)) == 1 and "Exchange hashpartitioning(host" in plan
        got = {r.path: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 41 and got["m3"].hop_count == 1 and got[None].hop_count == 0
    assert all(r.forgery == ["auth-results-conflict"] for p, r in got.items() if p)


def test_assembly_of_nothing(spark):
    messages, table = _stored(spark, [], [])
    assert evidence.assemble(messages, table).count() == 0
    assert checks.check_rows(messages, {"no such check"}).columns == ["path", "check", "status", "flags"]
