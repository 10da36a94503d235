"""Tables made from headers: hops, trust results, and what contradicts itself in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X


def headers_table(messages: DataFrame) -> DataFrame:
    """A row for each header in order, the k-th of n with its name."""
    one = messages.select("path", F.explode("headers").alias("h")).select("path", "h.pos", "h.name", "h.lower", "h.value")
    same = W.partitionBy("path", "lower")
    return one.withColumn("k", F.row_number().over(same.orderBy("pos"))).withColumn("n", F.count("*").over(same))


def header_texts(headers: DataFrame, cap: int = X.HEADER_NAMES_CAP) -> DataFrame:
    """``(path, header_texts)``: lower-case values by name; names beyond ``cap`` share the name ``*``."""
    named = headers.groupBy("path", "lower").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.lower(x["value"])), " ").alias("text"))
    named = named.withColumn("name", F.when(F.row_number().over(W.partitionBy("path").orderBy("first")) <= cap, F.col("lower")).otherwise("*"))
    named = named.groupBy("path", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), " ").alias("text"))
    return named.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("header_texts"))


def hops(received: DataFrame) -> DataFrame:
    """``received(path, pos, value)`` -> hops, oldest first, with their parts and time.

    ``from_ip`` is read from the comment after the sending host: in brackets, bare IPv4, or bare
    IPv6 (only with :: or all eight groups, so that no time of day is one).
    """
    v = F.regexp_replace("value", r"\s+", " ")
    body = F.when(v.contains(";"), F.regexp_extract(v, r"^(.*);", 1)).otherwise(v)
    text = F.regexp_replace(F.regexp_extract(v, r";\s*(?:[A-Za-z]{3},\s*)?([^;(]*?)\s*(?:\([^)]*\))?\s*$", 1), r"\s+", " ")
    part = lambda p, k=1, of=body: F.nullif(F.regexp_extract(of, p, k), F.lit(""))
    comment = F.trim(F.regexp_extract(body, r"(?i)\bfrom\s+\S+\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1))
    bare = F.regexp_extract(comment, r"(?:^|[\s(])([0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7})(?=$|[\s)])", 1)
    bare = F.when(bare.contains("::") | (F.size(F.split(bare, ":")) == 8), bare)
    ip = F.coalesce(part(r"\[(?:IPv6:)?([0-9A-Fa-f:.]+)\]", of=comment), part(r"\b((?:\d{1,3}\.){3}\d{1,3})\b", of=comment), bare)
    out = received.select(
        "path", "pos", part(r"(?i)\bfrom\s+([^\s(]+)").alias("from_host"), F.nullif(comment, F.lit("")).alias("from_comment"), ip.alias("from_ip"), part(r"(?i)\bby\s+(\S+)").alias("by_host"),
        part(r"(?i)\bwith\s+(.+?)(?=\s+(?:id|for|by|from|via)\b|\s*\(|\s*;|$)").alias("with_"), part(r"(?i)\bid\s+<?([^\s;>]+)").alias("id"), part(r"(?i)\bfor\s+<?([^\s;>]+)").alias("for_address"),
        F.nullif(text, F.lit("")).alias("date_text"), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")).alias("ts"),
    )
    return out.withColumn("idx", F.row_number().over(W.partitionBy("path").orderBy(F.desc("pos")))).where(F.col("idx") <= X.HOP_CAP)


def _plain_host(name: Column) -> Column:
    """Lower case, without brackets and the dot at the end."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^\[(?:ipv6:)?|\]$|\.$", "")


def hand_offs(pairs: DataFrame) -> DataFrame:
    """Adds ``hand_off``: whether a hop names the receiver ``before`` it, ok, broken or unknown.

    ``before``, ``from_host``, ``from_comment`` and ``from_ip`` are compared. The same host or
    organisation, the receiver named in the comment, or its address count as the same; without a
    name, or with a local one, nothing can be said. Addresses are compared in one form, so
    2001:DB8::1 is 2001:db8:0:0:0:0:0:1. Each form is a column of its own and made once.
    """
    kept = pairs.columns
    pairs = pairs.withColumns({"_by": _plain_host(F.col("before")), "_from": _plain_host(F.col("from_host")), "_said": F.lower(F.coalesce("from_comment", F.lit("")))})
    pairs = pairs.withColumns({"_by_ip": C.canonical_ip(F.col("_by")), "_from_ip": C.canonical_ip(F.col("_from")), "_ip": C.canonical_ip(F.coalesce("from_ip", F.lit("")))})
    pairs = pairs.withColumns({"_by_org": F.coalesce("_by_ip", C.registrable_domain(F.col("_by"))), "_from_org": F.coalesce("_from_ip", C.registrable_domain(F.col("_from"))), "_by": F.coalesce("_by_ip", "_by"), "_from": F.coalesce("_from_ip", "_from")})
    by, sender, said = F.col("_by"), F.col("_from"), F.col("_said")
    named = said.contains(by) | ((F.col("_by_org") != by) & said.contains(F.col("_by_org")))
    same = (by == sender) | (F.col("_by_org") == F.col("_from_org")) | F.coalesce(F.col("_by_ip") == F.col("_ip"), F.lit(False))
    state = (
        F.when((by == "") | ((sender == "") & (said == "")) | by.rlike(X.LOCAL_HOST), "unknown").when(named, "ok")
        .when((sender == "") | sender.rlike(X.LOCAL_HOST), "unknown").when(same, "ok").otherwise("broken")
    )
    return pairs.select(*kept, state.alias("hand_off"))


def chain(hops_: DataFrame) -> DataFrame:
    """Hops with ``delay_ms`` since the one before and the state of the hand-off from it."""
    order = W.partitionBy("path").orderBy("idx")
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    out = hops_.withColumns({c: F.lit(None).cast("string") for c in ("from_comment", "from_ip") if c not in hops_.columns})
    out = out.withColumns({"delay_ms": (millis - F.lag(millis).over(order)).cast("long"), "before": F.lower(F.lag("by_host").over(order))})
    out = hand_offs(out).withColumn("state", F.when(F.col("idx") > 1, F.col("hand_off"))).drop("hand_off")
    return out.withColumn("travels", F.coalesce(F.col("delay_ms") < -300_000, F.lit(False)))


def chain_totals(chained: DataFrame) -> DataFrame:
    """Of each message: hops, broken links, clocks that go back, total time and the slowest link."""
    out = chained.groupBy("path").agg(
        F.count("*").alias("hops"), F.count_if(F.col("state") == "broken").alias("broken"), F.count_if("travels").alias("backwards"),
        F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("total_ms"), F.max("delay_ms").alias("slowest_ms"), F.count_if(F.col("delay_ms") < 0).alias("negatives"),
        F.max_by("idx", F.struct("delay_ms", (-F.col("idx")))).alias("slowest_idx"),
    )
    return out.withColumn("slowest_idx", F.when(F.col("slowest_ms").isNotNull(), F.col("slowest_idx")))


def sender_ips(hops_: DataFrame) -> DataFrame:
    """Earliest and newest public address of each message, and whether all are private."""
    public = F.when(F.col("from_ip").isNotNull() & ~C.is_private_ip(F.col("from_ip")), F.col("idx"))
    out = hops_.groupBy("path").agg(F.min_by("from_ip", public).alias("origin_ip"), F.max_by("from_ip", public).alias("connecting_ip"), F.count("from_ip").alias("_n"), F.count(public).alias("_p"))
    return out.withColumn("internal_only", (F.col("_n") > 0) & (F.col("_p") == 0)).drop("_n", "_p")


def first_gap(messages: DataFrame, hops_: DataFrame) -> DataFrame:
    """Milliseconds from the Date header (date_ms) to the first hop."""
    first = hops_.where("idx = 1").select("path", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("_first"))
    return messages.join(first, "path").select("path", (F.col("_first") - F.col("date_ms")).cast("long").alias("first_gap_ms"))


def readable_delay(ms):
    """A signed delay as text: ms, s, m s, h m."""
    a = F.abs(ms)
    sign = F.when(ms < 0, "-").otherwise("+")
    whole = lambda x: F.floor(x).cast("string")
    text = F.when(a < 1000, F.concat(whole(a), F.lit(" ms"))).when(a < 60_000, F.concat(whole(a / 1000), F.lit(" s"))).when(a < 3_600_000, F.concat(whole(a / 60_000), F.lit(" min"))).otherwise(F.concat(whole(a / 3_600_000), F.lit(" h")))
    return F.when(ms.isNotNull(), F.concat(sign, text))


def auth_conflicts(results: DataFrame) -> DataFrame:
    """Servers that gave one method different results in two headers or more."""
    out = results.groupBy("path", "authserv", "method").agg(F.countDistinct("result").alias("results"), F.countDistinct("pos").alias("headers"))
    return out.where("results > 1 AND headers > 1").select("path", "authserv", "method", "results")


def planted_results(results: DataFrame, hops_: DataFrame) -> DataFrame:
    """Trust results by a server with a dotted name that no receiving host belongs to, after the last Received."""
    late = results.where(F.col("authserv").contains(".") & (F.col("pos") >= F.col("last_received"))).select("path", "authserv").distinct()
    hosts = hops_.select(F.col("path").alias("_path"), F.lower("by_host").alias("_host")).distinct()
    return late.join(hosts, (late["path"] == hosts["_path"]) & C.aligned(F.col("authserv"), F.col("_host")), "left_anti")


#: Segments of a trust header that are read: it is written by strangers.
SEGMENTS = 64


def segments(value: Column, most: int = SEGMENTS) -> Column:
    """A header split at semicolons outside comments and quotes: a fold over its tokens that knows depth, quotes and escapes."""
    tokens = F.regexp_extract_all(value, F.lit(r'(?s)[^\\"();]+|.'), F.lit(0))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, t: Column) -> Column:
        free = ~s["quoted"]
        cut = free & (t == ";") & (s["depth"] == 0)
        deeper = F.when(free & (t == "("), 1).when(free & (t == ")") & (s["depth"] > 0), -1).otherwise(0)
        new = F.struct(
            F.when(cut, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"), F.when(cut, "").otherwise(F.concat(s["cur"], t)).alias("cur"), (s["depth"] + deeper).alias("depth"),
            F.when(free, t == '"').otherwise(s["escaped"] | (t != '"')).alias("quoted"), (s["quoted"] & ~s["escaped"] & (t == "\\")).alias("escaped"),
        )
        return F.when(F.size(s["out"]) >= most, s).otherwise(new)

    return F.aggregate(tokens, zero, step, lambda s: F.concat(s["out"], F.array(s["cur"])))


def uncommented(value: Column) -> Column:
    """Struct of the text without its comments, and these; comments may hold others and may lack their end."""
    tokens = F.regexp_extract_all(value, F.lit(r"[^()]+|[()]"), F.lit(0))
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit("").alias("text"), none.alias("comments"), F.lit("").alias("cur"), F.lit(0).alias("depth"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t == "(", (t == ")") & (s["depth"] > 0)
        last = closes & (s["depth"] == 1)
        outside = (s["depth"] == 0) & ~opens
        return F.struct(
            F.when(outside, F.concat(s["text"], t)).otherwise(s["text"]).alias("text"), F.when(last, F.concat(s["comments"], F.array(F.trim(s["cur"])))).otherwise(s["comments"]).alias("comments"),
            F.when(opens & (s["depth"] == 0), "").when(last | outside, s["cur"]).otherwise(F.concat(s["cur"], t)).alias("cur"), (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
        )

    left = lambda s: F.when((s["depth"] > 0) & (F.trim(s["cur"]) != ""), F.array(F.trim(s["cur"]))).otherwise(none)
    return F.aggregate(tokens, zero, step, lambda s: F.struct(s["text"].alias("text"), F.concat(s["comments"], left(s)).alias("comments")))


def auth_results(headers: DataFrame) -> DataFrame:
    """``(path, pos, value)`` of trust headers -> a row for each method: server, result, class, comment and properties.

    Understands quoted and escaped text, nested comments, the ``i=`` instance of ARC headers, and
    headers without a server. What is no ``method=result`` is a row without a method; null and empty
    headers give no row.
    """
    pair = r"^([A-Za-z0-9._+-]+)\s*=\s*([A-Za-z0-9._+-]+)\s*(.*)$"
    rows = headers.select("path", "pos", segments(F.coalesce("value", F.lit(""))).alias("parts"))
    instance = F.regexp_extract(F.col("parts")[0], r"(?i)^\s*i\s*=\s*(\d+)\s*$", 1)
    rows = rows.withColumn("instance", instance.try_cast("int")).withColumn("parts", F.when(F.col("instance").isNotNull(), F.slice("parts", 2, SEGMENTS + 1)).otherwise(F.col("parts")))
    rows = rows.withColumn("head", F.split(F.trim(uncommented(F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("")))["text"]), r"\s+"))
    lone = F.col("head")[0].contains("=")
    rows = rows.withColumns({"authserv": F.when(~lone & (F.col("head")[0] != ""), F.lower(F.col("head")[0])), "version": F.when(~lone & F.get("head", F.lit(1)).rlike(r"^\d+$"), F.get("head", F.lit(1)))})
    rows = rows.select("path", "pos", "instance", "authserv", "version", F.posexplode(F.when(lone, F.col("parts")).otherwise(F.slice("parts", 2, SEGMENTS + 1))).alias("nth", "part"))
    rows = rows.withColumn("read", uncommented(F.col("part"))).withColumn("p", F.trim("read.text")).where("p <> ''")
    known = F.col("p").rlike(pair)
    result = F.when(known, F.lower(F.regexp_extract("p", pair, 2))).otherwise(F.col("p"))
    kind = F.when(result.isin("pass", "bestguesspass"), "ok").when(result.isin("fail", "hardfail"), "flag").otherwise("note")
    props = F.regexp_extract_all(F.when(known, F.regexp_extract("p", pair, 3)).otherwise(""), F.lit(r'[A-Za-z0-9._+-]+\s*=\s*(?:"(?:[^"\\]|\\.)*"|[^\s"]+)'), F.lit(0))
    props = F.transform(props, lambda x: F.struct(F.regexp_extract(x, r"^([^=\s]+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"(?s)=\s*(.*)$", 1), r'(?s)^"(.*)"$', "$1").alias("value")))
    return rows.select(
        "path", "pos", "nth", "instance", "authserv", "version", F.when(known, F.lower(F.regexp_extract("p", pair, 1))).otherwise("").alias("method"), result.alias("result"), kind.alias("class"),
        F.array_join("read.comments", " ").alias("comment"), props.alias("props"),
    )


def first_results(headers: DataFrame) -> DataFrame:
    """``(path, spf, dkim, dmarc)``: the first result of each in all trust headers, null without one."""
    joined = headers.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "; ").alias("v"))
    return joined.select("path", *(F.nullif(F.lower(F.regexp_extract("v", rf"(?i)\b{m}\s*=\s*([a-z]+)", 1)), F.lit("")).alias(m) for m in ("spf", "dkim", "dmarc")))
