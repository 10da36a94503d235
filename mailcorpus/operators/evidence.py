"""What the checklist needs of a message, assembled from its rows in several tables.

Every part is a table with a row for each path, made from headers alone: bodies take part in one
join, on the path, and in no aggregation. All groupings and joins of header rows are on the path or
begin with it, so they share its partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X
from mailcorpus.functions import hosts
from mailcorpus.shared import bucketed

from . import checks, headers


def _none() -> Column:
    return F.array().cast("array<string>")


def _named(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("lower") == name).select("path", "pos", "value")


def chain_evidence(table: DataFrame) -> DataFrame:
    """Per path: hops, broken links, clocks that go back, total time, first host and address, public addresses, receivers."""
    h = headers.chain(headers.hops(_named(table, "received")))
    public = F.when(F.col("from_ip").isNotNull() & ~C.is_private_ip(F.col("from_ip")), F.col("idx"))
    return h.groupBy("path").agg(
        F.count("*").alias("hop_count"), F.count_if(F.col("state") == "broken").alias("broken"), F.count_if("travels").alias("backwards"), F.sum("delay_ms").alias("total_ms"),
        F.max("pos").alias("last_received"), F.min_by(F.struct("from_host", "from_ip"), "idx").alias("first_hop"), F.min_by("from_ip", public).alias("origin_ip"),
        F.max_by("from_ip", public).alias("connecting_ip"), F.array_sort(F.collect_set(F.lower("by_host"))).alias("by_hosts"),
    )


def trust_evidence(table: DataFrame, chain: DataFrame) -> DataFrame:
    """Per path with trust headers: ``forgery`` (flags of inserted ones) and ``dmarc_top`` (the newest says dmarc=pass)."""
    rows = headers.auth_results(_named(table, "authentication-results")).withColumn("server", F.regexp_replace(F.coalesce("authserv", F.lit("")), r"^\[|\]$|\.$", ""))
    # One server that wrote two headers or more and disagrees with itself about a method.
    methods = rows.where("server <> ''").groupBy("path", "server", "method").agg(F.min("result").alias("least"), F.max("result").alias("most"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    wrote = methods.groupBy("path", "server").agg(F.bool_or((F.col("method") != "") & (F.col("least") < F.col("most"))).alias("disagrees"), F.min("first").alias("highest"), F.max("last").alias("lowest"))
    servers = wrote.join(chain.select("path", "last_received", "by_hosts"), "path", "left")
    met = F.exists(F.coalesce("by_hosts", _none()), lambda h: C.aligned(F.regexp_replace(h, r"^\[|\]$|\.$", ""), F.col("server")))
    conflict = F.bool_or((F.col("highest") < F.col("lowest")) & F.coalesce("disagrees", F.lit(False)))
    planted = F.bool_or(F.coalesce(F.col("lowest") > F.col("last_received"), F.lit(False)) & F.col("server").contains(".") & ~met)
    forged = servers.groupBy("path").agg(F.array_compact(F.array(F.when(conflict, "auth-results-conflict"), F.when(planted, "auth-results-planted"))).alias("forgery"))
    top = rows.groupBy("path", "pos").agg(F.bool_or((F.col("method") == "dmarc") & (F.col("result") == "pass")).alias("dmarc")).groupBy("path").agg(F.min_by("dmarc", "pos").alias("dmarc_top"))
    return top.join(forged, "path", "left")


def header_evidence(table: DataFrame) -> DataFrame:
    """Per path: singleton headers that occur twice, DKIM signers, and the first value of the headers that threads and origin need."""
    first = lambda name: F.min_by(F.when(F.col("lower") == name, F.col("value")), F.when(F.col("lower") == name, F.col("pos")))
    signed = F.col("lower") == "dkim-signature"
    signer = F.nullif(F.lower(F.regexp_extract("value", r"(?i)(?:^|;)\s*d\s*=\s*([^;\s]+)", 1)), F.lit(""))
    # A row for each name first, so that no list of all headers of a message is made.
    names = table.groupBy("path", "lower").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value"), F.array_sort(F.collect_set(F.when(signed, signer))).alias("signers"))
    return names.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("lower").isin(X.SINGLE_HEADERS) & (F.col("n") > 1), F.col("lower")))).alias("duplicate_names"), F.bool_or(signed).alias("dkim_signed"),
        F.array_sort(F.flatten(F.collect_list("signers"))).alias("dkim_domains"), first("message-id").alias("message_id"), first("in-reply-to").alias("in_reply_to"), first("references").alias("references"),
        F.lower(F.trim(first("x-ms-exchange-organization-authas"))).alias("auth_as"),
    )


def host_evidence(messages: DataFrame) -> DataFrame:
    """Per path: hosts of links with their readable forms, readable form and skeleton of the sender's domain.

    Hosts are decoded once each, in a table of the distinct ones.
    """
    both = F.concat(F.transform(F.coalesce("url_domains", _none()), lambda h: F.struct(h.alias("host"), F.lit(True).alias("link"))), F.array(F.struct(F.lower("from_domain").alias("host"), F.lit(False).alias("link"))))
    pairs = messages.select("path", F.explode(both).alias("h")).select("path", "h.*").where("host <> ''")
    forms = pairs.join(hosts.host_table(pairs, "host"), "host")
    return forms.groupBy("path").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("link"), F.array("host", "readable")))))).alias("link_hosts"),
        F.max(F.when(~F.col("link"), F.col("readable"))).alias("from_readable"), F.max(F.when(~F.col("link"), F.col("skeleton"))).alias("from_skeleton"),
    )


def origin(internal: list[str]) -> Column:
    """unconfigured, external, unverified, internal or claims-internal, of assembled facts.

    A sender of our own domains is internal if the first hop came from a private address or one of
    our hosts, or the newest trust header or Exchange vouches for it.
    """
    if not internal:
        return F.lit("unconfigured")
    ours = lambda h: F.coalesce(C.any_of([C.is_under(F.lower(h), d) for d in internal]), F.lit(False))
    ip = F.col("first_hop.from_ip")
    outside = F.coalesce(ip.isNotNull() & ~C.is_private_ip(ip), F.lit(False)) & ~ours(F.col("first_hop.from_host"))
    vouched = F.coalesce((F.col("auth_as") == "internal") | F.col("dmarc_top"), F.lit(False))
    return F.when(~ours(F.col("from_domain")), "external").when(F.coalesce("hop_count", F.lit(0)) == 0, "unverified").when(~outside | vouched, "internal").otherwise("claims-internal")


def stored(messages: DataFrame, table: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages and header rows, written once in the same buckets of their path.

    On these, ``assemble`` shuffles only hosts of links; neither headers nor bodies move again.
    """
    return bucketed(messages, "messages", "path", buckets), bucketed(table, "headers", "path", buckets)


def assemble(messages: DataFrame, table: DataFrame, internal: list[str] = ()) -> DataFrame:
    """Messages with all that the 20 checks read; ``table(path, pos, name, lower, value)`` has their headers.

    Messages need ``path``, ``from_domain`` and ``url_domains``. A message without headers has none of
    what is read from them: no hops, no signature, no id.
    """
    chain = chain_evidence(table)
    parts = [chain, trust_evidence(table, chain), header_evidence(table), host_evidence(messages)]
    out = reduce(lambda a, b: a.join(b, "path", "left"), parts, messages.drop("message_id", "in_reply_to", "references", "origin_ip", "connecting_ip"))
    counted = {c: F.coalesce(c, F.lit(0)) for c in ("hop_count", "broken", "backwards")}
    listed = {c: F.coalesce(c, _none()) for c in ("forgery", "duplicate_names", "dkim_domains", "link_hosts")}
    return out.withColumns(counted | listed | {"dkim_signed": F.coalesce("dkim_signed", F.lit(False)), "origin": origin(list(internal))})


def metrics(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """The numbers above a checklist: hidden characters and blocks, look-alikes, envelope, attachments, addresses.

    ``facts`` are assembled ones, ``rows`` their checks.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in facts.columns else F.lit("")
    page = C.html_to_text(F.substring(text("html_body"), 1, X.HTML_SCAN_CHARS))
    body = F.substring(F.concat(text("text_body"), page), 1, X.SCAN_CHARS)
    names = F.coalesce("att_names", _none())
    parts = F.array(*(C.hidden_chars(t) for t in (body, text("subject"), text("from_name"), F.array_join("link_hosts", " "), F.array_join(F.slice(names, 1, 50), " "))))
    total = lambda what: F.aggregate("hidden", F.lit(0), lambda s, h: s + h[what])
    one = facts.select("path", parts.alias("hidden"), C.hidden_css_blocks(text("html_body")).alias("css_blocks"), "origin_ip", "connecting_ip", F.size(names).alias("attachments"), F.size(F.filter(F.slice(names, 1, 50), lambda n: F.size(checks.attachment_flags(F.array(n))) > 0)).alias("risky"))
    one = one.select("path", total("zero_width").alias("zero_width"), total("bidi").alias("bidi"), "css_blocks", "origin_ip", "connecting_ip", "attachments", "risky")
    status = lambda check: F.max(F.when(F.col("check") == check, F.col("status")))
    flagged = rows.groupBy("path").agg(
        F.sum(F.when(F.col("check") == "homoglyphs", F.size("flags")).otherwise(0)).alias("lookalike_fields"), F.bool_or(F.array_contains("flags", "confusable-domain")).alias("lookalike_domain"),
        status("return-path").alias("return_path"), status("reply-to").alias("reply_to"),
    )
    return one.join(flagged, "path")
