"""The security checklist: a row per message and check with a status, and the flags they raise.

Each check reads columns of ``message_facts`` and is left out where the table lacks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X


def _list(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


#: First bytes, in hex, of programs, shortcuts and scripts.
PROGRAM = "^(?:4D5A|7F454C46|FEEDFAC[EF]|C[EF]FAEDFE|4C000000011402)"
SCRIPT = "^2321"
SCRIPT_NAMES = "sh|bash|command|py|pl|rb|txt|log|conf|cfg"
REPLY = r"(?i)^\s*(?:(?:re|fw|fwd|aw|wg|sv|vs|vb|antw|tr|rv|enc|res)\s*(?:\[\d+\])?\s*:\s*)+"
IP_LITERAL = r"(?i)^\[?(?:ipv6:)?(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9a-f:]+)\]?$"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
INVISIBLE_LEAST = 3


def attachment_flags(names: Column, heads: Column | None = None) -> Column:
    """Flags of at most 50 attachments by their names and, where given, their first bytes (an array of binary as long)."""

    def of(name: Column, head: Column) -> Column:
        clean = F.regexp_replace(F.lower(name), r"[\s.]+$", "")
        parts = F.split(clean, r"\.")
        ext = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")
        before = F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(-2))).otherwise("")
        hidden = C.hidden_chars(name)
        run = ext.rlike(f"^(?:{X.EXECUTABLE})$")
        other = (F.length(head) >= 8) & ~run & (head.rlike(PROGRAM) | head.rlike(SCRIPT) & ~ext.rlike(f"^(?:{SCRIPT_NAMES})$"))
        return _list(
            F.when(run, "attachment-executable"), F.when(run & before.rlike(f"^(?:{X.DOCUMENT})$"), "attachment-double-ext"), F.when(other, "attachment-disguised"), F.when(ext.rlike(f"^(?:{X.MACRO})$"), "attachment-macro"),
            F.when(ext.rlike(f"^(?:{X.CONTAINER})$"), "attachment-container"), F.when((hidden["zero_width"] + hidden["bidi"] > 0) | name.rlike(r"\s{10,}"), "attachment-filename-spoof"),
        )

    names = F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, 50)
    each = F.transform(names, lambda n: of(n, F.lit(None).cast("string"))) if heads is None else F.zip_with(names, F.transform(F.slice(F.coalesce(heads, F.array().cast("array<binary>")), 1, 50), F.hex), of)
    return F.array_sort(F.array_distinct(F.flatten(each)))


def check_rows(facts: DataFrame, only: set[str] | None = None, trusted: list[str] | None = None, unaccented: bool = False) -> DataFrame:
    """``(path, check, status, flags)``: status ok, note, flag or na.

    ``only`` names the checks that are wanted; others cost nothing. Each measure is a column that
    is evaluated once a message. ``trusted`` domains (against ``from_readable`` and
    ``from_skeleton``, where the table has them) are those that a sender can imitate. With
    ``unaccented``, a Latin body that holds no letter from A to Z counts as one without letters.
    """
    have = set(facts.columns)
    rows: list[Column] = []
    bound: dict[str, Column] = {}

    def once(name: str, value: Column) -> Column:
        bound[f"m_{name}"] = value
        return F.col(f"m_{name}")

    def wanted(name: str, *needs: str) -> bool:
        return (only is None or name in only) and set(needs) <= have

    def add(name: str, status: Column, flags: Column) -> None:
        rows.append(F.struct(F.lit(name).alias("check"), status.alias("status"), flags.alias("flags")))

    def simple(name: str, bad: Column, flag: str, status: str | Column = "flag") -> None:
        bad = once(name.replace("-", "_"), F.coalesce(bad, F.lit(False)))
        add(name, F.when(bad, status).otherwise("ok"), _list(F.when(bad, flag)))

    def text(name: str, most: int | None = None) -> Column:
        value = F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")
        return F.substring(value, 1, most) if most else value

    # Compared by organisation; without a sender or the other domain there is nothing to compare.
    if wanted("reply-to", "reply_domain"):
        simple("reply-to", (F.lower(text("from_domain")) != "") & (text("reply_domain") != "") & ~C.aligned(text("from_domain"), text("reply_domain")), "replyto-mismatch")
    if wanted("return-path", "return_domain"):
        service = once("service", F.coalesce(C.any_of([C.is_under(F.col("return_domain"), d) for d in X.CATEGORIES["Email Service Provider"]]), F.lit(False)))
        simple("return-path", (F.lower(text("from_domain")) != "") & (text("return_domain") != "") & ~C.aligned(text("from_domain"), text("return_domain")), "returnpath-mismatch", F.when(service, "note").otherwise("flag"))
    if wanted("received-chain", "hop_count", "broken", "backwards"):
        hops, broken, back = (once(c, F.coalesce(F.col(c), F.lit(0))) for c in ("hop_count", "broken", "backwards"))
        strong = (hops == 0) | (broken > 0) | (back > 0)
        long = ~strong & (hops >= X.LONG_CHAIN)
        flags = _list(F.when(hops == 0, "no-received"), F.when((hops > 0) & (broken > 0), "received-broken"), F.when((hops > 0) & (back > 0), "received-time-travel"), F.when(long, "received-long-chain"))
        add("received-chain", F.when(strong, "flag").when(long, "note").otherwise("ok"), flags)
    if wanted("message-id", "message_id"):
        host = F.regexp_extract(F.lower(text("message_id")), r"@([^>\s]+)", 1)
        missing = once("no_id", text("message_id") == "")
        other = once("id_other", (host != "") & (text("from_domain") != "") & ~C.aligned(text("from_domain"), host))
        add("message-id", F.when(missing | other, "note").otherwise("ok"), _list(F.when(missing, "messageid-missing"), F.when(~missing & other, "messageid-domain")))
    if wanted("display-name", "from_name", "from_address"):
        shown = F.lower(F.regexp_extract(text("from_name"), ADDRESS, 0))
        simple("display-name", (shown != "") & (shown != F.lower(text("from_address"))), "forged-display-name")
    if wanted("sender-domain", "from_domain"):
        literal = once("literal", text("from_domain").rlike(IP_LITERAL) & text("from_domain").rlike("[.:]"))
        imitates = F.lit(False)
        if trusted and {"from_readable", "from_skeleton"} <= have:
            readable, skeleton = F.lower(text("from_readable")), text("from_skeleton")
            known = C.any_of([C.is_under(readable, d) for d in trusted])
            imitates = once("imitates", ~readable.rlike(r"^[\x00-\x7F]*$") & ~known & C.any_of([C.is_under(skeleton, d) for d in trusted]))
        add("sender-domain", F.when(literal | imitates, "flag").otherwise("ok"), _list(F.when(literal, "sender-ip-literal"), F.when(imitates, "confusable-domain")))
    if wanted("duplicate-headers", "duplicate_names"):
        simple("duplicate-headers", F.size("duplicate_names") > 0, "duplicate-headers")
    if wanted("dkim-alignment", "dkim_domains"):
        # A signature that names no domain is one; only the lack of any is not applicable.
        signed = F.col("dkim_signed") if "dkim_signed" in have else F.size("dkim_domains") > 0
        none = once("unsigned", ~F.coalesce(signed, F.lit(False)))
        other = once("signer", F.coalesce((text("from_domain") != "") & (F.size("dkim_domains") > 0) & ~F.exists("dkim_domains", lambda d: C.aligned(text("from_domain"), d)), F.lit(False)))
        add("dkim-alignment", F.when(none, "na").when(other, "note").otherwise("ok"), _list(F.when(other, "dkim-misaligned")))
    if wanted("header-forgery", "forgery"):
        forged = once("forgery", F.coalesce("forgery", F.array().cast("array<string>")))
        add("header-forgery", F.when(F.size(forged) > 0, "flag").otherwise("ok"), forged)
    if wanted("sender-origin", "origin"):
        origin = once("origin", F.col("origin"))
        add("sender-origin", F.when(origin == "claims-internal", "flag").when(origin == "internal", "ok").when(origin == "unverified", "note").otherwise("na"), _list(F.when(origin == "claims-internal", "claims-internal")))

    parts = {"text_body", "html_body"} <= have
    if parts:
        page = once("page", C.html_to_text(text("html_body", X.HTML_SCAN_CHARS)))
        plain, marked = once("has_text", text("text_body").rlike(r"\S")), once("has_html", text("html_body").rlike(r"\S"))
    attached = once("attached", F.coalesce(F.size("att_names"), F.lit(0)) > 0) if "att_names" in have else F.lit(False)
    if parts and wanted("body-parts"):
        add("body-parts", F.when(plain & marked, "ok").when(plain | marked | attached, "note").otherwise("flag"), _list(F.when(marked & ~plain, "no-text-part"), F.when(plain & ~marked, "no-html-part"), F.when(~plain & ~marked, "empty-body")))
    if parts and wanted("image-only"):
        picture = once("picture", text("html_body", X.HTML_SCAN_CHARS).rlike("(?i)<img\\b"))
        image = once("image", F.exists(F.coalesce(F.col("att_types"), F.array().cast("array<string>")), lambda t: t.rlike("(?i)^image/"))) if "att_types" in have else F.lit(False)
        size = F.length(F.regexp_replace(text("text_body"), r"\s", ""))
        seen = once("text_size", size) + F.length(F.regexp_replace(page, r"\s", ""))
        only_image = (seen < 15) & (picture | image)
        add("image-only", F.when(only_image, "flag").otherwise("ok"), _list(F.when(only_image, "image-only")))
    if parts and wanted("text-html"):
        share = once("share", C.text_overlap(text("text_body"), page))
        add("text-html", F.when(share.isNull(), "na").when(share < 0.25, "flag").when(share < 0.5, "note").otherwise("ok"), _list(F.when(share < 0.5, "text-html-mismatch")))

    whole = text("body", X.SCAN_CHARS) if "body" in have else F.substring(F.concat(text("text_body"), F.lit("\n"), page), 1, X.SCAN_CHARS) if parts else None
    if whole is not None and parts:
        whole = once("whole", whole)
    # Texts in which characters are looked for: body, subject, sender's name and link hosts.
    hosts = F.array_join(F.coalesce("link_hosts", F.array().cast("array<string>")), " ") if "link_hosts" in have else F.lit("")
    fields = {"subject": text("subject"), "name": text("from_name"), "body": whole if whole is not None else F.lit(""), "links": hosts}
    if whole is not None and wanted("hidden-content"):
        # Running text holds strays; a name or host with any hidden character is no accident.
        found = once("hidden", F.struct(*(C.hidden_chars(x).alias(n) for n, x in fields.items())))
        css = once("css", C.hidden_css_blocks(text("html_body", X.HTML_SCAN_CHARS)) > 0) if parts else F.lit(False)
        count = lambda n: found[n]["zero_width"] + found[n]["bidi"]
        over = sum(found[n]["override"] for n in fields) > 0
        unseen = (count("name") + count("links") > 0) | (count("body") + count("subject") >= INVISIBLE_LEAST)
        add("hidden-content", F.when(over | unseen, "flag").when(css, "note").otherwise("ok"), _list(F.when(over, "bidi-override"), F.when(unseen, "invisible-chars"), F.when(css, "hidden-css-text")))
    if wanted("threading", "subject"):
        threaded = once("threaded", (text("in_reply_to") != "") | (text("references") != ""))
        reply = once("reply", text("subject").rlike(REPLY))
        add("threading", F.when(threaded, "note").when(reply, "flag").otherwise("ok"), _list(F.when(reply & ~threaded, "fake-reply"), F.when(threaded, "threaded")))
    if wanted("homoglyphs", "subject"):
        flags = once("homoglyphs", _list(*(F.when(C.mixed_script_words(x) > 0, f"homoglyph-{n}") for n, x in fields.items())))
        add("homoglyphs", F.when(F.size(flags) > 0, "flag").otherwise("ok"), flags)
    if wanted("attachment-risk", "att_names"):
        flags = once("att_flags", attachment_flags(F.col("att_names"), F.col("att_heads") if "att_heads" in have else None))
        weak = F.size(F.array_except(flags, F.array(F.lit("attachment-macro"), F.lit("attachment-container")))) == 0
        add("attachment-risk", F.when(~attached, "na").when(F.size(flags) == 0, "ok").when(weak, "note").otherwise("flag"), flags)
    if whole is not None and "subject" in have and any(map(wanted, ("subject-script", "body-script", "script-mismatch"))):
        nothing = F.array().cast("array<string>")
        two = {"subject-script": F.col("s_subject"), "body-script": F.col("s_body")}
        for name in filter(wanted, two):
            s = two[name]
            add(name, F.when(F.size(s) == 0, "na").when((F.size(s) == 1) & (s[0] == "latin"), "ok").otherwise("note"), nothing)
        if wanted("script-mismatch"):
            a, b = two.values()
            both = (F.size(a) > 0) & (F.size(b) > 0)
            apart = F.coalesce(both & (F.get(a, F.lit(0)) != F.get(b, F.lit(0))), F.lit(False))
            add("script-mismatch", F.when(~both, "na").when(apart, "note").otherwise("ok"), _list(F.when(apart, "script-mismatch")))
        body = C.script_profile(whole)
        if unaccented:
            read = ("body",) if "body" in have else ("text_body", "m_page")
            none = ~C.any_of([F.col(c).rlike("[A-Za-z]") for c in read])
            body = F.when(F.coalesce(none, F.lit(True)) & (body == F.array(F.lit("latin"))), nothing).otherwise(body)
        bound |= {"s_subject": C.script_profile(text("subject")), "s_body": body}
    # The page's text and what is scanned of the body first: several measures read them.
    early = {n: bound.pop(n) for n in ("m_page", "m_whole") if n in bound}
    for n, v in early.items():
        facts = facts.withColumn(n, v)
    once_ = facts.select("path", *early, *(v.alias(n) for n, v in bound.items()))
    if not rows:
        return facts.select("path", F.lit("").alias("check"), F.lit("").alias("status"), F.array().cast("array<string>").alias("flags")).where("false")
    return once_.select("path", F.explode(F.array(*rows)).alias("r")).select("path", "r.*")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count_if(F.col("status") == "flag").alias("n_flag"), F.count_if(F.col("status") == "note").alias("n_note"))


def flags(rows: DataFrame) -> DataFrame:
    """``(path, flags)`` of every message, sorted."""
    return rows.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))


def origin_class(messages: DataFrame, internal: list[str]) -> DataFrame:
    """``(path, origin)``: unconfigured, external, internal, unverified or claims-internal.

    Needs from_domain, internal_only and by_hosts (an array of receiving hosts).
    """
    if not internal:
        return messages.select("path", F.lit("unconfigured").alias("origin"))
    own = C.any_of([C.is_under(F.col("from_domain"), d) for d in internal])
    seen = F.exists("by_hosts", lambda h: C.any_of([C.is_under(F.lower(h), d) for d in internal]))
    return messages.select("path", F.when(~own, "external").when(F.col("internal_only") & seen, "internal").when(seen, "claims-internal").otherwise("unverified").alias("origin"))


def metrics(messages: DataFrame) -> DataFrame:
    """A row of numbers for each message: hidden characters, mixed-script fields, attachments and risky ones."""
    hidden = C.hidden_chars(F.coalesce("body", F.lit("")))
    mixed = sum((F.when(C.mixed_script_words(F.coalesce(F.col(c), F.lit(""))) > 0, 1).otherwise(0) for c in ("subject", "from_name", "body")), F.lit(0))
    names = F.coalesce("att_names", F.array().cast("array<string>"))
    risky = F.filter(names, lambda n: F.size(attachment_flags(F.array(n))) > 0)
    return messages.select("path", (hidden["zero_width"] + hidden["bidi"]).alias("hidden"), mixed.alias("mixed_fields"), F.size(names).alias("attachments"), F.size(risky).alias("risky"))
