"""Counts by value over messages: indicators, flags, facets, tags and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C

from . import domains

#: What an indicator counts: its column, whether that is a list, in the order of the export.
INDICATORS = {"from_domain": False, "origin_ip": False, "connecting_ip": False, "url_domains": True, "att_exts": True, "financial": True, "categories": True}
FLAG_GROUPS = {
    "header": ["replyto-mismatch", "returnpath-mismatch", "no-received", "received-broken", "received-time-travel", "received-long-chain", "messageid-missing", "messageid-domain", "forged-display-name", "duplicate-headers", "dkim-misaligned", "auth-results-conflict", "auth-results-planted", "claims-internal"],
    "sender": ["confusable-domain", "sender-ip-literal", "name-mismatch", "lookalike", "punycode"],
    "body": ["no-text-part", "no-html-part", "empty-body", "image-only", "text-html-mismatch", "bidi-override", "invisible-chars", "hidden-css-text", "fake-reply", "threaded", "homoglyph-subject", "homoglyph-name", "homoglyph-body", "homoglyph-links"],
    "attachments": ["attachment-executable", "attachment-double-ext", "attachment-disguised", "attachment-macro", "attachment-container", "attachment-filename-spoof"],
    "language": ["script-mismatch"],
}
#: Flags that many legitimate messages raise.
NOTES = ["no-html-part", "no-text-part", "threaded", "messageid-missing", "messageid-domain", "dkim-misaligned", "received-long-chain", "script-mismatch", "hidden-css-text", "attachment-macro", "attachment-container", "empty-body"]


def count_by(messages: DataFrame, column: str, listed: bool = False) -> DataFrame:
    """``(value, email_count)``: a list counts each of its elements."""
    value = F.explode(column) if listed else F.col(column)
    return messages.select(value.alias("value")).where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("email_count"))


def indicators(messages: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``(type, value, email_count)`` of every indicator that the table has, over all rows or those of ``scope(path)``."""
    if scope is not None:
        messages = messages.join(scope.select("path"), "path", "left_semi")
    have = [c for c in INDICATORS if c in messages.columns]
    entry = F.explode(F.flatten(F.array(*(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")) if INDICATORS[c] else F.array(F.col(c)), _typed(c)) for c in have)))).alias("e")
    return messages.select(entry).select("e.type", "e.value").where("value IS NOT NULL AND value <> ''").groupBy("type", "value").agg(F.count("*").alias("email_count"))


def _typed(name: str):
    return lambda v: F.struct(F.lit(name).alias("type"), v.alias("value"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode(F.array_distinct("flags")).alias("flag")).groupBy("flag").agg(F.count("*").alias("email_count"))


def flag_group_counts(flagged: DataFrame) -> DataFrame:
    """A message counts once in each group of which it has a flag."""
    groups = F.array_compact(F.array(*(F.when(F.arrays_overlap("flags", F.array(*map(F.lit, ids))), F.lit(g)) for g, ids in FLAG_GROUPS.items())))
    return flagged.select(F.explode(groups).alias("flag_group")).groupBy("flag_group").agg(F.count("*").alias("email_count"))


def flag_overview(flagged: DataFrame) -> DataFrame:
    """Flags with their group and strength, their counts: strong ones before notes, most frequent first."""
    rows = [(f, g, "note" if f in NOTES else "flag") for g, ids in FLAG_GROUPS.items() for f in ids]
    names = F.broadcast(flagged.sparkSession.createDataFrame(rows, "flag string, flag_group string, strength string"))
    return flag_counts(flagged).join(names, "flag").orderBy("flag_group", "strength", F.desc("email_count"), "flag")


def facets(messages: DataFrame, column: str) -> DataFrame:
    """Messages with each distinct element of a list."""
    return count_by(messages.select(F.array_distinct(column).alias(column)), column, True)


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.countDistinct("email_id").alias("email_count"))


def rule_statistics(runs: DataFrame) -> DataFrame:
    """``runs(rule_id, path, matched, error)`` -> matched, total, errors and the first error of each rule."""
    return runs.groupBy("rule_id").agg(F.count_if("matched").alias("matched"), F.count("*").alias("total"), F.count("error").alias("errors"), F.min("error").alias("first_error"))


def corpus_statistics(messages: DataFrame, skipped) -> DataFrame:
    return messages.agg(F.count("*").alias("total"), F.count_if(~skipped).alias("indexed"), F.count_if(skipped).alias("skipped"))


def case_report(messages: DataFrame, tags: DataFrame) -> DataFrame:
    """A row for each tag and message, with the number of messages of the tag; largest tags first."""
    one = tags.select("email_id", "tag").distinct()
    sizes = one.groupBy("tag").agg(F.count("*").alias("tag_size"))
    return messages.join(one, "email_id").join(sizes, "tag").select("tag", "tag_size", "subject", "from_domain", "date_ms", "path").orderBy(F.desc("tag_size"), "tag", "path")


#: Flags of the sender that no check raises.
SENDER_FLAGS = ["name-mismatch", "lookalike", "punycode"]


def with_sender_flags(messages: DataFrame, flagged: DataFrame) -> DataFrame:
    """``(path, flags)`` of all messages: those of their checks and, of the sender's name and domain, those of SENDER_FLAGS.

    Needs ``from_name`` and ``from_domain``; ``lookalike_domain`` where the table has it, else common brands decide.
    """
    sender = F.lower("from_domain")
    if "lookalike_domain" not in messages.columns:
        messages = domains.with_lookalike_flag(messages.select("path", "from_name", "from_domain"), [])
    own = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in zip(SENDER_FLAGS, (C.brand_mismatch(F.col("from_name"), sender), F.col("lookalike_domain"), C.is_punycode(sender)), strict=True))))
    none = F.array().cast("array<string>")
    return messages.select("path", own.alias("own")).join(flagged, "path", "left").select("path", F.array_sort(F.array_union(F.coalesce("flags", none), "own")).alias("flags"))


def flag_summary(flagged: DataFrame) -> DataFrame:
    """``(level, value, email_count)``: messages by ``flag``, by ``group`` of flags, with ``any`` flag, and with a ``sender-anomaly``.

    One expansion to (path, group, flag) and GROUPING SETS: partial counts are made before anything
    is shuffled. A message that has two flags of a group counts once in it, because only the first
    row of a path within a group, and within all, carries its mark.
    """
    rows = [F.struct(F.lit(g).alias("grp"), F.lit(f).alias("flag")) for g, ids in FLAG_GROUPS.items() for f in ids]
    mine = F.filter(F.array(*rows), lambda r: F.array_contains("flags", r["flag"]))
    sender = F.arrays_overlap("flags", F.array(*map(F.lit, SENDER_FLAGS)))
    each = flagged.where(F.size("flags") > 0).select(F.posexplode(mine).alias("k", "r"), mine.alias("all"), sender.alias("sender"))
    opens = F.coalesce(F.get("all", F.col("k") - 1)["grp"] != F.col("r.grp"), F.lit(True))
    each = each.select("r.grp", "r.flag", opens.cast("long").alias("opens"), (F.col("k") == 0).cast("long").alias("first"), ((F.col("k") == 0) & F.col("sender")).cast("long").alias("sender"))
    sets = each.groupingSets([["flag"], ["grp"], []], "flag", "grp").agg(F.count("*").alias("rows"), F.sum("opens").alias("opens"), F.sum("first").alias("first"), F.sum("sender").alias("sender"))
    line = lambda level, value, n: F.struct(F.lit(level).alias("level"), value.alias("value"), n.alias("email_count"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    total = F.array(line("any", none, F.coalesce("first", zero)), line("sender-anomaly", none, F.coalesce("sender", zero)))
    return sets.select(F.explode(F.when(F.col("flag").isNotNull(), F.array(line("flag", F.col("flag"), F.col("rows")))).when(F.col("grp").isNotNull(), F.array(line("group", F.col("grp"), F.col("opens")))).otherwise(total)).alias("x")).select("x.*")


def coverage(messages: DataFrame, images: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: messages in all, read and skipped, those with images, and those of whose images a text is known.

    ``messages(path, skipped)``, ``images(path, sha256)``, ``texts(sha256, ocr_text)``. Images are
    looked up by content, so one text serves all copies; each message is counted once.
    """
    known = texts.where("ocr_text <> ''").select("sha256").distinct().withColumn("known", F.lit(True))
    seen = images.join(known, "sha256", "left").groupBy("path").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("with_text"))
    return messages.join(seen, "path", "left").agg(
        F.count("*").alias("total"), F.count_if(~F.col("skipped")).alias("indexed"), F.count_if("skipped").alias("skipped"), F.count("with_text").alias("with_images"), F.count_if(F.coalesce("with_text", F.lit(False))).alias("with_text"),
    )
