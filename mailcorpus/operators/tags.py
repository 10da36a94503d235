"""Tags and rules as tables that are replaced as a whole: no merge is needed.

``tag_assertions(email_id, tag, source, rule_id)``, ``rule_matches(rule_id, email_id)``,
``rules(rule_id, tag, expression, enabled)``, ``notes(email_id, note)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailcorpus.functions import helpers


def effective(tags: DataFrame) -> DataFrame:
    return tags.select("email_id", "tag").distinct()


def normalised(name: Column) -> Column:
    """Lower case, runs of other characters to one dash, none at the ends, at most 40."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.substring(clean, 1, 40)


def normalise_all(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags under their normal names, merged; and manual ones whose name leaves nothing."""
    named = tags.withColumn("tag", normalised(F.col("tag")))
    return named.where("tag <> ''").distinct(), tags.where((normalised(F.col("tag")) == "") & (F.col("source") == "manual"))


def run_rules(facts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule_id, path, email_id, matched, error)`` in one pass; a rule that cannot be read is an error, not a failure."""
    helpers.register(facts.sparkSession)
    holds, rows = [], []
    for k, (rule, expression) in enumerate(rules):
        try:
            facts.select(F.expr(expression).cast("boolean")).schema
        except Exception as why:  # the rule is user text
            rows.append(F.struct(F.lit(rule).alias("rule_id"), F.lit(False).alias("matched"), F.lit(str(why).split("\n")[0][:80]).alias("error")))
        else:
            # Conditions are columns of their own, as SQL functions may not stand in a generator.
            holds.append(F.coalesce(F.expr(expression).cast("boolean"), F.lit(False)).alias(f"_holds_{k}"))
            rows.append(F.struct(F.lit(rule).alias("rule_id"), F.col(f"_holds_{k}").alias("matched"), F.lit(None).cast("string").alias("error")))
    return facts.select("path", "email_id", *holds).select("path", "email_id", F.explode(F.array(*rows)).alias("r")).select("r.rule_id", "path", "email_id", "r.matched", "r.error")


def match_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(rule_id, email_id, change)``: add or remove."""
    keys = ["rule_id", "email_id"]
    one, two = old.select(*keys).distinct(), new.select(*keys).distinct()
    return two.join(one, keys, "left_anti").withColumn("change", F.lit("add")).union(one.join(two, keys, "left_anti").withColumn("change", F.lit("remove")))


def converge(tags: DataFrame, old: DataFrame, new: DataFrame, rules: DataFrame) -> DataFrame:
    """Tag assertions after a complete run: those of live rules follow the new matches, all others stay."""
    live = rules.where("enabled").select("rule_id", F.col("tag").alias("rule_tag"))
    change = match_diff(old, new).join(live, "rule_id")
    gone = change.where("change = 'remove'").select("email_id", "rule_id")
    kept = tags.join(gone, ["email_id", "rule_id"], "left_anti")
    more = change.where("change = 'add'").select("email_id", F.col("rule_tag").alias("tag"), F.lit("rule").alias("source"), "rule_id")
    return kept.select("email_id", "tag", "source", "rule_id").union(more).distinct()


def retract(tags: DataFrame, rule_id: str) -> DataFrame:
    return tags.where(~F.coalesce(F.col("rule_id") == rule_id, F.lit(False)))


def rename_rule_tag(tags: DataFrame, rule_id: str, name: str) -> DataFrame:
    return tags.withColumn("tag", F.when(F.col("rule_id") == rule_id, F.lit(name)).otherwise(F.col("tag"))).distinct()


def add_tag(tags: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return tags.union(ids.select("email_id", F.lit(name), F.lit("manual"), F.lit(None).cast("string"))).distinct()


def remove_tag(tags: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Only what was asserted by hand goes."""
    gone = ids.select("email_id").distinct().withColumn("_gone", F.lit(True))
    return tags.join(gone, "email_id", "left").where(~((F.col("source") == "manual") & (F.col("tag") == name) & F.coalesce("_gone", F.lit(False)))).drop("_gone").select(*tags.columns)


def delete_tag(tags: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rest, and the deleted rows to undo it with."""
    return tags.where(F.col("tag") != name), tags.where(F.col("tag") == name)


def switched_off(rules: DataFrame, name: str) -> DataFrame:
    """Rules, with those that assert a deleted tag disabled."""
    return rules.withColumn("enabled", F.col("enabled") & (F.col("tag") != name))


def untag_counts(tags: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Of the selected messages: how many lose the tag, have it from a rule, do not have it."""
    state = tags.where(F.col("tag") == name).groupBy("email_id").agg(F.bool_or(F.col("source") == "manual").alias("manual"), F.bool_or(F.col("source") == "rule").alias("rule"))
    return ids.select("email_id").distinct().join(state, "email_id", "left").agg(
        F.count_if(F.coalesce("manual", F.lit(False))).alias("removed"), F.count_if(F.coalesce(F.col("rule") & ~F.col("manual"), F.lit(False))).alias("rule_owned"), F.count_if(F.col("manual").isNull()).alias("absent")
    )


def prune(records: DataFrame, tags: DataFrame, notes: DataFrame) -> DataFrame:
    """Records with a tag or a note."""
    return records.join(tags.select("email_id").union(notes.where("note <> ''").select("email_id")).distinct(), "email_id", "left_semi")


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select("email_id", F.col("note").alias("_new"))
    return notes.join(new, "email_id", "full_outer").select("email_id", F.coalesce("_new", "note").alias("note"))


def import_merge(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(email_id, tags, note)``: union of tags, the existing note first."""
    other = theirs.select("email_id", F.col("tags").alias("_tags"), F.col("note").alias("_note"))
    none = F.array().cast("array<string>")
    out = mine.join(other, "email_id", "full_outer")
    return out.select("email_id", F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("_tags", none))).alias("tags"), F.coalesce(F.nullif("note", F.lit("")), "_note").alias("note"))


def write_tags(tags: DataFrame, path: str) -> None:
    tags.write.mode("errorifexists").json(path)


def read_tags(spark, path: str) -> DataFrame:
    return spark.read.schema("email_id string, tag string, source string, rule_id string").json(path)
