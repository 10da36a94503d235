"""Rules over messages as they arrive: each batch is judged once, whatever is repeated or restarted.

A store is a folder of two tables, ``facts`` and ``rule_matches``, in parts named by what made them:
``part=batch-7`` holds what micro-batch 7 gave. A batch that is replayed after a failure writes its
part anew, so it changes nothing. Rules run over the new rows of a batch alone. A rule that is new,
or whose condition was changed, runs over the stored facts once, into the part ``part=rule-<key>``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailcorpus.operators import tags as T

_MATCHES = "rule_id string, rule_key string, email_id string, path string, part string"


def rule_key(expression: str) -> str:
    """What a match was made with: a changed condition has another key."""
    return hashlib.sha256(expression.encode()).hexdigest()[:16]


def _store(df: DataFrame, store: str, table: str, part: str) -> None:
    df.write.mode("overwrite").parquet(f"{store}/{table}/part={part}")


def matched(facts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule_id, rule_key, email_id, path)`` of the rules ``(rule_id, expression)`` that hold."""
    keys = F.create_map(*(F.lit(x) for r, e in rules for x in (r, rule_key(e))))
    return T.run_rules(facts, rules).where("matched").select("rule_id", keys[F.col("rule_id")].alias("rule_key"), "email_id", "path")


def follow(messages: DataFrame, facts_of: Callable[[DataFrame], DataFrame], rules: list[tuple[str, str]], store: str, checkpoint: str) -> StreamingQuery:
    """Judge a stream of messages until all that is there has been read.

    ``facts_of`` makes the facts of a batch (``path``, ``email_id`` and what rules name). The
    checkpoint is the progress: a restart goes on after the last complete batch and repeats one that
    was not completed. Rules that stored facts have not met run over these first.
    """

    if _exists(messages.sparkSession, f"{store}/facts"):
        backfill(messages.sparkSession, store, rules)
    else:
        for rule, expression in rules:
            _mark(messages.sparkSession, store, rule, expression)

    def judge(batch: DataFrame, number: int) -> None:
        # Written first and read again, so that facts are made once.
        _store(facts_of(batch), store, "facts", f"batch-{number}")
        facts = batch.sparkSession.read.parquet(f"{store}/facts/part=batch-{number}")
        _store(matched(facts, rules), store, "rule_matches", f"batch-{number}")

    return messages.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mark(spark: SparkSession, store: str, rule: str, expression: str) -> None:
    """Note that all stored facts have met this condition."""
    key = rule_key(f"{rule}\n{expression}")
    spark.createDataFrame([(key,)], "key string").write.mode("overwrite").json(f"{store}/rules/rule={key}")


def backfill(spark: SparkSession, store: str, rules: list[tuple[str, str]]) -> None:
    """Run the rules that stored facts have not met over all of them."""
    done = {r.key for r in spark.read.schema("key string").json(f"{store}/rules").collect()} if _exists(spark, f"{store}/rules") else set()  # one row for each condition
    for rule, expression in rules:
        key = rule_key(f"{rule}\n{expression}")
        if key not in done:
            _store(matched(spark.read.parquet(f"{store}/facts"), [(rule, expression)]), store, "rule_matches", f"rule-{key}")
            _mark(spark, store, rule, expression)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def rule_matches(spark: SparkSession, store: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule_id, email_id)``: matches of the rules as they are now; those of deleted rules or earlier conditions are left out."""
    live = spark.createDataFrame([(r, rule_key(e)) for r, e in rules], "rule_id string, rule_key string")
    return spark.read.schema(_MATCHES).parquet(f"{store}/rule_matches").join(live, ["rule_id", "rule_key"], "left_semi").select("rule_id", "email_id").distinct()


def tags(spark: SparkSession, store: str, manual: DataFrame, old: DataFrame, rules: DataFrame) -> DataFrame:
    """Tag assertions after the stored batches: ``converge`` from the ``old`` matches to the stored ones.

    ``rules(rule_id, tag, expression, enabled)``; a disabled rule neither adds nor removes.
    """
    now = [(r.rule_id, r.expression) for r in rules.where("enabled").select("rule_id", "expression").collect()]  # one row for each rule
    return T.converge(manual, old, rule_matches(spark, store, now), rules)
