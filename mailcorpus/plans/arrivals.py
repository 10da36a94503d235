"""Rules over messages that arrive in batches, against one run over all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailcorpus.shared import new_folder
from mailcorpus.streaming import follow

from . import fixtures as V
from .registry import query

_RULES = [("r1", "toxic", "dmarc <=> 'fail'", True), ("r2", "urgent", "h_includes_any(subject, array('urgent'))", True), ("r3", "never", "true", False)]


@query("""SELECT DISTINCT email_id, tag, source, rule_id FROM tagged WHERE source = 'manual' UNION SELECT email_id, 'toxic', 'rule', 'r1' FROM m WHERE dmarc = 'fail'
UNION SELECT email_id, 'urgent', 'rule', 'r2' FROM m WHERE subject LIKE '%Urgent%'""", "m", "tagged")
def incremental_tags(spark, d):
    """Messages judged in two micro-batches or more, a restart, and a rule whose condition has changed meanwhile."""
    folder, store, progress = (new_folder(spark, n) for n in ("arrivals", "store", "progress"))
    V.messages(spark, d).select("path", "email_id", "subject", "dmarc").write.parquet(folder)
    arrived = spark.read.parquet(folder)
    half = max(1, len(arrived.inputFiles()) // 2)
    stream = lambda: spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", half).parquet(folder)
    now = [(r, e) for r, _, e, on in _RULES if on]
    before = [("r1", now[0][1]), ("r2", "contains(lower(subject), 'lunch')")]
    for rules in (before, now):
        follow.follow(stream(), lambda batch: batch, rules, store, progress).awaitTermination()
    tags = V.tags(spark, d)
    old = tags.where(F.col("source") == "rule").select("rule_id", "email_id")
    return follow.tags(spark, store, tags, old, spark.createDataFrame(_RULES, "rule_id string, tag string, expression string, enabled boolean"))
