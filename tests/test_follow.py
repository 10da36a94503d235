"""Rules over a stream: batches, restarts, replays and changed rules give the tags of one full run."""

import pytest

from mailcorpus import shared
from mailcorpus.operators import search, tags
from mailcorpus.streaming import follow

RULES = [("big", "n > 20"), ("even", "n % 2 = 0"), ("bad", "nosuch > 1")]


def _put(spark, folder, numbers):
    rows = [(f"p{n}", f"e{n // 2}", n) for n in numbers]
    spark.createDataFrame(rows, "path string, email_id string, n int").coalesce(1).write.mode("append").parquet(folder)


def _run(spark, folder, store, progress, rules):
    stream = spark.readStream.schema("path string, email_id string, n int").option("maxFilesPerTrigger", 1).parquet(folder)
    follow.follow(stream, lambda batch: batch.where("n IS NOT NULL"), rules, store, progress).awaitTermination(120)


def _matches(spark, store, rules):
    return sorted(tuple(r) for r in follow.rule_matches(spark, store, rules).collect())


def _whole(spark, folder, rules):
    runs = tags.run_rules(spark.read.parquet(folder), rules).where("matched").select("rule_id", "email_id").distinct()
    return sorted(tuple(r) for r in runs.collect())


def test_batches_restart_and_changed_rules(spark, tmp_path):
    folder, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    for part in (range(0, 15), range(15, 30)):
        _put(spark, folder, part)
    _run(spark, folder, store, progress, RULES)
    assert _matches(spark, store, RULES) == _whole(spark, folder, RULES)
    _put(spark, folder, range(30, 40))
    changed = [("big", "n > 5"), ("new", "n < 3"), ("even", "n % 2 = 0")]
    _run(spark, folder, store, progress, changed)
    assert _matches(spark, store, changed) == _whole(spark, folder, changed)
    # A rule that is gone leaves no match behind.
    assert {r for r, _ in _matches(spark, store, [("new", "n < 3")])} == {"new"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, store = (str(tmp_path / n) for n in ("in", "store"))
    for part in (range(0, 10), range(10, 25)):
        _put(spark, folder, part)
    for progress in ("one", "two"):  # without its progress the job does all batches again, under the same numbers
        _run(spark, folder, store, str(tmp_path / progress), RULES)
        assert _matches(spark, store, RULES) == _whole(spark, folder, RULES)
    parts = spark.read.parquet(f"{store}/rule_matches")
    assert parts.count() == tags.run_rules(spark.read.parquet(folder), RULES).where("matched").count()


def test_ranking_counts_in_its_own_scan(spark):
    facts = spark.createDataFrame([(f"p{k:02}", f"word {k}", k) for k in range(30)], "path string, subject string, date_ms long")
    s = search.Search(facts)
    rows = s.ranked(s.term("word"), limit=7).collect()
    assert [r.path for r in rows] == [f"p{k}" for k in range(29, 22, -1)] and {(r.total, r.truncated) for r in rows} == {(30, True)}
    assert {(r.total, r.truncated) for r in s.ranked(s.term("word 1"), limit=11).collect()} == {(11, False)}
    assert s.ranked(s.term("nothing")).count() == 0


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = spark.conf

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
