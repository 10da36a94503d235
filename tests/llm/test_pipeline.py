"""The stages on the smallest tables, each against its operator's own rule."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from mailcorpus.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
from .test_operators import brute_components  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    clean = P.toxic(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() > 0.85 * docs.count()
    single = P.near_dedup(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert {r.doc_id for r in P.decontamination(spark, docs, SF).collect()} == {i for i, _ in rows} - leaks and leaks
    private = P.personal_data(spark, docs, SF)
    assert private.count() == docs.count() and private.columns == docs.columns and not any(re.search(r"@mail\d", r.text) for r in private.collect())
    assert all(r.n_chars == len(r.text) for r in private.collect())
    mixed = P.target_mix(spark, docs, SF)
    assert 0 < mixed.count() < docs.count() and {"weight", "probability"} <= set(mixed.columns)


def test_rows_without_id(spark):
    """They go and stay by their own text; of a repeated id only the chosen text is mixed in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = decontaminate.contaminated(docs, benchmark).select("doc_id").distinct()
    assert P.decontamination(spark, nameless, SF).count() == docs.join(leaks, "doc_id", "left_anti").count() < docs.count()
    single = P.near_dedup(spark, docs.union(nameless), SF)
    assert single.where("doc_id IS NULL").count() == 0 and P.near_dedup(spark, nameless, SF).count() == single.count()
    clean = {r.text for r in P.toxic(spark, docs, SF).collect()}
    assert {r.text for r in P.toxic(spark, docs.union(nameless), SF).where("doc_id IS NULL").collect()} == clean
    assert P.target_mix(spark, nameless, SF).count() > 0
    texts = spark.createDataFrame([(7, f"{'word ' * 200}{k}", "en", f"src{k % 2}", 1) for k in range(200)], docs.schema)
    assert 0 < P.target_mix(spark, texts, SF).select("text").distinct().count() < 200


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in P.STAGES:
        assert step(spark, docs, SF).count() == 0


def test_queries_are_one_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
