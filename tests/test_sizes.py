"""Steps that must stay small or spread out whatever the size of the tables."""

from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.operators import domains
from mailcorpus.plans import decoding


def test_long_lists_are_not_broadcast(spark):
    """Some 150 rows for each entry: too many for the driver, though the list itself is small."""
    hosts = spark.createDataFrame([("paypa1.com",)], "host string")
    near = domains.near_hosts(hosts, spark.range(1000).select(F.format_string("host%d.example", "id").alias("listed")))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_digests_are_no_wallets(spark):
    """A token of 40 hex digits may begin with bc1."""
    texts = ['token = "bc1' + "9f" * 18 + '0"', "send to bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1" + "q" * 59, "bc1" + "q" * 39 + "0", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r.k: r.f for r in df.select("k", C.financial_indicators(F.col("t")).alias("f")).collect()}
    wallet = ["crypto_wallet_btc"]
    assert found == {0: [], 1: wallet, 2: wallet, 3: [], 4: wallet}


def test_messages_are_made_by_many_tasks(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert decoding._files(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
