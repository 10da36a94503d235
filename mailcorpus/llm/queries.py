"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, exact, html, lm, merkle, minhash, mixing, permuterm, pii, sql, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4)


@query
def op10_substring(spark, sf_dir):
    return substring.repeated_passages(_table(spark, sf_dir, "documents"), window=35)


def _held_out(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


@query
def op7_lm(spark, sf_dir):
    return lm.lm_scores(_table(spark, sf_dir, "documents"), _held_out(7, 2))


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _held_out(3, 1))


@query
def op8_chat(spark, sf_dir):
    return chat.chat_digests(chat.with_control_strings(_table(spark, sf_dir, "conversations")))


@query
def op9_html(spark, sf_dir):
    return html.main_text(_table(spark, sf_dir, "pages"))


@query
def op4_ann(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_pii(spark, sf_dir):
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op2_mixing(spark, sf_dir):
    return mixing.mixture(_table(spark, sf_dir, "documents"))


@query
def op11_spelling(spark, sf_dir):
    return permuterm.spelling_variants(_table(spark, sf_dir, "documents"))


@query
def op12_exact(spark, sf_dir):
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


@query
def op13_merkle(spark, sf_dir):
    """Texts of a third of the rows are met in lower case."""
    return merkle.manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0, bytes.lower)
