"""Corpus pipeline: quality rules, near duplicates, secrets, source mix, token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns
rows with the columns that it was given, extra ones included; the last returns token digests.  The runner writes
each stage as Parquet and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm import bpe, mixing, ngram_join, quality, secrets
from furrow.llm.common import scratch_dir, spare_name, table
from furrow.llm.queries import token_digests

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, judged one by one: a null text goes, a null or repeated doc_id does not matter."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 0.8): that with the smallest doc_id.

    Rows that share a doc_id are texts of one document and stay together, but of rows that share doc_id
    and text only the first by their other columns stays.  A row without doc_id goes by its text, after
    all that have one, and keeps its null.
    """
    key, nth = spare_name(docs, "key"), spare_name(docs, "nth")
    late = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), late))
    kept = ngram_join.join(named, doc_id=key).where("kept").select(F.col("doc_id").alias(key)).distinct()
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    first = F.row_number().over(Window.partitionBy(key, "text").orderBy(*others, "doc_id"))
    return named.join(kept, key, "left_semi").withColumn(nth, first).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret in their text replaced by [SECRET]; n_chars follows the text, a null text stays null."""
    clean = secrets.scan(docs, redact_with="[SECRET]")
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (null and wordless texts: never); null doc_ids and sources count as any other."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix; a null text is the empty text."""
    return token_digests(bpe.encode(docs.select("doc_id", "text"), decoded="decoded", drop_text=True))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("redact_secrets", redact_secrets), ("mix_sources", mix_sources), ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
