"""The registered queries of the ten operators, with production parameters on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, edits, itq, lm_score, mixing, ngram_join, quality, rans, secrets, sharding
from furrow.llm.common import scratch_dir, table, written

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document under all others: doc_id, n_words, score (5 places)."""
    return lm_score.score(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 5).alias("score"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def token_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("tokens").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(bpe.encode(docs, decoded="decoded", drop_text=True))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links (other documents linked directly), kept, set_id."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def edit_script(docs: DataFrame) -> DataFrame:
    """Three edits for every document, spread over its text by its id: a word put in, a deletion, a replacement."""

    def at(k: int) -> Column:
        return F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) * k, F.coalesce(F.length("text"), F.lit(0)) + 1)

    script = [F.struct(at(k).alias("start"), (at(k) + cut).alias("stop"), F.lit(new).alias("text")) for k, cut, new in ((7919, 0, "a new word "), (104729, 9, ""), (15485863, 5, "Re-placed"))]
    return docs.withColumn("edits", F.array(*script))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edit_script(): doc_id, n_tokens_before, n_tokens, n_chars_after, n_chars_encoded.

    The trees are kept as a table; the edits meet the table, not the documents.
    """
    trees = written(edits.build(table(spark, sf_dir, "documents").select("doc_id", "text")), "trees", compression="zstd")
    return edits.apply_edits(edit_script(trees), keep=["doc_id"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    rans.write_ids(table(spark, sf_dir, "documents"), out)
    return rans.read_ids(spark, out, with_ids=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the contract has it, and formats: the automaton that explains each span best, in the spans' order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))

    def spell(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in secrets.BASE_KINDS]
    formats = F.array_join(F.transform("secrets", lambda s: s["format"]), ",")
    return found.select("doc_id", *counts, F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("secrets")).alias("spans"), formats.alias("formats"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard: the shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_lm_score, op2_embedding_dedup, op3_quality_rules, op4_bpe, op5_ngram_join, op6_mixing, op7_token_counts, op8_token_files, op9_secrets, op10_sharding]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_score": lm_score.SQL, "op10_sharding": sharding.placement_sql(SHARDS)}
