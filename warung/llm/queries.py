"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm import (decontaminate, embedding_dedup, language_id, line_dedup, merkle, minhash_dedup, mixing, packing, quality_rules, resample,
                        suffix_dedup, url_filters, warc)
from warung.llm.store import ship
from warung.session import scratch_path

WORD_BPE = "word_bpe_49k.json"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and what is left of it."""
    out = line_dedup.dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a fifth of them is held out of training."""
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(docs)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and learned verdict of every document."""
    out = quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    found = warc.read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, rf"^{warc.ID}(-?\d+)$", 1).cast("long")
    response = F.col("record_type") == "response"
    refers = F.when(F.col("record_id").isNotNull(), number(F.col("refers_to")))     # as SQL compares ids
    return found.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.when(response, F.col("payload_sha256")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", refers.alias("refers_to"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    out = suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources, none repeated more than twice."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), max_repeat=2.0)
    return out.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens, each of the corpus mixture."""
    import public_tokenizers
    return packing.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filters.judge(spark, _table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings of equal label."""
    return embedding_dedup.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document, a third of them tampered with."""
    return merkle.manifest(spark, _table(spark, sf_dir, "documents"), received=merkle.tampered_leaf())


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark window."""
    out = decontaminate.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's distribution."""
    out = resample.resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_ALL = [op1_line_dedup, op2_language_id, op3_quality_rules, op4_warc, op5_suffix_dedup, op6_minhash_dedup, op7_mixing, op8_packing, op9_url_filters,
        op10_embedding_dedup, op11_merkle_manifest, op12_decontamination, op13_importance_resampling]


def _with_package(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)
    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _with_package(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from warung.llm import oracle
    return dict(oracle.SQL)
