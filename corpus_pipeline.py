"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``; ``n_chars`` follows the text.

Nulls, empty texts, repeated rows and further columns are dealt with as the
operators' docstrings say; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from warung.llm.queries import WORD_BPE
from warung.llm.store import saved, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least_score: float = 0.3) -> DataFrame:
    """Documents whose language the network can tell; ``und`` and pooled
    probabilities below ``least_score`` go.  A missing ``lang`` is filled in."""
    ship(spark)
    net = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    told = language_id.predict(docs.select(COLUMNS), net, keep_text=True)
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least_score))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood earlier in the corpus; one that has
    no word left goes."""
    ship(spark)
    out = line_dedup.dedup_lines(spark, docs.select(COLUMNS))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles,
    similarity 0.8): the one of the smallest id, a null one first."""
    ship(spark)
    # an id of each row's own, ordered by doc_id: a kept doc_id keeps no other text
    row = F.struct("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_hash"))
    docs = docs.select(*COLUMNS, row.alias("_row"))
    found = minhash_dedup.near_duplicates(spark, docs, k=5, similarity=0.8, id_col="_row")
    kept = found.where("kept").select(F.col("_row").alias("_kept")).distinct()
    # of rows with one id and one text a single row stays
    alike = [F.col(f"_row.{c}").eqNullSafe(F.col(f"_kept.{c}")) for c in ("doc_id", "text_hash")]
    out = docs.join(kept, alike[0] & alike[1], "left_semi")
    return out.dropDuplicates(["doc_id", "text"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights; none loses a document, none is taken more
    than one and a half times."""
    ship(spark)
    return mixing.mix(docs, max_repeat=1.5).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    import public_tokenizers
    ship(spark)
    return packing.pack(spark, docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can express neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
