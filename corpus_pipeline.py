"""The training-data pipeline: each stage filters or rewrites what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``; rows that a stage keeps pass unchanged, but for secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import free_prefix, stored
from quillspark.llm.decontamination import drop_leaks
from quillspark.llm.jaccard_join import near_duplicates
from quillspark.llm.quality_rules import quality_filter
from quillspark.llm.queries import tokenizer_file
from quillspark.llm.secret_scan import dictionary, labelled_findings, redact_secrets, train_forest
from quillspark.llm.sentencepiece_codec import encode_decode
from quillspark.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality_filter(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, Jaccard 0.8) the first row of the table stays.

    Rows are told apart by a number that is written with them, so null and repeated
    ids are rows like others.
    """
    ship(spark)
    row = f"{free_prefix(docs, '_')}row"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, row, n=5, percent=80)
    return numbered.join(found.where(F.col("component_id") != F.col(row)).select(row), row, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    ship(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced, and the number of characters follows."""
    ship(spark)
    words = dictionary(docs)
    out = redact_secrets(docs, train_forest(labelled_findings(spark), words), words=words)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids with the end id, and the digest of what they decode to."""
    ship(spark)
    out = encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("SentencePiece encoding and decoding", encode),
]

#: Edit distances, a trained forest and subword merges are beyond SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
