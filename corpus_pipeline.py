"""A corpus from raw documents to tokens: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet into the shared folder and read again, so a lost
executor costs at most one stage's tasks.

Defined cases: null and empty texts are scored like any other; null ids come last in every order; rows of one id are
documents of their own, but rows equal in all columns are one after the near-dedup stage; other columns than those of
documents are dropped; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, line_dedup, mixing, quality, queries, simhash
from tessella.llm._shared import reliable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents scored below this go.
LEAST_QUALITY = 0.3
#: Differing bits of 64 up to which two fingerprints of 5-word shingles are linked: a similarity of 61/64.
MOST_BITS = 3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes; it is fitted on the folder's labels."""
    model = queries.fitted_quality(spark, docs, sf_dir)
    scored = quality.score(docs.select(*COLUMNS, F.col("text").alias("text_of")), model, text_col="text_of", keep=COLUMNS)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has."""
    got = line_dedup.dedup(docs.select(*COLUMNS))
    return got.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id, null last, then the least hash of the row.

    Two rows are linked if their fingerprints differ in up to MOST_BITS bits or their sets of five-word shingles have a
    Jaccard similarity of 0.8 or more; every such pair is found. An id isn't a key: rows of one id are rows of their own.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_k1"), F.xxhash64(F.lit(11), *COLUMNS).alias("_k2"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k1", "_k2").alias("key")
    of = simhash.groups(rows.select(key, "text"), k=5, most=MOST_BITS)
    kept = reliable(of.groupBy("component").agg(F.min("key").alias("key")).select(F.col("key._k1").alias("_k1"), F.col("key._k2").alias("_k2")))
    # rows equal in all columns are one
    return rows.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 5, 2, 1, repeating, at most 3 epochs."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where(F.col("mix_.copies") > 0)
    return mixed.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_.copies")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row."""
    got = bpe.encode(docs, queries.word_vocabulary(), with_ids=True)
    return got.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe encoding", encoding_stage),
]

#: SQL has neither the model nor the encoding; tests/llm compares the stages' operators with brute force, the tokenizers library or held-out labels, one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = table(docs)
    return docs
