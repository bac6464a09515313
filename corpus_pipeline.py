"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

Stages but the last return the columns of their input, and add none of their own that could clash with them. Each takes null
texts and ids, repeated rows, texts of any length and an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language, minhash, mixing, tokens
from ledgerline.llm.shared import shared_path, small_batches, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter, so also empty ones. Each row is judged alone; the label may be null, the prediction isn't.
    If nothing is labelled, as in an empty table, nothing is known and nothing stays."""
    small_batches(spark)
    predict = language.predictor(language.train(docs.where(language.fold() != 0)))
    return docs.where(predict(F.col("text").cast("string"))["lang_pred"] != "und")


def numbered(docs: DataFrame) -> DataFrame:
    """node, text and row (a struct of all columns): node is the doc_id where that tells rows apart, else a number in the order of doc_id and text."""
    row = F.struct(*docs.columns).alias("row")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"), row)
    if texts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1 or node is null").isEmpty():
        return texts
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartitionByRange(parts, "node", F.md5("text")).sortWithinPartitions("node", "text").select("text", "row", F.monotonically_increasing_id().alias("node"))
    return written(dealt, "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): the one of the smallest doc_id, then of the first text.

    Rows that share a doc_id, or have none, are documents of their own: different texts stay, equal ones are copies. Rows
    without words link with nothing and stay.
    """
    small_batches(spark)
    rows = numbered(docs)
    kept = minhash.near_duplicates(rows.select(F.col("node").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("node"))
    return rows.join(kept.hint("shuffle_hash"), "node", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items, each row judged by its own text; null and empty texts hold none."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, "benchmark", sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in order of their training positions. Documents without words are not taken; a null source is a source."""
    return mixing.schedule(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns what it holds of each document, one row per row.

    Documents that were read from files keep the order of these, which is that of their training positions; else they are in
    ascending doc_id order. Null and empty texts have their end id only.
    """
    small_batches(spark)
    path = tokens.write_tokens(docs, tokens.vocabulary(), given=tokens.in_files(docs))
    return tokens.read_tokens(spark, path, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_ids),
]

#: Model training, sketches and tokenizers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, "documents", sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
