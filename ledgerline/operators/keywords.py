"""Keyword search in chunk texts through a stored table of trigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .writes import keyword_scan

BUCKETS = 64


def trigrams(text: str) -> list[str]:
    """Distinct sequences of three code points of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return []
    found = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])
    letters = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [letters[i : i + 3] for i in range(0, len(letters), 3)]


def gram_rows(batches):
    """chunk_id and gram of Arrow batches of chunk_id and text, a batch of rows for each text."""
    for b in batches:
        for i, text in enumerate(b.column(1)):
            grams = trigrams(text.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(grams), pa.int32())), pa.array(grams, pa.string())], names=["chunk_id", "gram"])


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_trigrams(chunks: DataFrame, path: str) -> None:
    """Writes which trigrams each of chunks (chunk_id, text) has to the new folder `path`: a Parquet partition for each of BUCKETS hash values of trigrams,
    with rows in order of trigrams, so that a search reads the few row groups that hold its own. Frequent trigrams are spread over tasks. Rows of one chunk_id
    may repeat a trigram."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", F.lower("text").alias("text")).where("text is not null").mapInArrow(gram_rows, f"chunk_id {kind}, gram string").withColumn("bucket", bucket(F.col("gram")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "chunk_id").write.partitionBy("bucket").parquet(path)


def grams_of(keyword: str) -> list[str]:
    low = keyword.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def candidates(spark, path: str, keyword: str) -> DataFrame:
    """chunk_ids that have all trigrams of a keyword of three letters or more; reads the buckets of these trigrams alone."""
    grams = grams_of(keyword)
    buckets = spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket(F.col("gram")).alias("b")).distinct().collect()  # one for each trigram at most
    rows = spark.read.parquet(path).where(F.col("bucket").isin([r.b for r in buckets]) & F.col("gram").isin(grams))
    return rows.groupBy("chunk_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("chunk_id")


def keyword_search(chunks: DataFrame, path: str, keyword: str) -> DataFrame:
    """S18 through the trigrams written to `path`: the same chunks as keyword_scan() finds, in any case of letters. Candidates are verified on the full text.
    Keywords of fewer than three letters, with letters beyond ASCII or with signs that patterns have are scanned for."""
    if len(keyword) < 3 or not keyword.isascii() or set(keyword) & set("%_\\"):
        return keyword_scan(chunks, keyword)
    return keyword_scan(chunks.join(candidates(chunks.sparkSession, path, keyword), "chunk_id", "left_semi"), keyword)
