"""Retrieval over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors


def vector_topk(requests: DataFrame, chunks: DataFrame, k: int = 5, filters: tuple[str, ...] = (), counter=None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best k chunks by cosine, of those whose filter columns equal the request's.

    Exact: vectors are compared by matrix products, and blocks of them that cannot enter the best k are skipped. Requests are
    collected in blocks whose bytes are checked and sent to the tasks; only each task's best k per request are shuffled. counter: an
    accumulator of the compared pairs. Scores have six places; of equal ones the smallest chunk_id ranks first. Null and zero vectors, and
    those of another dimension, score nothing.
    """
    return vectors.ranked(vectors.exact(requests, chunks, k, filters, counter), k)


def vector_topk_approx(requests: DataFrame, index: str, k: int = 5, probes: int | None = None) -> DataFrame:
    """R2: as R1 without filters, through an index that vectors.build_index() has written to the folder `index`."""
    return vectors.search(requests, index, k, probes)


def weak_retrieval(requests: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Requests with no vector chunk, SQL row or graph record in retrieved (query_id, store, ...)."""
    per = retrieved.groupBy("query_id").agg(F.count_if(F.col("store").isin("vector", "sql", "graph")).alias("n"))
    return requests.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce(F.col("n") == 0, F.lit(True)).alias("weak"))


def fallback_topk(requests: DataFrame, retrieved: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """Weak requests again, without filters."""
    weak = weak_retrieval(requests, retrieved).where("weak")
    return vector_topk(requests.join(weak.select("query_id"), "query_id", "left_semi"), chunks, k).withColumn("store", F.lit("vector_fallback"))


def entity_chunks(records: DataFrame, edges: DataFrame, names: int = 10, limit: int = 5) -> DataFrame:
    """Chunks that mention the names in graph records (query_id, value): the first `names` by name, the first `limit` chunks.

    The first chunks of several names are among the first of each, so a name's later chunks are dropped before requests meet them: a request joins
    `names` times `limit` rows at most, however many chunks mention its names.
    """
    first = Window.partitionBy("query_id").orderBy("value")
    asked = records.where(F.length("value") > 2).select("query_id", "value").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= names)
    said = edges.where("rel = 'MENTIONS'").select(F.col("dst").alias("value"), F.col("src").alias("chunk_id")).distinct()
    said = said.withColumn("at", F.row_number().over(Window.partitionBy("value").orderBy("chunk_id"))).where(F.col("at") <= limit)
    hits = asked.join(said, "value").select("query_id", "chunk_id").distinct()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")).cast("long")).where(F.col("rank") <= limit)


def clarity(requests: DataFrame, retrieved: DataFrame, least_mean: float = 0.25, least_top: float = 0.30, most_headers: float = 0.80) -> DataFrame:
    """Retrieval quality of each request from retrieved (query_id, store, score, source_file, content_type)."""
    chunk = F.col("store").isin("vector", "vector_fallback")
    per = retrieved.groupBy("query_id").agg(
        F.count_if(chunk).alias("n_chunks"), F.max(F.when(chunk, F.col("score"))).alias("top"), F.avg(F.when(chunk, F.col("score").cast("decimal(18,6)"))).cast("double").alias("mean"),
        F.count_distinct(F.when(chunk, F.nullif("source_file", F.lit("")))).alias("n_docs"), F.count_if(chunk & (F.col("content_type") == "header")).alias("headers"), F.count_if(F.col("store").isin("sql", "graph")).alias("facts"),
    )
    rows = requests.select("query_id").join(per, "query_id", "left").fillna(0, ["n_chunks", "top", "mean", "n_docs", "headers", "facts"])
    ratio = F.coalesce(F.col("headers") / F.nullif("n_chunks", F.lit(0)), F.lit(0.0))
    flag = (F.col("facts") == 0) & ((F.col("n_chunks") == 0) | (F.col("top") < least_top))
    return rows.select("query_id", "n_chunks", "n_docs", F.bround("top", 4).alias("top"), F.bround("mean", 4).alias("mean"), F.bround(ratio, 4).alias("header_ratio"), (F.col("mean") < least_mean).alias("low_mean"), (ratio > most_headers).alias("mostly_headers"), flag.alias("would_flag"))


def citations(retrieved: DataFrame) -> DataFrame:
    """Source of each retrieved chunk with department, section, quarter and year; empty fields, a year of 0 and columns that are not there as NULL."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    field = lambda c, kind: F.col(c).cast(kind) if c in retrieved.columns else F.lit(None).cast(kind)
    fields = [some(field(c, "string")).alias(c) for c in ("department", "section", "quarter")]
    return retrieved.select("query_id", "chunk_id", F.coalesce(some("source_file"), F.lit("unknown")).alias("source_file"), *fields, F.nullif(field("year", "int"), F.lit(0)).alias("year"))


def context_text(requests: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One context string per request: its blocks by rank, or a marker."""
    block = F.concat(F.lit("["), F.coalesce(F.nullif("source_file", F.lit("")), F.lit("unknown")), F.lit("]\n"), F.col("text"))
    per = retrieved.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))
    return requests.select("query_id").join(per, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("No relevant information was found.")))


def query_log_rows(requests: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per request the store with most chunks and its ranked chunk ids as JSON."""
    per = retrieved.groupBy("query_id", "store").agg(F.count("*").alias("n"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])).alias("ids"))
    best = per.groupBy("query_id").agg(F.max_by("store", F.struct("n", "store")).alias("store"), F.max("n").alias("n"), F.max_by("ids", F.struct("n", "store")).alias("ids"))
    return requests.select("query_id").join(best, "query_id", "left").select("query_id", "store", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit("[]")).alias("ids"))


def routed_retrieve(plans: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """Results of the stores that each plan (query_id, sources) lists, ranked by their place in the plan.

    stores: store name to its results (query_id, item).
    """
    steps = plans.select("query_id", F.posexplode("sources").alias("place", "store"))
    out = None
    for name, rows in stores.items():
        part = steps.where(F.col("store") == name).join(rows.select("query_id", "item"), "query_id")
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", F.col("place").cast("long").alias("place"), "store", "item")
