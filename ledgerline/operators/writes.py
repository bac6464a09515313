"""Keyed writes and lookups (S1 to S19). As frames, each is an anti-join and a union; sources/keyed.py has the tables on disk, of which only touched buckets are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ledgerline.functions import text as T
from ledgerline.sources.keyed import KeyedTable

from .corpus import clip


def new_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files not recorded yet, by name."""
    return files.join(documents.select("source_file"), "source_file", "left_anti").orderBy("source_file")


def listed_files(spark, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below a path, without reading their contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "path", "length", "modificationTime")


def dup_period_filter(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files with the existing file of their (department, quarter, year), null if they are new."""
    keys = ["department", "quarter", "year"]
    have = documents.groupBy(*keys).agg(F.min_by("source_file", "id").alias("existing"))
    return files.join(have, keys, "left")


def reupload_filter(files: DataFrame) -> DataFrame:
    """S3: drops copies named '… (n).pdf'."""
    return files.where(~F.col("source_file").rlike(r" \([0-9]+\)\.pdf$"))


def replace_by_source(table: DataFrame, fresh: DataFrame, key: str = "source_file") -> DataFrame:
    """The fresh rows in place of all rows of their files."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert_documents(documents: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """Documents (source_file, ..., ingested_at, reingested_at) with the batch's last row of each file; a known file keeps ingested_at."""
    last = Window.partitionBy("source_file").orderBy(F.desc("seq"))
    fresh = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")
    old = documents.select("source_file", F.col("ingested_at").alias("_at"))
    now = F.lit(as_of).cast("timestamp")
    fresh = fresh.join(old, "source_file", "left").withColumn("ingested_at", F.coalesce("_at", now)).withColumn("reingested_at", F.when(F.col("_at").isNotNull(), now)).drop("_at")
    return documents.join(fresh.select("source_file"), "source_file", "left_anti").unionByName(fresh)


def put_documents(table: KeyedTable, batch: DataFrame, as_of: str) -> None:
    """S5 on disk: only the buckets of the batch's files are rewritten."""
    now = F.lit(as_of).cast("timestamp")

    def times(fresh: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is None:
            return fresh.withColumns({"ingested_at": now, "reingested_at": F.lit(None).cast("timestamp")})
        known = old.select("source_file", F.col("ingested_at").alias("_at"))
        return fresh.join(known, "source_file", "left").withColumns({"ingested_at": F.coalesce("_at", now), "reingested_at": F.when(F.col("_at").isNotNull(), now)}).drop("_at")

    table.upsert(batch, "seq", times)


def fresh_chunks(batch: DataFrame) -> DataFrame:
    """The batch's rows that have an embedding, of each chunk the one of the greatest seq, as chunk_id, embedding, text and payload, its other columns as JSON."""
    fixed = ("chunk_id", "embedding", "text")
    rest = [c for c in batch.columns if c not in fixed]
    last = [F.col("seq")] if "seq" in rest else []
    newest = Window.partitionBy("chunk_id").orderBy(*(c.desc() for c in last), F.xxhash64(*fixed, *rest))  # the last row wins; without seq, rows have no order, and the choice is fixed
    fresh = batch.where("embedding is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    rest = [c for c in rest if c != "seq"]
    return fresh.select(*fixed, F.to_json(F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("payload"))


def upsert_chunks(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """Chunks (chunk_id, embedding, text, payload) with the batch's fresh_chunks() in place of those of their ids."""
    fresh = fresh_chunks(batch)
    return chunks.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def put_chunks(table: KeyedTable, batch: DataFrame) -> None:
    """S6 on disk: only the buckets of the batch's chunks are rewritten."""
    table.replace(fresh_chunks(batch))


def delete_document(tables: dict[str, DataFrame], source_file: str, edges: DataFrame | None = None, chunks: str = "chunks") -> dict[str, DataFrame]:
    """Every table without the file's rows; edges also without those of its chunks and its document node."""
    out = {k: t.where(~F.coalesce(F.col("source_file") == source_file, F.lit(False))) for k, t in tables.items()}
    if edges is not None:
        gone = tables[chunks].where(F.col("source_file") == source_file).select(F.col("chunk_id").alias("src")).withColumn("src_label", F.lit("Chunk"))
        out["edges"] = edges.join(gone, ["src_label", "src"], "left_anti").where(~((F.col("dst_label") == "Document") & (F.col("dst") == source_file)))
    return out


def legacy_vacancy_delete(vacancies: DataFrame, chunks: DataFrame, source_file: str) -> DataFrame:
    """Drops a file's vacancies, also those without a file whose chunk belongs to it."""
    own = chunks.where(F.col("source_file") == source_file).select(F.col("chunk_id").alias("source_chunk_id")).distinct().withColumn("_own", F.lit(True))
    rows = vacancies.join(own, "source_chunk_id", "left")
    gone = F.coalesce(F.col("source_file") == source_file, F.col("_own"), F.lit(False))
    return rows.where(~gone).drop("_own")


def backfill_source_file(vacancies: DataFrame, chunks: DataFrame) -> DataFrame:
    """A missing file from the row's chunk."""
    per = chunks.groupBy(F.col("chunk_id").alias("source_chunk_id")).agg(F.min("source_file").alias("_f"))
    return vacancies.join(per, "source_chunk_id", "left").withColumn("source_file", F.coalesce("source_file", "_f")).drop("_f")


def conform(rows: DataFrame, schema: ST.StructType, clipped: bool = True, **stamps) -> DataFrame:
    """The schema's columns of rows, cast, missing ones null, strings clipped, with constant stamps."""
    have = set(rows.columns)
    cols = [F.lit(stamps[f.name]) if f.name in stamps else F.col(f.name) if f.name in have else F.lit(None) for f in schema]
    out = rows.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(cols, schema, strict=True)))
    return clip(out) if clipped else out


# Columns of the typed tables.
COLUMNS = {
    "expenditures": "department string, sub_department string, account_number string, line_item string, revised_budget decimal(15,2), ytd_expended decimal(15,2), quarter string, year int",
    "metrics": "department string, metric_name string, metric_value decimal(15,2), metric_unit string, quarter string, year int",
    "grants": "department string, grant_name string, grant_number string, amount decimal(15,2), start_date date, end_date date, status string",
    "vacancies": "department string, position_title string, status string, open_count int, quarter string, year int",
    "resolutions": "resolution_number string, title string, amount decimal(15,2), vendor string, department string, adopted_date date, status string",
    "votes": "resolution_number string, council_member string, vote string",
    "meetings": "meeting_date date, session_type string, president string, members_present int, members_present_names string, members_absent_names string, call_to_order string, adjourned string",
    "meeting_actions": "meeting_date date, item_type string, item_number string, title string, action string, committee string",
    "legislation": "bill_number string, title string, sponsor string, amount decimal(15,2), adopted_date date, status string",
    "appropriations": "department string, fiscal_year int, fund string, category string, amount decimal(15,2)",
    "goals": "department string, year int, quarter string, goal_title string, description string, target string, status string",
    "projects": "department string, project_name string, description string, status string, funding_source string, quarter string, year int",
}


def typed_append(table: str, rows: DataFrame, **stamps) -> DataFrame:
    """Rows for one of COLUMNS, with the columns source_chunk_id and source_file, which stamps may set.

    Missing columns are null and further ones are dropped. Dates that are not YYYY-MM-DD are null, a vote is trimmed and empty
    ones are null; goals alone are not clipped.
    """
    schema = ST.StructType.fromDDL(f"{COLUMNS[table]}, source_chunk_id string, source_file string")
    for f in schema:
        if isinstance(f.dataType, ST.DateType) and f.name in rows.columns:
            rows = rows.withColumn(f.name, T.strict_date(F.col(f.name).cast("string")))
    if table == "votes" and "vote" in rows.columns:
        rows = rows.withColumn("vote", T.clean_vote(F.col("vote")))
    append = typed_vacancies if table == "vacancies" else conform
    return append(rows, schema, clipped=table != "goals", **stamps)


def typed_vacancies(rows: DataFrame, schema: ST.StructType, **stamps) -> DataFrame:
    """S11 for vacancies, whose count may come as open_count or count."""
    if "count" in rows.columns:
        rows = rows.withColumn("open_count", F.coalesce(F.col("open_count") if "open_count" in rows.columns else F.lit(None), F.col("count")))
    return conform(rows, schema, **stamps)


def append_log(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended, nested values as JSON text."""
    nested = (ST.StructType, ST.ArrayType, ST.MapType)
    flat = rows.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema))
    return table.unionByName(flat, allowMissingColumns=True)


STATUSES = ("", "not_started", "in_progress", "completed")


def set_user_status(goals: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Goals with the last valid edit (id, seq, status) of each id, '' clearing it; and the edits that apply to nothing."""
    good = edits.where(F.col("status").isin(*STATUSES))
    last = good.groupBy("id").agg(F.max_by("status", "seq").alias("_s"))
    out = goals.join(last, "id", "left").withColumn("user_status", F.when(F.col("_s").isNull(), F.col("user_status")).otherwise(F.nullif("_s", F.lit("")))).drop("_s")
    bad = edits.join(goals.select("id"), "id", "left_anti").unionByName(edits.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).join(goals.select("id"), "id", "left_semi"))
    return out, bad


def carry_user_status(old: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fresh goals with the status that the clerk had set on the same goal, and old goals with one that found none.

    A goal is told by department, year, quarter and title; missing parts match missing parts. The last old row with a status
    gives it, with the time it was set if there is such a column, to the first fresh row.
    """
    keys = ["department", "year", "quarter", "goal_title"]
    group = F.struct(*keys).alias("_g")  # a struct is never null, and equal where its fields are, null ones too
    carried = [c for c in ("user_status", "user_status_at") if c in old.columns and c in fresh.columns]
    last = Window.partitionBy("_g").orderBy(F.desc("id"))
    kept = old.where("user_status is not null and user_status <> ''").withColumn("_g", group).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    new = fresh.withColumn("_g", group).withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy("id")))
    given = kept.select("_g", F.lit(1).alias("_k"), F.struct(*carried).alias("_s"))
    out = new.join(given, ["_g", "_k"], "left")
    for c in carried:
        out = out.withColumn(c, F.when(F.col("_s").isNotNull(), F.col("_s")[c]).otherwise(F.col(c)))
    return out.select(*fresh.columns), kept.join(new.select("_g"), "_g", "left_anti").select(*old.columns)


def apply_scores(logs: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (query_id, retrieval, accuracy, completeness) over what a log has."""
    cols = ("retrieval", "accuracy", "completeness")
    new = scores.select("query_id", *(F.col(c).alias(f"_{c}") for c in cols))
    out = logs.join(new, "query_id", "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop(*(f"_{c}" for c in cols))


def apply_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback (query_id, feedback, category, notes); notes as 'category: notes' where there is a category."""
    new = feedback.select("query_id", F.col("feedback").alias("user_feedback"), F.nullif(F.concat_ws(": ", F.nullif("category", F.lit("")), "notes"), F.lit("")).alias("user_notes"))
    return logs.drop("user_feedback", "user_notes").join(new, "query_id", "left")


def chunks_by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ids (chunk_id) with score 1."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("score", F.lit(1.0))


def adhoc_sql(spark, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over the tables, written as {name} in its text."""
    return spark.sql(sql, **tables)


def keyword_scan(chunks: DataFrame, keyword: str, source_file: str | None = None) -> DataFrame:
    """Chunks with a keyword, and optionally of one file."""
    rows = chunks.where(F.col("text").ilike(f"%{keyword}%"))
    return rows.where(F.col("source_file") == source_file) if source_file else rows


def list_documents(documents: DataFrame) -> DataFrame:
    """Newest first."""
    return documents.orderBy(F.desc_nulls_last("ingested_at"), "id")


def list_types(registry: DataFrame) -> DataFrame:
    """Active types by display name."""
    return registry.where("active").orderBy("display_name", "name")


def file_keys(documents: DataFrame, as_of_year: int) -> DataFrame:
    """Files with the department, quarter and year that their names tell."""
    return documents.select("id", "source_file", *(c.alias(f"file_{k}") for k, c in T.filename_meta(F.col("source_file"), as_of_year).items()))
