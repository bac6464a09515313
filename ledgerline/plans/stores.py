"""Queries of retrieval, keyed writes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ledgerline.operators import keywords
from ledgerline.operators import questions as U
from ledgerline.operators import retrieval as R
from ledgerline.operators import vectors
from ledgerline.operators import writes as S
from ledgerline.sources.scratch import scratch_path
from ledgerline.streaming import jobs

from .analytics import M4
from .corpus import SECTIONS
from .registry import query

# Retrieval ----------------------------------------------------------------------------------------------------------

COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)"


def topk(k: int, where: str = "true", requests: str = "v_requests") -> str:
    return f"(SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.query_id, c.chunk_id, {COS} AS score FROM {requests} q JOIN v_chunks c ON {where})) WHERE rank <= {k})"


query("R1_vector_topk", lambda t: R.vector_topk(t.requests, t.chunks, filters=("label",)), f"SELECT * FROM {topk(5, 'q.label = c.label')}", "requests", "chunks")


_indexes: dict[tuple[str, str, str], str] = {}


def index_of(t, kind: str = "vectors") -> str:
    """An index of the chunks, written when it is first asked for in a session and read by later calls."""
    at = (t.spark.sparkContext.applicationId, t.sf_dir, kind)
    if at not in _indexes:
        path = scratch_path(t.spark, kind)
        {"vectors": vectors.build_index, "trigrams": keywords.write_trigrams}[kind](t.chunks, path)
        _indexes[at] = path
    return _indexes[at]


query("R2_vector_topk_approx", lambda t: R.vector_topk_approx(t.requests, index_of(t)))


def retrieved(t):
    """Filtered results of all requests."""
    return R.vector_topk(t.requests, t.chunks, filters=("label",)).withColumn("store", F.lit("vector")).join(t.chunks.select("chunk_id", "label", "text", "source_file", "department", F.when(F.col("label") % 2 == 0, "header").otherwise("narrative").alias("content_type")), "chunk_id")


GOT = topk(5, "q.label = c.label")
#: Results below this score, and a request's own vector, do not count: it leaves many requests without any.
LEAST = 0.9
close = lambda t: retrieved(t).where((F.col("score") >= LEAST) & (F.col("chunk_id") != F.col("query_id")))
CLOSE = f"(SELECT query_id FROM {GOT} WHERE score >= {LEAST} AND chunk_id <> query_id)"
query("R3_weak_retrieval", lambda t: R.weak_retrieval(t.requests, close(t)), f"SELECT query_id, query_id NOT IN {CLOSE} AS weak FROM v_requests", "requests", "chunks")
query("R4_fallback_topk", lambda t: R.fallback_topk(t.requests, close(t), t.chunks), f"SELECT *, 'vector_fallback' AS store FROM {topk(8, 'true', f'(SELECT * FROM v_requests WHERE query_id NOT IN {CLOSE})')}", "requests", "chunks")


def entities(t):
    records = t.requests.select("query_id", F.concat(F.lit("word"), (F.col("label") % 4).cast("string")).alias("value"))
    edges = t.chunks.select(F.lit("MENTIONS").alias("rel"), F.col("chunk_id").alias("src"), F.concat(F.lit("word"), F.col("label").cast("string")).alias("dst"))
    return R.entity_chunks(records, edges)


query("R5_entity_chunks", entities, "SELECT query_id, chunk_id, rank FROM (SELECT q.query_id, c.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.chunk_id) AS rank FROM v_requests q JOIN v_chunks c ON c.label = q.label % 4) WHERE rank <= 5", "requests", "chunks")
query(
    "R6_clarity", lambda t: R.clarity(t.requests, retrieved(t)),
    f"""SELECT q.query_id, count(g.chunk_id) AS n_chunks, count(DISTINCT c.source_file) AS n_docs, round_even(coalesce(max(score), 0), 4) AS top, round_even(coalesce(avg(score::DECIMAL(18,6)), 0), 4) AS mean, round_even(coalesce(count(*) FILTER (WHERE c.label % 2 = 0) / nullif(count(g.chunk_id), 0), 0), 4) AS header_ratio,
  coalesce(avg(score::DECIMAL(18,6)), 0) < 0.25 AS low_mean, coalesce(count(*) FILTER (WHERE c.label % 2 = 0) / nullif(count(g.chunk_id), 0), 0) > 0.8 AS mostly_headers, coalesce(max(score), 0) < 0.3 AS would_flag FROM v_requests q LEFT JOIN {GOT} g ON g.query_id = q.query_id LEFT JOIN v_chunks c ON c.chunk_id = g.chunk_id GROUP BY 1""",
    "requests", "chunks",
)
PLACES = "CASE WHEN label % 5 = 0 THEN '' ELSE 'Section ' || CAST(label AS STRING) END AS section, CASE WHEN label % 3 = 0 THEN ' ' ELSE 'Q2' END AS quarter, CASE WHEN label % 7 = 0 THEN 0 ELSE 2020 + label % 5 END AS year"
query("R7_citations", lambda t: R.citations(t.spark.sql(f"SELECT *, {PLACES} FROM {{r}}", r=retrieved(t))), f"SELECT query_id, chunk_id, source_file, department, nullif(section, '') AS section, nullif(quarter, ' ') AS quarter, nullif(year, 0)::INT AS year FROM (SELECT g.query_id, g.chunk_id, c.source_file, c.department, {PLACES} FROM {GOT} g JOIN v_chunks c ON c.chunk_id = g.chunk_id)", "requests", "chunks")
query(
    "R8_context_text", lambda t: R.context_text(t.requests, retrieved(t)).select("query_id", F.length("context").cast("long").alias("n"), F.md5("context").alias("digest")),
    f"SELECT q.query_id, length(x) AS n, md5(x) AS digest FROM (SELECT q.query_id, coalesce(string_agg('[' || c.source_file || ']' || chr(10) || c.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY g.rank), 'No relevant information was found.') AS x FROM v_requests q LEFT JOIN {GOT} g ON g.query_id = q.query_id LEFT JOIN v_chunks c ON c.chunk_id = g.chunk_id GROUP BY 1) q", "requests", "chunks",
)
query(
    "R9_query_log_rows", lambda t: R.query_log_rows(t.requests, retrieved(t)),
    f"SELECT q.query_id, CASE WHEN count(g.chunk_id) > 0 THEN 'vector' END AS store, count(g.chunk_id) AS n, '[' || coalesce(string_agg('\"' || g.chunk_id || '\"', ',' ORDER BY g.rank), '') || ']' AS ids FROM v_requests q LEFT JOIN {GOT} g ON g.query_id = q.query_id GROUP BY 1", "requests", "chunks",
)


def routed(t):
    plans = t.requests.select("query_id", F.when(F.col("label") % 2 == 0, F.array(F.lit("sql"), F.lit("vector"))).otherwise(F.array(F.lit("vector"))).alias("sources"))
    stores = {"vector": R.vector_topk(t.requests, t.chunks, 3, ("label",)).select("query_id", F.col("chunk_id").alias("item")), "sql": t.requests.select("query_id", F.concat(F.lit("row"), F.col("label").cast("string")).alias("item"))}
    return R.routed_retrieve(plans, stores)


query(
    "R10_routed_retrieve", routed,
    f"""SELECT g.query_id, CASE WHEN q.label % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS place, 'vector' AS store, chunk_id AS item FROM {topk(3, "q.label = c.label")} g JOIN v_requests q ON q.query_id = g.query_id
  UNION ALL SELECT query_id, 0, 'sql', 'row' || label FROM v_requests WHERE label % 2 = 0""", "requests", "chunks",
)
ENGLISH = "q.label = c.label AND c.department = 'en'"
query("U15_narrative", lambda t: U.narrative(t.requests, t.chunks.where("department = 'en'"), ("label",)), f"SELECT * FROM {topk(5, ENGLISH)}", "requests", "chunks")
query(
    "U16_narrative_and_figures", lambda t: U.narrative_and_figures(t.requests, t.chunks, t.chunks.groupBy("department").agg(F.count("*").alias("n"))).select("query_id", "chunk_id", "rank", "department", "n"),
    f"SELECT g.query_id, g.chunk_id, g.rank, c.department, f.n FROM {topk(5)} g JOIN v_chunks c ON c.chunk_id = g.chunk_id JOIN (SELECT department, count(*) AS n FROM v_chunks GROUP BY 1) f ON f.department = c.department", "requests", "chunks",
)

# Keyed writes -------------------------------------------------------------------------------------------------------

half = lambda t: t.registry.where("id % 2 = 0")
query("S1_new_files", lambda t: S.new_files(t.registry.select("id", "source_file"), half(t)), "SELECT id, source_file FROM v_registry WHERE id % 2 = 1", "registry")
query(
    "S2_dup_period_filter", lambda t: S.dup_period_filter(t.registry.select("id", "department", "quarter", "year"), half(t)),
    "SELECT r.id, r.department, r.quarter, r.year, e.existing FROM v_registry r LEFT JOIN (SELECT department, quarter, year, arg_min(source_file, id) AS existing FROM v_registry WHERE id % 2 = 0 GROUP BY ALL) e ON e.department = r.department AND e.quarter = r.quarter AND e.year = r.year", "registry",
)
query("S3_reupload_filter", lambda t: S.reupload_filter(t.registry.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("a ("), F.col("id").cast("string"), F.lit(").pdf"))).otherwise(F.col("source_file")).alias("source_file"))), "SELECT id, source_file FROM v_registry WHERE id % 3 <> 0", "registry")
query(
    "S4_replace_by_source", lambda t: S.replace_by_source(t.grants.select("id", "source_file", "status"), t.grants.where("source_file < 'report_2'").select((F.col("id") + 1000000).alias("id"), "source_file", F.lit("fresh").alias("status"))),
    "SELECT id, source_file, status FROM v_grants WHERE NOT source_file < 'report_2' UNION ALL SELECT id + 1000000, source_file, 'fresh' FROM v_grants WHERE source_file < 'report_2'", "grants",
)


def upserted(t):
    docs = half(t).select("source_file", "document_type", "ingested_at", F.lit(None).cast("timestamp").alias("reingested_at"))
    batch = t.registry.where("id % 3 = 0").select("source_file", F.lit("new").alias("document_type"), F.col("id").alias("seq"))
    batch = batch.unionByName(batch.withColumn("document_type", F.lit("first")).withColumn("seq", F.lit(-1)))
    return S.upsert_documents(docs, batch, "2026-06-01").select("source_file", "document_type", F.col("ingested_at").cast("date").alias("ingested"), F.col("reingested_at").cast("date").alias("reingested"))


query(
    "S5_upsert_documents", upserted,
    "SELECT source_file, CASE WHEN id % 3 = 0 THEN 'new' ELSE document_type END AS document_type, (CASE WHEN id % 2 = 0 THEN ingested_at::DATE ELSE DATE '2026-06-01' END)::VARCHAR AS ingested, CASE WHEN id % 6 = 0 THEN '2026-06-01' END AS reingested FROM v_registry WHERE id % 2 = 0 OR id % 3 = 0", "registry",
)


def chunk_upsert(t):
    old = t.chunks.where("cast(chunk_id as bigint) % 2 = 0").select("chunk_id", "embedding", "text", F.lit("{}").alias("payload"))
    batch = t.chunks.where("cast(chunk_id as bigint) % 3 = 0").select("chunk_id", F.when(F.col("chunk_id").cast("long") % 5 != 0, F.col("embedding")).alias("embedding"), "text", F.col("department").alias("dept"))
    return S.upsert_chunks(old, batch).select("chunk_id", "payload")


query("S6_upsert_chunks", chunk_upsert, "SELECT chunk_id, CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN '{\"dept\":\"' || department || '\"}' ELSE '{}' END AS payload FROM (SELECT *, chunk_id::BIGINT AS n FROM v_chunks) WHERE n % 2 = 0 OR (n % 3 = 0 AND n % 5 <> 0)", "chunks")


def deleted(t):
    chunks = t.vacancies.where("id % 5 = 0").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), "source_file")
    edges = chunks.select(F.lit("Chunk").alias("src_label"), F.col("chunk_id").alias("src"), F.lit("Document").alias("dst_label"), F.coalesce("source_file", F.lit("none")).alias("dst"))
    out = S.delete_document({"vacancies": t.vacancies, "chunks": chunks}, "report_7.pdf", edges)
    rows = [d.agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k, d in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


query(
    "S7_delete_document", deleted,
    "SELECT 'vacancies' AS what, count(*) AS n FROM v_vacancies WHERE source_file IS DISTINCT FROM 'report_7.pdf' UNION ALL SELECT w, count(*) FROM v_vacancies, (SELECT unnest(['chunks', 'edges']) AS w) WHERE id % 5 = 0 AND source_file IS DISTINCT FROM 'report_7.pdf' GROUP BY 1", "vacancies",
)
owners = lambda t: t.spark.sql("SELECT DISTINCT 'c' || CAST(user_id AS STRING) AS chunk_id, 'report_' || CAST(user_id % 50 AS STRING) || '.pdf' AS source_file FROM {events}", events=t.events)
query("S8_legacy_vacancy_delete", lambda t: S.legacy_vacancy_delete(t.vacancies, owners(t), "report_7.pdf").select("id", "source_file"), "SELECT v.id, v.source_file FROM v_vacancies v JOIN events e ON e.event_id = v.id WHERE e.user_id % 50 <> 7", "vacancies")
query("S9_backfill_source_file", lambda t: S.backfill_source_file(t.vacancies, owners(t)).select("id", "source_file"), "SELECT event_id AS id, 'report_' || (user_id % 50) || '.pdf' AS source_file FROM events")
SCHEMA = ST.StructType([ST.StructField("department", ST.StringType()), ST.StructField("open_count", ST.IntegerType()), ST.StructField("status", ST.StringType()), ST.StructField("missing", ST.DoubleType()), ST.StructField("source_file", ST.StringType())])
query("S10_append_dynamic", lambda t: S.conform(t.vacancies.withColumn("status", F.repeat("status", 20)), SCHEMA, source_file="x.pdf"), "SELECT department, open_count, left(repeat(status, 20), 50) AS status, NULL::DOUBLE AS missing, 'x.pdf' AS source_file FROM v_vacancies", "vacancies")
query("S11_typed_appends", lambda t: S.typed_vacancies(t.vacancies.withColumn("count", F.lit(4)), SCHEMA, source_file="x.pdf"), "SELECT department, coalesce(open_count, 4) AS open_count, status, NULL::DOUBLE AS missing, 'x.pdf' AS source_file FROM v_vacancies", "vacancies")
query(
    "S11_typed_grants", lambda t: S.typed_append("grants", t.grants.withColumn("start_date", F.when(F.col("id") % 2 == 0, "2026").otherwise(F.col("start_date").cast("string"))).drop("grant_number", "source_file"), source_chunk_id="c", source_file="x.pdf").drop("grant_number"),
    "SELECT department, grant_name, amount::DOUBLE AS amount, CASE WHEN id % 2 <> 0 THEN start_date::VARCHAR END AS start_date, end_date::VARCHAR AS end_date, status, 'c' AS source_chunk_id, 'x.pdf' AS source_file FROM v_grants", "grants",
)
query("S11_typed_votes", lambda t: S.typed_append("votes", t.votes.withColumn("vote", F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("vote"))), source_chunk_id="c"), "SELECT resolution_number, council_member, CASE WHEN id % 3 <> 0 THEN trim(vote) END AS vote, 'c' AS source_chunk_id, source_file FROM v_votes", "votes")
query(
    "S12_append_logs", lambda t: S.append_log(t.review_flags.select("id", F.lit(None).cast("string").alias("detail")).where("resolved"), t.review_flags.where("not resolved").select("id", F.struct("stage", F.array("id").alias("ids")).alias("detail"))),
    "SELECT id, CASE WHEN NOT resolved THEN '{\"stage\":\"' || stage || '\",\"ids\":[' || id || ']}' END AS detail FROM v_review_flags", "review_flags",
)


def statuses(t):
    e = t.goals.where("id % 7 = 0").select("id", F.lit(1).alias("seq"), F.lit("completed").alias("status"))
    e = e.unionByName(t.goals.where("id % 14 = 0").select("id", F.lit(2).alias("seq"), F.lit("").alias("status"))).unionByName(t.goals.where("id % 7 = 0").select("id", F.lit(3).alias("seq"), F.lit("bad").alias("status")))
    return S.set_user_status(t.goals, e)[0].select("id", "user_status")


query("S13_set_user_status", statuses, "SELECT id, CASE WHEN id % 14 = 0 THEN NULL WHEN id % 7 = 0 THEN 'completed' ELSE user_status END AS user_status FROM v_goals", "goals")


def carried(t):
    old = t.goals
    fresh = t.goals.where("id % 5 <> 0").withColumn("user_status", F.lit(None).cast("string")).withColumn("id", F.col("id") + 1000000)
    out, left = S.carry_user_status(old, fresh)
    return out.agg(F.count_if(F.col("user_status") == "completed").alias("carried"), F.count("*").alias("rows")).crossJoin(left.agg(F.count("*").alias("unmatched")))


query(
    "S14_carry_user_status", carried,
    """+ k AS (SELECT department, year, quarter, goal_title, bool_or(user_status <> '') AS o, count(*) FILTER (WHERE id % 5 <> 0) AS f FROM v_goals GROUP BY ALL)
SELECT count(*) FILTER (WHERE o AND f > 0) AS carried, sum(f)::BIGINT AS rows, count(*) FILTER (WHERE o AND f = 0) AS unmatched FROM k""", "goals",
)


def scored(t):
    logs = t.query_scores.select("query_id", "retrieval", "accuracy", F.lit(None).cast("decimal(3,2)").alias("completeness"))
    logs = S.apply_scores(logs, t.query_scores.where("query_id % 2 = 0").select("query_id", F.lit(1).cast("decimal(3,2)").alias("retrieval"), F.lit(None).cast("decimal(3,2)").alias("accuracy"), "completeness"))
    return S.apply_feedback(logs, t.query_scores.where("query_id % 3 = 0").select("query_id", F.lit("bad").alias("feedback"), F.when(F.col("query_id") % 6 == 0, "wrong").otherwise("").alias("category"), F.lit("text").alias("notes")))


query(
    "S15_apply_scores_feedback", scored,
    "SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE retrieval::DOUBLE END::DOUBLE AS retrieval, accuracy::DOUBLE AS accuracy, CASE WHEN query_id % 2 = 0 THEN completeness::DOUBLE END AS completeness, CASE WHEN query_id % 3 = 0 THEN 'bad' END AS user_feedback, CASE WHEN query_id % 6 = 0 THEN 'wrong: text' WHEN query_id % 3 = 0 THEN 'text' END AS user_notes FROM v_query_scores", "query_scores",
)
query("S16_get_chunks_by_id", lambda t: S.chunks_by_id(t.chunks, t.requests.select(F.col("query_id").alias("chunk_id"))).select("chunk_id", "department", "score"), "SELECT chunk_id, department, 1.0::DOUBLE AS score FROM v_chunks WHERE chunk_id IN (SELECT query_id FROM v_requests)", "chunks", "requests")
query("S17_adhoc_sql", lambda t: S.adhoc_sql(t.spark, "SELECT status, count(*) AS n FROM {grants} WHERE amount > 1000 GROUP BY status", {"grants": t.grants}), "SELECT status, count(*) AS n FROM v_grants WHERE amount > 1000 GROUP BY 1", "grants")
query("S18_chunk_keyword_scan", lambda t: keywords.keyword_search(t.chunks, index_of(t, "trigrams"), "GRANT").unionByName(keywords.keyword_search(t.chunks, index_of(t, "trigrams"), "eau")).groupBy("source_file").agg(F.count("*").alias("n")), "SELECT source_file, sum((text ILIKE '%grant%')::INT + (text ILIKE '%eau%')::INT)::BIGINT AS n FROM v_chunks GROUP BY 1 HAVING n > 0", "chunks")
query("S19_list_documents", lambda t: S.list_documents(t.registry).select("id", "source_file", "document_type"), "SELECT id, source_file, document_type FROM v_registry", "registry")

types = lambda t: t.profiles.groupBy(F.col("document_type").alias("name")).agg(F.count("*").alias("n"), F.bool_or(F.col("document_type") != "memo").alias("active")).withColumn("display_name", F.initcap(F.translate("name", "_", " ")))
query("S19_list_types", lambda t: S.list_types(types(t)).select("name", "n"), "SELECT document_type AS name, count(*) AS n FROM v_profiles WHERE document_type <> 'memo' GROUP BY 1", "profiles")

# Streams ------------------------------------------------------------------------------------------------------------


def stream(t, name: str):
    """The files of a base table as a stream."""
    return t.spark.readStream.schema(t[name].schema).parquet(f"{t.sf_dir}/{name}.parquet*")


def places(t) -> tuple[str, str]:
    """Fresh folders for a checkpoint and for results, where the cluster shares them."""
    base = scratch_path(t.spark, "stream")
    return f"{base}/state", f"{base}/out"


def stream_elements(t):
    state, out = places(t)
    parts = F.split("text", "\n")
    files = stream(t, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"), F.size(parts).alias("n"), "text")
    lines = files.select("source_file", "n", F.posexplode(parts).alias("elem_idx", "text"))  # lines are counted per file, not per line
    kind = F.when(F.length("text") < 60, "Title").when(F.col("elem_idx") % 7 == 6, "Table").otherwise("NarrativeText")
    lines = lines.withColumns({"page_number": F.floor(F.col("elem_idx") / 20).cast("int") + 1, "element_type": kind, "last": F.col("elem_idx") == F.col("n") - 1})
    jobs.stream_new_elements(lines, state, out, t.profiles).awaitTermination()
    chunks = jobs.new_chunks(t.spark, out)
    return chunks.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("content_type") == "header").alias("headers"), F.max("total_chunks").alias("total"), F.max("document_type").alias("document_type"))


def stream_performance(t):
    state, out = places(t)
    rows = stream(t, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("good"))
    jobs.stream_chunk_performance(rows, state, out).awaitTermination()
    return jobs.performance_so_far(t.spark, out)


def stream_cost(t):
    state, out = places(t)
    zero = F.lit(0)
    rows = stream(t, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("call_site"), F.lit("model-a").alias("model"), (F.col("event_id") % 4000).alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_read_tokens"), zero.alias("cache_write_tokens"))
    jobs.stream_usage_cost(rows, state, out).awaitTermination()
    return jobs.usage_by_day(t.spark, out)


query(
    "T1_stream_new_elements", stream_elements,
    f"+ RECURSIVE {SECTIONS} SELECT c.source_file, count(*) AS n, count(*) FILTER (WHERE c.element_type IN ('Title', 'Header')) AS headers, count(*) AS total, any_value(p.document_type) AS document_type FROM chunked c JOIN v_profiles p ON p.source_file = c.source_file GROUP BY 1", "elements", "profiles",
)
query("T2_stream_chunk_performance", stream_performance, *M4)
query("T3_stream_usage_cost", stream_cost, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type AS call_site, count(*) AS calls, sum(((event_id % 4000) * 3 / 1e6)::DECIMAL(12,6))::DOUBLE AS cost FROM events GROUP BY ALL")
