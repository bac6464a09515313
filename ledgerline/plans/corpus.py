"""Queries of corpus preparation: text rules, gates, chunking, requests and responses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import corpus as C

from .registry import dk, label, nt, pk, query

YEAR = 2026

# Text rules over elements and documents -----------------------------------------------------------------------------

GARBLED = "coalesce(length(regexp_replace(text, '[\\x00-\\x7F\\x{2000}-\\x{206F}]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0)"
SOLID = "regexp_replace(text, '\\s', '', 'g')"
NUMERIC = f"coalesce((length({SOLID}) - length(regexp_replace({SOLID}, '[0-9,$%.]', '', 'g')))::DOUBLE / nullif(length({SOLID}), 0), 0)"
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
READ = f"coalesce(least(1.0::DOUBLE, len(list_filter({WORDS}, lambda w: w IN ({STOPS}))) * 3 / nullif(len({WORDS}), 0)) * 0.8::DOUBLE + len(list_filter({WORDS}, lambda w: length(w) BETWEEN 2 AND 15 AND regexp_matches(w, '[aeiou]'))) / nullif(len({WORDS}), 0) * 0.2::DOUBLE, 0)"
PAGES = "SELECT source_file, page_number, string_agg(text, chr(10) || chr(10) ORDER BY elem_idx) AS text FROM v_elements GROUP BY ALL"


def pages(t):
    return t.elements.groupBy("source_file", "page_number").agg(C.joined_in_order("text", "elem_idx", "\n\n").alias("text"))


KIND = f"""SELECT source_file, CASE WHEN density < 100 OR garbled > 0.10 THEN 'complex_pdf' ELSE 'clean_text_pdf' END AS kind
  FROM (SELECT source_file, avg(length(text)) FILTER (WHERE page_number <= 5) AS density, max({GARBLED}) FILTER (WHERE page_number = 1) AS garbled FROM ({PAGES}) GROUP BY 1)"""
query("P1_page_kind", lambda t: C.page_kind(pages(t)), KIND, "elements")
query("P2_garbled_ratio", lambda t: t.documents.select("doc_id", F.bround(T.garbled_ratio(F.col("text")), 6).alias("ratio")), f"SELECT doc_id, round_even({GARBLED}, 6) AS ratio FROM documents")
OCR = f"SELECT source_file, sum(length(text)) / count(*) >= 150 AND coalesce(sum({GARBLED} * length(text)) / nullif(sum(length(text)), 0), 0) < 0.10 AS ok FROM ({PAGES}) GROUP BY 1"
query("P3_ocr_quality_ok", lambda t: C.ocr_quality(pages(t)), OCR, "elements")
SPARSE = "SELECT source_file, coalesce(sum(length(text)), 0) < 200 AS sparse FROM v_elements GROUP BY 1"
query("P4_sparse_parse", lambda t: C.sparse_parse(t.elements), SPARSE, "elements")
query("P5_readability", lambda t: t.documents.select("doc_id", F.bround(T.readability(F.col("text")), 6).alias("score")), f"SELECT doc_id, round_even({READ}, 6) AS score FROM documents")
query("P6_is_garbled", lambda t: t.documents.select("doc_id", T.is_garbled(F.col("text")).alias("garbled")), f"SELECT doc_id, {READ} < 0.35 AS garbled FROM documents")


def routed(t):
    text = t.documents.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"), T.is_garbled(F.col("text")).alias("garbled"))
    files = C.page_kind(pages(t)).join(C.ocr_quality(pages(t)).withColumnRenamed("ok", "ocr_ok"), "source_file").join(C.sparse_parse(t.elements), "source_file").join(text, "source_file")
    return C.parser_route(files).select("source_file", "kind", "next_reader")


query(
    "P7_parser_route", routed,
    f"""SELECT k.source_file, k.kind, CASE WHEN d.garbled THEN 'vision' WHEN k.kind = 'complex_pdf' THEN CASE WHEN o.ok THEN 'ocr' ELSE 'vision' END WHEN s.sparse THEN 'vision' ELSE 'text' END AS next_reader
  FROM ({KIND}) k JOIN ({OCR}) o USING (source_file) JOIN ({SPARSE}) s USING (source_file) JOIN (SELECT 'doc_' || doc_id || '.pdf' AS source_file, {READ} < 0.35 AS garbled FROM documents) d USING (source_file)""", "elements",
)
query(
    "P8_split_blocks", lambda t: C.split_blocks(pages(t)).groupBy("source_file").agg(F.count("*").alias("n"), F.max("elem_idx").cast("long").alias("last"), F.sum(F.length("text")).alias("chars")),
    "SELECT source_file, count(*) AS n, count(*) - 1 AS last, sum(length(trim(text)))::BIGINT AS chars FROM v_elements WHERE trim(text) <> '' GROUP BY 1", "elements",
)


def raw_elements(t):
    kind = F.when(F.col("elem_idx") % 11 == 10, "PageBreak").when(F.col("elem_idx") % 5 == 0, "Odd").otherwise(F.col("element_type"))
    return t.elements.select("source_file", "elem_idx", F.when(F.col("elem_idx") % 3 == 0, F.col("page_number")).alias("page_number"), kind.alias("element_type"), F.when(F.col("elem_idx") % 13 == 5, " ").otherwise(F.col("text")).alias("text"))


query(
    "P9_element_clean", lambda t: C.element_clean(raw_elements(t)).select("source_file", "elem_idx", "page_number", "element_type"),
    """SELECT source_file, elem_idx, page_number, element_type FROM (SELECT source_file, elem_idx, CASE WHEN elem_idx % 3 = 0 THEN page_number ELSE (count(*) FILTER (WHERE elem_idx % 11 = 10) OVER (PARTITION BY source_file ORDER BY elem_idx ROWS UNBOUNDED PRECEDING) + 1)::INT END AS page_number,
  CASE WHEN elem_idx % 5 = 0 THEN 'NarrativeText' ELSE element_type END AS element_type, elem_idx % 11 = 10 AS pb, CASE WHEN elem_idx % 13 = 5 THEN ' ' ELSE text END AS text FROM v_elements) WHERE NOT pb AND trim(text) <> ''""", "elements",
)
query(
    "P10_people_elements",
    lambda t: C.people_elements(t.persons.groupBy(F.col("department").alias("source_file")).agg(F.array_sort(F.collect_list(F.struct("name", F.when(F.col("rel") == "DIRECTS", "Director").otherwise("").alias("title")))).alias("people")).withColumn("page_number", F.lit(1))).select("source_file", "text"),
    "SELECT department AS source_file, name || CASE WHEN rel = 'DIRECTS' THEN ' — Director' ELSE '' END AS text FROM v_persons", "persons",
)
W = {k: v.replace("\\", "\\") for k, v in T.CONTENT_WORDS.items()}
HAS = lambda k: f"regexp_matches(lower(text), '\\b({W[k]})\\b')"
RULE = f"""CASE WHEN element_type = 'Table' THEN 'table' WHEN element_type IN ('Title', 'Header') THEN 'header' WHEN element_type = 'OrgData' THEN 'org_data' WHEN {NUMERIC} > 0.6 THEN 'metrics' WHEN {HAS('budget')} AND {NUMERIC} > 0.15 THEN 'table'
  WHEN {HAS('org')} AND length(text) < 600 THEN 'org_data' WHEN {HAS('grant')} AND NOT {HAS('org')} THEN 'table' WHEN {HAS('vacancy')} THEN 'table' WHEN {HAS('project')} AND length(text) > 100 THEN 'project' WHEN {NUMERIC} < 0.05 AND length(text) > 150 THEN 'narrative' END"""
query("P11_content_rules", lambda t: t.elements.select("source_file", "elem_idx", T.content_rule(F.col("element_type"), F.col("text")).alias("content_type")), f"SELECT source_file, elem_idx, {RULE} AS content_type FROM v_elements", "elements")
query("P12_numeric_ratio", lambda t: t.documents.select("doc_id", F.bround(T.numeric_ratio(F.col("text")), 6).alias("ratio")), f"SELECT doc_id, round_even({NUMERIC}, 6) AS ratio FROM documents")


def labelled_chunks(t):
    return t.profiles.select("doc_id", "document_type", F.when(F.col("doc_id") % 4 == 0, " Narrative ").when(F.col("doc_id") % 4 == 1, "table").when(F.col("doc_id") % 4 == 2, "vote_record").otherwise("?").alias("content_type"))


def vocab_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN CASE WHEN c IN ({', '.join(repr(x) for x in v[0])}) THEN c ELSE '{v[0][0]}' END" for k, v in C.DOC_TYPES.items())
    return f"SELECT doc_id, document_type, CASE document_type {cases} ELSE 'narrative' END AS content_type FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'narrative' WHEN 1 THEN 'table' WHEN 2 THEN 'vote_record' ELSE '?' END AS c FROM v_profiles)"


query("P13_vocab_check", lambda t: C.vocab_check(labelled_chunks(t), C.doc_types(t.spark)), vocab_sql(), "profiles")
query(
    "P14_store_routing", lambda t: C.store_routing(labelled_chunks(t).withColumn("content_type", F.lower(F.trim("content_type")))).select("doc_id", "to_vector", "to_sql", "to_graph"),
    "SELECT doc_id, doc_id % 4 IN (0, 1) AS to_vector, doc_id % 4 = 1 AS to_sql, doc_id % 4 = 1 AS to_graph FROM v_profiles", "profiles",
)


def file_names(t):
    dept, q, year = F.translate("department", "_", " "), F.concat(F.lit("Q"), F.col("quarter").substr(2, 1)), F.col("year").cast("string")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Misc. Documents - Quarterly Reports - "), year, F.lit(" - "), dept, F.lit("_"), q, F.lit(" 2024.pdf")))
    return t.registry.where("quarter <> ''").select("id", name.when(F.col("id") % 3 == 1, F.concat(F.lit("Notes "), dept, F.lit("_"), q, F.lit(" 2025 final.pdf"))).otherwise("").alias("name"))


META = """+ n AS (SELECT id, replace(department, '_', ' ') AS d, quarter AS q, CASE id % 3 WHEN 0 THEN 'Misc. Documents - Quarterly Reports - ' || year || ' - ' || replace(department, '_', ' ') || '_' || quarter || ' 2024.pdf' WHEN 1 THEN 'Notes ' || replace(department, '_', ' ') || '_' || quarter || ' 2025 final.pdf' ELSE '' END AS name FROM v_registry WHERE quarter <> '')
SELECT id, CASE id % 3 WHEN 0 THEN d WHEN 1 THEN 'Notes ' || d ELSE 'Unknown Department' END AS department, CASE WHEN id % 3 = 2 THEN 'Q?' ELSE q END AS quarter, CASE id % 3 WHEN 0 THEN 2024 WHEN 1 THEN 2025 ELSE 2026 END AS year FROM n"""
query("P15_filename_meta", lambda t: file_names(t).select("id", *(c.alias(k) for k, c in T.filename_meta(F.col("name"), YEAR).items())), META, "registry")
query("P16_split_period", lambda t: t.profiles.select("doc_id", *(c.alias(k) for k, c in T.split_period(F.col("period")).items())), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Q2' ELSE '' END AS quarter, CASE WHEN doc_id % 2 = 0 THEN 2026 ELSE 2025 END AS year FROM v_profiles", "profiles")
query(
    "P17_snapshot_year", lambda t: C.snapshot_year(t.boards.select("board_name", F.lit("Boards 2024 list.pdf").alias("source_file"), F.when(F.col("roster_year") == 2025, 2025).alias("roster_year"))).select("board_name", "roster_year"),
    "SELECT board_name, CASE WHEN roster_year = 2025 THEN 2025 ELSE 2024 END AS roster_year FROM v_boards", "boards",
)
query(
    "P18_chunk_metadata", lambda t: C.chunk_metadata(t.elements.select("source_file", F.col("elem_idx").alias("seq"), "text"), t.profiles.where("doc_id % 3 <> 0")).select("source_file", "chunk_index", "total_chunks", "document_type", "department", "quarter", "year"),
    """SELECT e.source_file, row_number() OVER (PARTITION BY e.source_file ORDER BY elem_idx) - 1 AS chunk_index, count(*) OVER (PARTITION BY e.source_file) AS total_chunks, coalesce(p.document_type, 'unclassified') AS document_type, coalesce(p.department, 'Unknown Department') AS department,
  CASE WHEN p.doc_id IS NULL THEN NULL WHEN p.doc_id % 2 = 0 THEN 'Q2' ELSE '' END AS quarter, CASE WHEN p.doc_id % 2 = 0 THEN 2026 WHEN p.doc_id % 2 = 1 THEN 2025 END AS year FROM v_elements e LEFT JOIN (SELECT * FROM v_profiles WHERE doc_id % 3 <> 0) p ON p.source_file = e.source_file""", "elements", "profiles",
)
query(
    "P19_quarantine", lambda t: C.quarantine(t.profiles, C.doc_types(t.spark)).select("doc_id", "reason", "quarantined"),
    "SELECT doc_id, r AS reason, r IS NOT NULL AS quarantined FROM (SELECT doc_id, CASE WHEN document_type = 'unclassified' THEN 'unclassified' WHEN document_type = 'memo' THEN 'unregistered type' WHEN confidence < 0.55 THEN 'low confidence' END AS r FROM v_profiles)", "profiles",
)
query("P20_excerpt", lambda t: C.excerpt(t.elements).select("source_file", F.length("excerpt").cast("long").alias("n"), F.md5("excerpt").alias("digest")), "SELECT source_file, length(x) AS n, md5(x) AS digest FROM (SELECT source_file, left(string_agg(text, chr(10) ORDER BY elem_idx), 8000) AS x FROM v_elements WHERE page_number <= 3 GROUP BY 1)", "elements")
ids = lambda: F.create_map(F.lit("number"), F.array(F.col("doc_id").cast("string"), F.lit("")), F.lit("none"), F.array().cast("array<string>"), F.lit("file"), F.array("source_file"))
query("P21_coerce_ids", lambda t: t.profiles.select("doc_id", F.to_json(C.coerce_ids(ids())).alias("ids")), "SELECT doc_id, '{\"number\":\"' || doc_id || '\",\"file\":\"' || source_file || '\"}' AS ids FROM v_profiles", "profiles")
query("P22_annual_budget_gate", lambda t: C.annual_budget_gate(t.profiles).select("doc_id", "document_type"), "SELECT doc_id, document_type FROM v_profiles WHERE document_type <> 'budget' OR title = 'Adopted Budget 2026'", "profiles")
dates = lambda: F.when(F.col("id") % 4 == 0, F.col("adopted_date").cast("string")).when(F.col("id") % 4 == 1, "2026").when(F.col("id") % 4 == 2, "").otherwise("2026-02-30")
query("P23_garbage_dates", lambda t: t.legislation.withColumn("d", dates()).select("id", T.strict_date(F.col("d")).alias("date")), "SELECT id, CASE WHEN id % 4 = 0 THEN adopted_date::VARCHAR END AS date FROM v_legislation", "legislation")
query(
    "P24_person_name", lambda t: t.persons.select("seq", T.person_name(F.concat(F.lit("Hon. Council Member  "), F.lower("name"), F.lit(" o'brien"))).alias("name")),
    "SELECT seq, 'Supplier' || substr(name, 9) || ' O''Brien' AS name FROM v_persons", "persons",
)
query(
    "P25_clip_and_sanitize", lambda t: C.clip(t.grants.select("id", F.repeat("department", 20).alias("department"), F.repeat("status", 20).alias("status"))).withColumn("vote", T.clean_vote(F.concat(F.lit("  "), F.col("status"), F.lit(" ")))),
    "SELECT id, left(repeat(department, 20), 100) AS department, left(repeat(status, 20), 50) AS status, left(trim(left(repeat(status, 20), 50)), 50) AS vote FROM v_grants", "grants",
)
query("P26_vote_bucket", lambda t: t.votes.groupBy(T.vote_bucket(F.col("vote")).alias("bucket")).agg(F.count("*").alias("n")), "SELECT CASE vote WHEN 'Yea' THEN 'yea' WHEN ' NAYS' THEN 'nay' ELSE 'abstain' END AS bucket, count(*) AS n FROM v_votes GROUP BY 1", "votes")
query("P27_quarter_start", lambda t: t.registry.select("id", T.quarter_start(F.col("year"), F.col("quarter")).alias("start")), "SELECT id, make_date(year, CASE quarter WHEN 'Q2' THEN 4 WHEN 'Q3' THEN 7 WHEN 'Q4' THEN 10 ELSE 1 END, 1)::VARCHAR AS start FROM v_registry", "registry")
query("P28_dept_key", lambda t: t.grants.select("id", T.dept_key(F.col("department")).alias("key")), f"SELECT id, {dk('department')} AS key FROM v_grants", "grants")
query("P29_dept_display", lambda t: t.grants.groupBy(T.dept_key(F.col("department")).alias("key")).agg(F.min_by("department", T.display_order(F.col("department"))).alias("department")), f"SELECT {dk('department')} AS key, {label()} AS department FROM v_grants GROUP BY 1", "grants")
PARTY = "trim(regexp_replace(regexp_replace(lower(vendor), '[,.]?\\s*\\b(llc|inc|co|corp)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
query("P30_norm_title_party", lambda t: t.resolutions.select("id", T.norm_title(F.col("title")).alias("title"), T.norm_party(F.col("vendor")).alias("party")), f"SELECT id, {nt('title')} AS title, {PARTY} AS party FROM v_resolutions", "resolutions")
query("P31_goal_status_class", lambda t: t.goals.select("id", T.goal_status(F.coalesce("user_status", "status")).alias("class")), "SELECT id, CASE WHEN user_status IS NOT NULL OR status = 'Completed' THEN 'completed' WHEN status IS NULL THEN 'none' ELSE 'in_progress' END AS class FROM v_goals", "goals")
query("P32_resolution_type", lambda t: t.resolutions.groupBy("title", T.resolution_type(F.col("title")).alias("type")).agg(F.count("*").alias("n")), "SELECT title, CASE WHEN title LIKE 'Land%' THEN 'land_development' WHEN title LIKE 'Grant%' THEN 'grant_action' WHEN title LIKE 'Prof%' THEN 'contract' WHEN title LIKE 'Budget%' THEN 'budget' WHEN title LIKE 'Reapp%' THEN 'appointment' ELSE 'other' END AS type, count(*) AS n FROM v_resolutions GROUP BY ALL", "resolutions")
query(
    "P33_status_norm", lambda t: t.grants.groupBy(T.grant_status(F.col("status")).alias("status")).agg(F.count("*").alias("n")).unionByName(t.resolutions.groupBy(T.resolution_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))),
    "SELECT CASE status WHEN 'closed' THEN 'Closed' WHEN 'pending' THEN 'Proposed' ELSE 'Active' END AS status, count(*) AS n FROM v_grants GROUP BY 1 UNION ALL SELECT CASE status WHEN 'Passed' THEN 'Active' WHEN 'Tabled' THEN 'Stalled' ELSE 'Proposed' END, count(*) FROM v_resolutions GROUP BY 1", "grants", "resolutions",
)
query("P34_period_label", lambda t: t.registry.groupBy(T.period_label(F.col("year"), F.col("quarter")).alias("label")).agg(F.count("*").alias("n")), "SELECT trim(quarter || ' ' || year) AS label, count(*) AS n FROM v_registry GROUP BY 1", "registry")

# Chunking -----------------------------------------------------------------------------------------------------------

summary = lambda d: d.select("source_file", "seq", "page_number", "section", "element_type", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))
DOMINANT = "CASE WHEN bool_or(element_type = 'Table') THEN 'Table' WHEN bool_or(element_type = 'OrgData') THEN 'OrgData' ELSE first(element_type ORDER BY elem_idx) END"
query(
    "C2_chunk_pages", lambda t: summary(C.chunk_pages(t.elements)),
    f"""SELECT source_file, page_number AS seq, page_number, coalesce(head, 'Page ' || page_number) AS section, element_type, length(x) AS n, md5(x) AS digest FROM (SELECT source_file, page_number, trim(string_agg(text, chr(10) || chr(10) ORDER BY elem_idx)) AS x,
  first(left(text, 80) ORDER BY elem_idx) FILTER (WHERE element_type IN ('Title', 'Header')) AS head, {DOMINANT} AS element_type FROM v_elements GROUP BY ALL) WHERE length(x) >= 100""", "elements",
)
MARKS = ["th", "er"]


def together(first: str, last: str, where: str = "true") -> str:
    """C3 in SQL: common table expressions that end in `kept`."""
    return f"""m AS (SELECT *, starts_with(ltrim(lower(left(text, 60))), '{first}') AS o, starts_with(ltrim(lower(left(text, 60))), '{last}') AS c FROM v_elements WHERE {where}),
cuts AS (SELECT *, coalesce(o AND max(CASE WHEN c THEN elem_idx END) OVER w > coalesce(max(CASE WHEN o THEN elem_idx END) OVER w, -1), false)::INT AS cut FROM m WINDOW w AS (PARTITION BY source_file ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
seqs AS (SELECT *, sum(cut) OVER (PARTITION BY source_file ORDER BY elem_idx ROWS UNBOUNDED PRECEDING)::INT AS seq FROM cuts),
kept AS (SELECT source_file, seq, page_number, section, element_type, x AS text FROM (SELECT source_file, seq, first(page_number ORDER BY elem_idx) AS page_number, left(trim(first(text ORDER BY elem_idx)), 80) AS section, {DOMINANT} AS element_type, string_agg(text, chr(10) || chr(10) ORDER BY elem_idx) AS x FROM seqs GROUP BY ALL) WHERE length(x) >= 100)"""


SUMMARY = "SELECT source_file, seq, page_number, section, element_type, length(text) AS n, md5(text) AS digest"
query("C3_chunk_keep_together", lambda t: summary(C.chunk_keep_together(t.elements, MARKS)), f"+ {together('th', 'er')} {SUMMARY} FROM kept", "elements")
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
NN, SEP = "chr(10) || chr(10)", "chr(1)"
LAST = f"string_split(a, {SEP})[-1]"
LONGER = STRIP(f"CASE WHEN {LAST} = '' THEN p ELSE {LAST} || {NN} || p END")
# a text as pieces joined by a control character, folded over its paragraphs
PACK = f"""list_reduce(list_prepend('', string_split(text, {NN})), lambda a, p: CASE WHEN {LAST} <> '' AND length({LONGER}) > 1500 THEN a || {SEP} || CASE WHEN length({LAST}) > 100 THEN right({LAST}, 100) || {NN} || p ELSE p END
  ELSE left(a, length(a) - length({LAST})) || {LONGER} END)"""
PACKED = f"CASE WHEN length(text) <= 1500 OR element_type = 'Table' THEN text ELSE {PACK} END"
LED = STRIP(f"CASE WHEN lead = '' THEN body ELSE lead || {NN} || body END")
# each step of the recursion goes from every file's k-th block to its next
SECTIONS = f"""e AS (SELECT *, element_type IN ('Title', 'Header') OR (length(text) < 120 AND regexp_matches(text, '(?i)\\b({T.SECTION_WORDS})\\b')) AS st FROM v_elements),
f AS (SELECT *, element_type = 'Table' AND NOT st AS alone FROM e),
g AS (SELECT *, (st OR alone OR coalesce(lag(alone) OVER (PARTITION BY source_file ORDER BY elem_idx), false))::INT AS cut FROM f),
h AS (SELECT *, sum(cut) OVER w AS block, coalesce(last_value(CASE WHEN st THEN left({STRIP('text')}, 80) END IGNORE NULLS) OVER w, 'Introduction') AS sec FROM g WINDOW w AS (PARTITION BY source_file ORDER BY elem_idx ROWS UNBOUNDED PRECEDING)),
i AS (SELECT source_file, block, first(sec ORDER BY elem_idx) AS section, bool_or(alone) AS alone, first(page_number ORDER BY elem_idx) AS page_number, {DOMINANT} AS element_type, string_agg(text, {NN} ORDER BY elem_idx) AS body FROM h GROUP BY ALL),
j AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY block) AS k FROM i),
r AS (SELECT source_file, 1::BIGINT AS k, '' AS lead FROM j WHERE k = 1 UNION ALL
  SELECT source_file, k + 1, CASE WHEN alone THEN lead WHEN length(text) < 100 THEN '' WHEN length(last) > 100 THEN right(last, 100) ELSE '' END FROM
  (SELECT *, string_split({PACKED}, {SEP})[-1] AS last FROM (SELECT j.source_file, j.k, j.alone, j.element_type, r.lead, {LED} AS text FROM r JOIN j ON j.source_file = r.source_file AND j.k = r.k))),
u AS (SELECT *, string_split({PACKED}, {SEP}) AS list FROM (SELECT j.source_file, j.k, j.page_number, j.section, j.element_type, CASE WHEN alone THEN {STRIP('body')} ELSE {LED} END AS text FROM r JOIN j ON j.source_file = r.source_file AND j.k = r.k) WHERE length(text) >= 100),
v AS (SELECT source_file, k, page_number, section, element_type, unnest(list) AS text, unnest(range(len(list))) AS pos, len(list) AS m FROM u),
chunked AS (SELECT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY k, pos) - 1)::INT AS seq, page_number, section, element_type, text FROM v WHERE length(text) >= 100 OR pos < m - 1)"""
query("C4_chunk_sections", lambda t: summary(C.chunk_sections(t.elements)), f"+ RECURSIVE {SECTIONS} {SUMMARY} FROM chunked", "elements")
RESOLUTION = "source_file IN (SELECT source_file FROM v_profiles WHERE document_type = 'resolution')"
query(
    "C1_chunk_mode", lambda t: C.chunk_all(t.elements, t.profiles, C.doc_types(t.spark)).groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    f"+ RECURSIVE {SECTIONS}, {together('whereas', 'resolved', RESOLUTION)} SELECT source_file, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT source_file, text FROM chunked WHERE NOT {RESOLUTION} UNION ALL SELECT source_file, text FROM kept) GROUP BY 1", "elements", "profiles",
)
query("C5_dominant_type", lambda t: t.elements.groupBy("source_file").agg(C.dominant().alias("element_type")), f"SELECT source_file, {DOMINANT} AS element_type FROM v_elements GROUP BY 1", "elements")

# Requests and responses ---------------------------------------------------------------------------------------------

chunks = lambda t: t.elements.select("source_file", F.col("elem_idx").alias("seq"), "text")
query(
    "X1_pack_fixed", lambda t: C.pack_fixed(chunks(t)).select("source_file", "batch_id", "n", F.md5("request").alias("digest")),
    """SELECT source_file, 'r' || report || '_b' || (b * 8)::BIGINT AS batch_id, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY elem_idx)) AS digest FROM (SELECT *, (row_number() OVER (PARTITION BY source_file ORDER BY elem_idx) - 1) // 8 AS b, dense_rank() OVER (ORDER BY source_file) AS report FROM v_elements) GROUP BY ALL""",
    "elements",
)
query(
    "X2_pack_char_budget", lambda t: C.pack_char_budget(chunks(t), 2000).groupBy("source_file").agg((F.max("batch") + 1).cast("long").alias("batches"), F.count("*").alias("n")),
    """+ e AS (SELECT source_file, length(text) AS n, row_number() OVER (PARTITION BY source_file ORDER BY elem_idx) AS k FROM v_elements),
x AS (SELECT source_file, list_reduce(list(struct_pack(b := 0::BIGINT, u := n::BIGINT) ORDER BY k), lambda a, c: CASE WHEN a.u > 0 AND a.u + c.u > 2000 THEN struct_pack(b := a.b + 1, u := c.u) ELSE struct_pack(b := a.b, u := a.u + c.u) END) AS r, count(*) AS n FROM e GROUP BY 1)
SELECT source_file, r.b + 1 AS batches, n FROM x""",
    "elements",
)
query("X3_slice_reports", lambda t: C.slice_reports(t.registry.select("id", "department", "year", "quarter", "source_file"), 20, 50), "SELECT id, department, year, quarter, source_file FROM v_registry ORDER BY department, year, quarter, source_file LIMIT 50 OFFSET 20", "registry")
query("X4_cost_estimate_batch", lambda t: C.cost_estimate(C.pack_fixed(chunks(t))), "SELECT count(*) AS requests, round_even(count(*) * ((3384 * 3.0::DOUBLE + 1559 * 15.0::DOUBLE) / 1e6 * 0.5), 4) AS cost FROM (SELECT DISTINCT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY elem_idx) - 1) // 8 AS b FROM v_elements)", "elements")
RAW = """SELECT 'r' || CAST(user_id % 20 AS STRING) AS report_id, event_id AS batch_id, CASE WHEN event_id % 7 = 0 THEN 'no json' ELSE 'Here: {{"metrics": [{{"metric_name": "' || event_type || '", "metric_value": ' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(event_id % 100 AS STRING) END || ', "confidence": "'
  || CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' ELSE 'low' END || '"}}]}} ok' END AS raw FROM {events}"""
parsed = lambda t: C.parse_response(t.spark.sql(RAW, events=t.events), "metrics", "metric_name: string, metric_value: double", ["metric_name", "metric_value"])
GOOD = "SELECT 'r' || (user_id % 20) AS report_id, event_id AS batch_id, event_type AS metric_name, (event_id % 100)::DOUBLE AS metric_value FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 2"
query("X5_parse_response", lambda t: parsed(t).select("report_id", "batch_id", "metric_name", "metric_value"), GOOD)
reports = lambda t: t.spark.range(20).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("report_id"), F.lit("Unit").alias("department"), F.lit("Q1").alias("quarter"), F.lit(2026).alias("year"))
query("X6_merge_parts", lambda t: C.merge_parts(parsed(t).withColumn("line_item", F.when(F.col("batch_id") % 2 == 0, " total x").otherwise("x")), reports(t)).drop("line_item"), f"SELECT DISTINCT report_id, metric_name, metric_value, 'Unit' AS department, 'Q1' AS quarter, 2026 AS year FROM ({GOOD}) WHERE batch_id % 2 <> 0")
query(
    "X7_dedup_projects", lambda t: C.dedup_projects(t.projects, ["department"]).select("id", "department", "project_name"),
    "SELECT id, department, project_name FROM (SELECT *, row_number() OVER (PARTITION BY department, lower(trim(project_name)) ORDER BY length(coalesce(description, '')) DESC, id) AS k FROM v_projects) WHERE k = 1", "projects",
)
rec = lambda t: t.profiles.select("source_file", "document_type", F.when(F.col("doc_id") % 6 == 1, "votes").otherwise("metrics").alias("target"), (F.col("doc_id") % 10).cast("string").alias("record"))
query("X8_merge_type_parts", lambda t: C.merge_type_parts(rec(t).unionByName(rec(t)), C.doc_types(t.spark)), "SELECT source_file, document_type, CASE WHEN doc_id % 6 = 1 THEN 'votes' ELSE 'metrics' END AS target, (doc_id % 10)::VARCHAR AS record FROM v_profiles WHERE document_type IN ('resolution', 'quarterly_report')", "profiles")


def anchored(t):
    rows = t.votes.select("id", "source_file", "resolution_number")
    want = t.resolutions.where("vendor is not null").select("source_file", F.col("resolution_number").alias("anchor_id"))
    return C.anchor_guard(rows.dropDuplicates(["source_file", "id"]), want, "resolution_number").groupBy("source_file").agg(F.count("*").alias("n"), F.min("id").alias("first"))


query(
    "X9_anchor_guard", anchored,
    "+ v AS (SELECT DISTINCT ON (source_file, id) * FROM v_votes), r AS (SELECT source_file, resolution_number FROM v_resolutions WHERE vendor IS NOT NULL) SELECT v.source_file, CASE WHEN any_value(r.source_file) IS NULL THEN count(*) ELSE 1 END AS n, min(v.id) AS first FROM v LEFT JOIN r ON r.source_file = v.source_file GROUP BY 1", "votes", "resolutions",
)
odd = lambda t: t.resolutions.withColumn("resolution_number", F.when(F.col("id") % 30 == 0, "1995-1995").when(F.col("id") % 50 == 0, "x").otherwise(F.col("resolution_number")))
# files of resolutions, some of which gave no row
files = lambda t: t.registry.where("document_type = 'resolution'").select(F.concat(F.when(F.col("quarter") == "", "lost_").otherwise("res_"), F.col("id").cast("string"), F.lit(".pdf")).alias("source_file"))
repeated = lambda t: t.votes.select("source_file", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("copy"))  # noqa: E731  each vote twice, some three times
problems = lambda t: C.validate_resolution(odd(t), repeated(t), files(t))
PROBLEMS = """SELECT source_file, CASE WHEN NOT regexp_matches(n, '^[0-9]{1,4}-[0-9]{4}$') THEN 'resolution_number ''' || n || ''' is not of the form N-YYYY' ELSE 'resolution_number ''' || n || ''' has sequence equal to year (impossible)' END AS problem FROM (SELECT source_file, CASE WHEN id % 30 = 0 THEN '1995-1995' WHEN id % 50 = 0 THEN 'x' ELSE resolution_number END AS n FROM v_resolutions)
  WHERE NOT regexp_matches(n, '^[0-9]{1,4}-[0-9]{4}$') OR split_part(n, '-', 1) = split_part(n, '-', 2)
UNION ALL SELECT source_file, 'implausible vote count: ' || n FROM (SELECT source_file, sum(CASE WHEN id % 3 = 0 THEN 3 ELSE 2 END)::BIGINT AS n FROM v_votes GROUP BY 1) WHERE n > 15
UNION ALL SELECT DISTINCT 'lost_' || id || '.pdf', 'no resolution row extracted' FROM v_registry WHERE document_type = 'resolution' AND quarter = ''"""
query("X10_validate_resolution", problems, PROBLEMS, "resolutions", "votes", "registry")
query("X11_withhold_invalid", lambda t: C.withhold_invalid(odd(t), problems(t))[1], f"SELECT source_file, string_agg(DISTINCT problem, '; ' ORDER BY problem) AS detail, 'validate' AS stage FROM ({PROBLEMS}) GROUP BY 1", "resolutions", "votes", "registry")
query(
    "X12_complete_batches_only", lambda t: C.complete_batches(parsed(t), t.spark.sql(RAW, events=t.events).groupBy("report_id").agg(F.count_distinct("batch_id").alias("n_batches"))),
    f"SELECT e.report_id, e.n AS n_batches, coalesce(g.n, 0) AS parsed, coalesce(g.n, 0) = e.n AS complete FROM (SELECT 'r' || (user_id % 20) AS report_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1) e LEFT JOIN (SELECT report_id, count(DISTINCT batch_id) AS n FROM ({GOOD}) GROUP BY 1) g ON g.report_id = e.report_id",
)
query(
    "X13_stamp_meeting_date", lambda t: C.stamp_meeting_date(t.meetings, t.meeting_actions.withColumn("meeting_date", F.when(F.col("line") % 2 == 0, F.col("meeting_date")))).select("id", "line", "part", "meeting_date"),
    "SELECT id, line, part, meeting_date::VARCHAR AS meeting_date FROM v_meeting_actions", "meeting_actions",
)
parts = lambda t: t.persons.select(F.col("department").alias("source_file"), F.when(F.col("seq") % 2 == 0, "person").otherwise("grant").alias("kind"), (F.col("seq") % 5).cast("string").alias("name"), "seq")
query("X14_merge_graph_parts", lambda t: C.merge_graph_parts(parts(t)), "SELECT department AS source_file, 'person' AS kind, (seq % 5)::VARCHAR AS name, min(seq) AS seq FROM v_persons WHERE seq % 2 = 0 GROUP BY ALL UNION ALL SELECT department, 'grant', (seq % 5)::VARCHAR, seq FROM v_persons WHERE seq % 2 = 1", "persons")


def typed(t):
    records = t.goals.select("id", F.col("department").alias("source_file"), F.create_map(F.lit("n"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")), F.lit("ok"), F.lit("true"), F.lit("d"), F.lit("2026-01-05")).alias("record"))
    return C.typed_from_specs(records, [("n", "INTEGER"), ("ok", "BOOLEAN"), ("d", "DATE"), ("none", "VARCHAR(20)")])


query("X15_typed_from_specs", typed, "SELECT department AS source_file, CASE WHEN id % 3 <> 0 THEN id::INT END AS n, true AS ok, '2026-01-05' AS d, NULL::VARCHAR AS none FROM v_goals", "goals")


def approved(t):
    p = t.review_flags.select("id", "stage", F.concat(F.lit("type_"), (F.col("id") % 700).cast("string")).alias("proposed_type"), F.lit("pending").alias("status"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("tables"))
    d = p.where("stage <> 'validate'").select("id", (F.col("stage") == "parse").alias("approve"), F.lit("note").alias("note"))
    reg = t.spark.createDataFrame([("type_200", ["old"], True), ("kept", ["k"], True)], "name string, sql_targets array<string>, active boolean")
    return C.approve_types(p.drop("stage"), d, reg)[1].select("name", F.array_join("sql_targets", ",").alias("targets"), "active").distinct()


query(
    "X16_approve_types", approved,
    "+ ok AS (SELECT DISTINCT 'type_' || (id % 700) AS name FROM v_review_flags WHERE stage = 'parse') SELECT name, 'a,b' AS targets, true AS active FROM ok UNION ALL SELECT 'kept', 'k', true UNION ALL SELECT 'type_200', 'old', true WHERE 'type_200' NOT IN (SELECT name FROM ok)", "review_flags",
)
query("X17_active_types", lambda t: C.active_types(t.profiles.select(F.col("document_type").alias("name"), (F.col("doc_id") % 2 == 0).alias("active")).distinct(), C.doc_types(t.spark)), "SELECT DISTINCT document_type AS name, true AS active FROM v_profiles WHERE doc_id % 2 = 0 AND document_type IN ('unclassified', 'memo')", "profiles")
