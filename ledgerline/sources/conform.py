"""Public-records views over the star-schema tables, one SQL text per view in the subset that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

#: Clocks of the views: order-based ones, and boards.
AS_OF, BOARDS_AS_OF = "2001-08-01", "2026-06-01"


def _dept(k: str, x: str) -> str:
    return f"CASE {k} % 3 WHEN 0 THEN 'Bureau of ' || {x} WHEN 1 THEN 'Department of ' || {x} ELSE {x} END"


_unit = _dept("event_id", "'Unit ' || CAST(user_id % 25 AS STRING)")
_period = "CAST(2020 + event_id % 5 AS INT) AS year, 'Q' || CAST(1 + user_id % 4 AS STRING) AS quarter"
_number = lambda n: f"CAST(o_orderkey % {n} AS STRING) || '-' || CAST(year(o_orderdate) AS STRING)"
_rn = _number(10000)

VIEWS = {
    "expenditures": f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_dept("l_orderkey", "n_name")} AS department, CAST(l_partkey AS STRING) AS account_number,
  CASE WHEN l_linenumber = 7 THEN 'Sub TOTAL' WHEN l_orderkey % 97 = 0 THEN NULL ELSE 'Item ' || CAST(l_partkey % 50 AS STRING) END AS line_item,
  CAST(l_extendedprice AS DECIMAL(15,2)) AS revised_budget, CAST(l_quantity * 1000 AS DECIMAL(15,2)) AS ytd_expended,
  'Q' || CAST(quarter(l_shipdate) AS STRING) AS quarter, CAST(year(l_shipdate) AS INT) AS year
  FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "grants": f"""SELECT o_orderkey AS id, {_dept("o_orderkey", "n_name")} AS department,
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'GRANT  ' || CAST(o_custkey % 60 AS STRING) ELSE 'Grant ' || CAST(o_custkey % 60 AS STRING) END AS grant_name,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'G-' || CAST(o_orderkey % 500 AS STRING) END AS grant_number,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS amount,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS end_date,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'Active' ELSE 'pending' END AS status, 'report_' || CAST(o_custkey % 50 AS STRING) || '.pdf' AS source_file
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "registry": f"""SELECT o_orderkey AS id, 'Reports - ' || CAST(year(o_orderdate) AS STRING) || ' - file_' || CAST(o_orderkey AS STRING) || '.pdf' AS source_file,
  {_dept("o_orderkey", "n_name")} AS department,
  CASE o_orderkey % 5 WHEN 0 THEN 'resolution' WHEN 1 THEN 'budget' WHEN 2 THEN 'unclassified' ELSE 'quarterly_report' END AS document_type,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Q' || CAST(quarter(o_orderdate) AS STRING) END AS quarter, CAST(year(o_orderdate) AS INT) AS year,
  CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'ocr' ELSE 'vision' END AS parser_used, CAST(o_orderkey % 40 AS INT) AS total_chunks, o_orderdate AS ingested_at
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "resolutions": f"""SELECT o_orderkey AS id, {_rn} AS resolution_number,
  CASE o_custkey % 6 WHEN 0 THEN 'Land development plan at lot ' || CAST(o_custkey AS STRING) WHEN 1 THEN 'Grant application for parks' WHEN 2 THEN 'Professional services agreement'
    WHEN 3 THEN 'Budget transfer between funds' WHEN 4 THEN 'Reappointing a member of the board' ELSE 'Honoring retired staff' END AS title,
  CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Vendor ' || CAST(o_custkey % 20 AS STRING) || ', LLC' ELSE 'Vendor ' || CAST(o_custkey % 20 AS STRING) || ' llc' END AS vendor,
  {_dept("o_orderkey", "n_name")} AS department, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS adopted_date,
  CASE o_orderstatus WHEN 'F' THEN 'Passed' WHEN 'O' THEN 'Tabled' ELSE 'Introduced' END AS status, 'res_' || CAST(o_orderkey AS STRING) || '.pdf' AS source_file
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "votes": f"""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 70 = 0 THEN NULL ELSE {_rn} END AS resolution_number, 'Member ' || CAST(l_suppkey % 9 AS STRING) AS council_member,
  CASE l_returnflag WHEN 'A' THEN 'Yea' WHEN 'N' THEN ' NAYS' ELSE 'abstained' END AS vote, 'res_' || CAST(l_orderkey AS STRING) || '.pdf' AS source_file
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "legislation": f"""SELECT o_orderkey AS id, {_rn} AS bill_number, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, CAST(o_orderdate AS DATE) AS adopted_date,
  CASE o_orderstatus WHEN 'F' THEN 'Signed' WHEN 'O' THEN 'Introduced' ELSE 'Vetoed' END AS status FROM {{orders}}""",
    "meetings": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 70 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS meeting_date,
  CASE WHEN o_orderkey % 4 = 3 THEN 'special' ELSE 'regular' END AS session_type, CAST(5 + o_orderkey % 3 AS INT) AS members_present, 'min_' || CAST(o_orderkey AS STRING) || '.pdf' AS source_file
  FROM {orders}""",
    "meeting_actions": f"""SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS line, l_partkey AS part, CASE WHEN o_orderkey % 70 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS meeting_date,
  CASE o_orderstatus WHEN 'F' THEN 'resolution' ELSE 'ordinance' END AS item_type, {_rn} AS item_number, 'min_' || CAST(l_orderkey AS STRING) || '.pdf' AS source_file
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "appropriations": "SELECT p_partkey AS id, 'Department of ' || p_type AS department, CAST(2024 + p_partkey % 3 AS INT) AS fiscal_year, p_brand AS fund, CAST(p_retailprice AS DECIMAL(15,2)) AS amount FROM {part}",
    "vacancies": f"""SELECT event_id AS id, {_unit} AS department, CASE WHEN event_id % 17 = 0 THEN 'none' WHEN event_id % 2 = 0 THEN 'Role ' || CAST(event_id % 12 AS STRING) ELSE ' ROLE ' || CAST(event_id % 12 AS STRING) END AS position_title,
  CASE event_type WHEN 'error' THEN 'filled' WHEN 'view' THEN 'Open' ELSE 'open' END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 9 AS INT) END AS open_count, {_period},
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'report_' || CAST(user_id % 50 AS STRING) || '.pdf' END AS source_file, 'c' || CAST(user_id AS STRING) AS source_chunk_id FROM {{events}}""",
    "goals": f"""SELECT event_id AS id, {_unit} AS department, CASE WHEN event_id % 2 = 0 THEN 'Goal  ' || CAST(event_id % 15 AS STRING) ELSE 'goal ' || CAST(event_id % 15 AS STRING) END AS goal_title,
  CASE WHEN event_id % 4 = 0 THEN '65%' ELSE '' END AS target, CASE WHEN event_id % 15 = 7 THEN NULL WHEN event_type = 'purchase' THEN 'Completed' WHEN event_type = 'view' THEN 'under way' ELSE NULL END AS status,
  CASE WHEN event_id % 29 = 0 AND event_id % 15 <> 7 THEN 'completed' ELSE NULL END AS user_status, {_period} FROM {{events}}""",
    "metrics": """SELECT event_id AS id, n_name AS department, event_type AS metric_name, CAST(value AS DECIMAL(15,2)) AS metric_value, CAST(2020 + event_id % 5 AS INT) AS year,
  'Q' || CAST(1 + event_id % 4 AS STRING) AS quarter FROM {events} JOIN {nation} ON user_id % 25 = n_nationkey""",
    "projects": f"""SELECT event_id AS id, {_unit} AS department, 'Project ' || CAST(event_id % 30 AS STRING) AS project_name, left(props, CAST(event_id % 10 AS INT)) AS description, {_period} FROM {{events}} WHERE event_type = 'signup'""",
    "boards": """SELECT 'Board ' || n_name AS board_name, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE CAST(40 + n_nationkey AS INT) END AS total_seats, CAST(2025 + n_nationkey % 2 AS INT) AS roster_year FROM {nation}""",
    "board_members": """SELECT 'Board ' || n_name AS board_name, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_name END AS member_name, DATE '2026-01-01' + CAST(c_custkey % 1500 AS INT) AS term_expiration_date,
  CAST(2025 + n_nationkey % 2 AS INT) AS roster_year FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "llm_usage": """SELECT event_id AS id, ts AS timestamp, event_type AS call_site, CASE user_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-x' END AS model, CAST(event_id % 4000 AS INT) AS input_tokens,
  CAST(user_id * 10 AS INT) AS output_tokens, CAST(event_id % 7 AS INT) AS cache_write_tokens, CAST(event_id % 11 AS INT) AS cache_read_tokens FROM {events}""",
    "judgements": "SELECT event_id AS seq, user_id AS chunk_id, event_type <> 'error' AS good, ts FROM {events}",
    "review_flags": """SELECT event_id AS id, 'file_' || CAST(user_id AS STRING) AS source_file, CASE event_type WHEN 'error' THEN 'parse' WHEN 'view' THEN 'classify' ELSE 'validate' END AS stage,
  event_id % 4 = 0 AS resolved, ts AS created_at FROM {events}""",
    "query_scores": """SELECT doc_id AS query_id, CAST(1 + 3 * quality + doc_id % 2 AS DECIMAL(3,2)) AS retrieval, CAST(5 - 3 * toxic AS DECIMAL(3,2)) AS accuracy, CAST(1 + doc_id % 5 AS DECIMAL(3,2)) AS completeness,
  CASE doc_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'sql' ELSE NULL END AS store, DATE '2026-06-01' - CAST(doc_id % 200 AS INT) AS asked, 'run' || CAST(doc_id % 4 AS STRING) AS run_id FROM {labels}""",
    "profiles": """SELECT 'doc_' || CAST(doc_id AS STRING) || '.pdf' AS source_file, doc_id, CASE doc_id % 6 WHEN 0 THEN 'quarterly_report' WHEN 1 THEN 'resolution' WHEN 2 THEN 'minutes' WHEN 3 THEN 'budget' WHEN 4 THEN 'unclassified' ELSE 'memo' END AS document_type,
  lang AS department, CASE WHEN doc_id % 2 = 0 THEN 'q2 2026' ELSE '2025' END AS period, CASE WHEN doc_id % 3 = 0 THEN 'Adopted Budget 2026' ELSE 'Other paper' END AS title, CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence FROM {documents}""",
    "chunks": """SELECT CAST(doc_id AS STRING) AS chunk_id, text, lang AS department, source AS source_file, embedding, label FROM {documents} JOIN {embeddings} ON doc_id = vec_id""",
    "requests": "SELECT CAST(vec_id AS STRING) AS query_id, embedding, label FROM {embeddings} WHERE vec_id % 25 = 0",
    "persons": "SELECT s_name AS name, s_suppkey AS seq, n_name AS department, CASE s_suppkey % 3 WHEN 0 THEN 'DIRECTS' WHEN 1 THEN 'MANAGES' ELSE 'REPORTS_TO' END AS rel FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
}

#: Votes and resolutions with the numbers that FIXTURES.md states: more rows share one.
VIEWS |= {f"fixture_{v}": VIEWS[v].replace(_rn, _number(400)) for v in ("votes", "resolutions")}

#: Lines of documents as elements; the two engines number array entries in their own ways.
ELEMENTS = {
    "spark": "SELECT doc_id, idx AS elem_idx, line AS text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS idx, line",
    "duckdb": "SELECT doc_id, idx - 1 AS elem_idx, parts[idx] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS idx FROM {documents})",
}
_elements = """SELECT 'doc_' || CAST(doc_id AS STRING) || '.pdf' AS source_file, CAST(elem_idx AS INT) AS elem_idx, CAST(1 + floor(elem_idx / 20) AS INT) AS page_number,
  CASE WHEN length(text) < 60 THEN 'Title' WHEN elem_idx % 7 = 6 THEN 'Table' ELSE 'NarrativeText' END AS element_type, text FROM ({lines}) x WHERE text IS NOT NULL"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A conformed view, or a base table, of the tables in sf_dir."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _elements.replace("{lines}", ELEMENTS["spark"]) if name == "elements" else VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


class Tables:
    """Views by attribute or key, read when they are first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = view(self.spark, self.sf_dir, name)
        return self._seen[name]

    __getattr__ = __getitem__


def duckdb_view(name: str) -> str:
    """The DuckDB text of a view, over tables of the same names as the base tables."""
    text = _elements.replace("{lines}", ELEMENTS["duckdb"]) if name == "elements" else VIEWS[name]
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_views(sql: str, *names: str) -> str:
    """sql with the named views in front, as common table expressions named v_<view>."""
    recursive = sql.lstrip().startswith("+ RECURSIVE ")
    sql = sql.lstrip().replace("+ RECURSIVE ", "+ ", 1) if recursive else sql
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"v_{n} AS ({duckdb_view(n)})" for n in names) + ("," if sql.lstrip().startswith("+") else "") + " " + sql.lstrip().removeprefix("+")
