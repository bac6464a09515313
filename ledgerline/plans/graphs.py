"""Queries of the entity graph, and the node and edge tables they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import graph as G

from .registry import query


#: Whom a person reports to, by number.
BOSS_SEQ = "CASE WHEN seq % 80 >= 2 THEN seq - 2 WHEN CAST(floor(seq / 80) AS BIGINT) % 5 = 0 THEN seq + 78 END"


def all_edges(t) -> DataFrame:
    """People and their departments; people who report to the person two places before them, in chains of 40, some of which close to a cycle."""
    p = t.persons
    one = p.where("rel <> 'REPORTS_TO'").select(F.lit("Person").alias("src_label"), F.col("name").alias("src"), "rel", F.lit("Department").alias("dst_label"), F.col("department").alias("dst"))
    boss = p.select(F.col("name").alias("dst"), F.col("seq").alias("boss_seq"))
    asks = p.where("rel is not null").withColumn("boss_seq", F.expr(BOSS_SEQ))
    two = asks.join(boss, "boss_seq").select(F.lit("Person").alias("src_label"), F.col("name").alias("src"), F.lit("REPORTS_TO").alias("rel"), F.lit("Person").alias("dst_label"), "dst")
    return one.unionByName(two)


def all_nodes(t) -> DataFrame:
    p = t.persons
    return p.select(F.lit("Person").alias("label"), F.col("name").alias("key")).unionByName(p.select(F.lit("Department").alias("label"), F.col("department").alias("key")).distinct())


NODES = "(SELECT 'Person' AS label, name AS key FROM v_persons UNION ALL SELECT DISTINCT 'Department', department FROM v_persons)"


def merged(t) -> DataFrame:
    old = t.persons.select("name", F.col("department").alias("prop")).where("seq % 2 = 0")
    batch = t.persons.select("name", F.lit("new").alias("prop"), "seq").where("seq % 3 = 0")
    batch = batch.unionByName(batch.select("name", F.lit("older").alias("prop"), F.lit(-1).cast("long").alias("seq"))).unionByName(t.spark.range(1).select(F.lit("").alias("name"), F.lit("x").alias("prop"), "id").withColumnRenamed("id", "seq"))
    return G.merge_nodes(old, batch, "name", "seq")


query("G1_merge_nodes", merged, "SELECT name, CASE WHEN seq % 3 = 0 THEN 'new' ELSE department END AS prop FROM v_persons WHERE seq % 2 = 0 OR seq % 3 = 0", "persons")
query("G2_resolution_edges", lambda t: G.resolution_edges(t.resolutions), "SELECT DISTINCT 'Resolution' AS src_label, resolution_number AS src, 'AWARDS_CONTRACT_TO' AS rel, 'Vendor' AS dst_label, vendor AS dst FROM v_resolutions WHERE resolution_number IS NOT NULL AND trim(vendor) <> ''", "resolutions")
query(
    "G3_vote_edges", lambda t: G.vote_edges(t.votes.withColumn("id", F.struct("id", "vote"))),
    "SELECT 'CouncilMember' AS src_label, council_member AS src, 'VOTED' AS rel, 'Resolution' AS dst_label, resolution_number AS dst, trim(vote) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY council_member, resolution_number ORDER BY id DESC, vote DESC) AS k FROM v_votes WHERE resolution_number IS NOT NULL) WHERE k = 1", "votes",
)


def rels(t) -> DataFrame:
    return t.persons.select(F.lit(None).cast("string").alias("src_label"), F.col("name").alias("src"), F.lower("rel").alias("rel"), F.lit(None).cast("string").alias("dst_label"), F.when(F.col("seq") % 5 == 0, "Nowhere").otherwise(F.col("department")).alias("dst"))


query("G4_typed_edges", lambda t: G.typed_edges(rels(t), all_nodes(t)), "SELECT DISTINCT 'Person' AS src_label, name AS src, rel, 'Department' AS dst_label, department AS dst FROM v_persons WHERE seq % 5 <> 0", "persons")


def mentions(t) -> DataFrame:
    """Chunks of a report file to departments named with its grants."""
    chunks = t.grants.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), "source_file")
    entities = t.grants.select("source_file", F.lit("Department").alias("label"), F.upper(F.regexp_replace("department", "^(Bureau|Department) of ", "")).alias("name"))
    return G.mention_edges(chunks, entities, all_nodes(t))


query(
    "G5_mention_edges", mentions,
    "SELECT DISTINCT 'Chunk' AS src_label, 'c' || c.id AS src, 'MENTIONS' AS rel, 'Department' AS dst_label, n.department AS dst FROM v_grants c JOIN (SELECT DISTINCT source_file, upper(regexp_replace(department, '^(Bureau|Department) of ', '')) AS name FROM v_grants) e ON c.source_file = e.source_file JOIN (SELECT DISTINCT department FROM v_persons) n ON n.department = e.name", "grants", "persons",
)
query("G6_reported_in", lambda t: G.reported_in(t.registry, all_nodes(t).where("label = 'Department'").select(F.col("key").alias("name"))), "SELECT DISTINCT 'Department' AS src_label, department AS src, 'REPORTED_IN' AS rel, 'Document' AS dst_label, source_file AS dst FROM v_registry WHERE department IN (SELECT department FROM v_persons)", "registry", "persons")
query("G7_node_unique_check", lambda t: G.node_unique_check(all_nodes(t).unionByName(t.persons.where("seq % 10 = 0").select(F.lit("Person").alias("label"), F.col("name").alias("key")))), "SELECT 'Person' AS label, name AS key, 2 AS n FROM v_persons WHERE seq % 10 = 0".replace("2 AS n", "2::BIGINT AS n"), "persons")
query("G8_department_staff", lambda t: G.department_staff(all_edges(t), "NATION_3"), "SELECT department, name AS person, lower(rel) AS role FROM v_persons WHERE rel IN ('DIRECTS', 'MANAGES') AND department = 'NATION_3'", "persons")
query("G9_all_departments", lambda t: G.all_departments(all_nodes(t)), "SELECT DISTINCT department FROM v_persons", "persons")
query(
    "G10_pattern_match", lambda t: G.reports_to_chain(all_edges(t)),
    f"""+ RECURSIVE e AS (SELECT a.name AS person, b.name AS boss FROM (SELECT name, {BOSS_SEQ} AS boss_seq FROM v_persons) a JOIN v_persons b ON a.boss_seq = b.seq),
r AS (SELECT person, boss, 1::BIGINT AS steps FROM e UNION ALL SELECT r.person, e.boss, r.steps + 1 FROM r JOIN e ON r.boss = e.person WHERE r.steps < 45) SELECT person, boss, min(steps) AS steps, person = boss AS cycle FROM r GROUP BY ALL""", "persons",
)
