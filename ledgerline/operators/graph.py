"""The entity graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.keyed import KeyedTable
from ledgerline.sources.scratch import written

EDGE = ["src_label", "src", "rel", "dst_label", "dst"]


def last_row(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_nodes(nodes: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """G1: nodes with the batch's last row of each key in place of what was there; null and empty keys are dropped."""
    fresh = last_row(batch.where(f"{key} is not null and {key} <> ''"), [key], order).drop(order)
    return nodes.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def put_nodes(table: KeyedTable, batch: DataFrame, order: str) -> None:
    """G1 on disk: nodes by their key, of which only the touched buckets are rewritten."""
    table.upsert(batch.where(F.col(table.key).isNotNull() & (F.col(table.key) != "")), order)


def edges(rows: DataFrame, src_label: str, src, rel: str, dst_label: str, dst) -> DataFrame:
    return rows.select(F.lit(src_label).alias("src_label"), F.col(src).alias("src"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst"))


def resolution_edges(resolutions: DataFrame) -> DataFrame:
    """Resolution to vendor."""
    rows = resolutions.where("resolution_number is not null and trim(coalesce(vendor, '')) <> ''")
    return edges(rows, "Resolution", "resolution_number", "AWARDS_CONTRACT_TO", "Vendor", "vendor").distinct()


def vote_edges(votes: DataFrame) -> DataFrame:
    """Member to resolution with the last vote."""
    rows = last_row(votes.where("resolution_number is not null and council_member is not null"), ["council_member", "resolution_number"], "id")
    return edges(rows.withColumn("_v", F.col("vote")), "CouncilMember", "council_member", "VOTED", "Resolution", "resolution_number").join(
        rows.select(F.col("council_member").alias("src"), F.col("resolution_number").alias("dst"), F.trim("vote").alias("vote")), ["src", "dst"]
    )


def typed_edges(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rels (src_label, src, rel, dst_label, dst) in upper case with default labels, if both ends are nodes (label, key)."""
    rows = rels.select(F.coalesce("src_label", F.lit("Person")).alias("src_label"), "src", F.upper("rel").alias("rel"), F.coalesce("dst_label", F.lit("Department")).alias("dst_label"), "dst")
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(end)).distinct(), [f"{end}_label", end], "left_semi")
    return rows.select(*EDGE).dropDuplicates()


def mention_edges(chunks: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks (chunk_id, source_file) of the graph route to the entities (source_file, label, name) of their file that are nodes.

    Chunks are made distinct before they meet the names, which a file has once: only edges of a chunk_id in several files can repeat, so only these are
    compared.
    """
    known = entities.select("source_file", "label", "name").distinct().join(nodes.select("label", F.col("key").alias("name")).distinct(), ["label", "name"], "left_semi")
    names = known.groupBy("source_file").agg(F.collect_list(F.struct("label", "name")).alias("names"))
    files = chunks.where("source_file is not null").groupBy("chunk_id").agg(F.collect_set("source_file").alias("files"))

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.select("chunk_id", F.explode("files").alias("source_file")).join(names, "source_file").select("chunk_id", F.explode("names").alias("e"))
        return rows.select(F.lit("Chunk").alias("src_label"), F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("e.label").alias("dst_label"), F.col("e.name").alias("dst"))

    return found(files.where(F.size("files") == 1)).unionByName(found(files.where(F.size("files") > 1)).distinct())


def reported_in(documents: DataFrame, departments: DataFrame) -> DataFrame:
    """Department to document, for departments that are nodes."""
    rows = documents.where("department is not null").join(departments.select(F.col("name").alias("department")), "department", "left_semi")
    return edges(rows, "Department", "department", "REPORTED_IN", "Document", "source_file").distinct()


def node_unique_check(nodes: DataFrame) -> DataFrame:
    """Keys with more than one node; none in a sound graph."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def department_staff(edges: DataFrame, department: str | None = None) -> DataFrame:
    """People who direct or manage a department, or each department."""
    rows = edges.where("rel in ('DIRECTS', 'MANAGES') and dst_label = 'Department'")
    if department is not None:
        rows = rows.where(F.col("dst") == department)
    return rows.select(F.col("dst").alias("department"), F.col("src").alias("person"), F.lower("rel").alias("role"))


def all_departments(nodes: DataFrame) -> DataFrame:
    """G9."""
    return nodes.where("label = 'Department'").select(F.col("key").alias("department")).distinct().orderBy("department")


def related(edges: DataFrame, rel: str, src_label: str | None = None) -> DataFrame:
    """(src, dst) of a relation, such as who leads what, or projects and grants of departments."""
    rows = edges.where(F.col("rel") == rel)
    if src_label:
        rows = rows.where(F.col("src_label") == src_label)
    return rows.select("src", "dst")


def reports_to_chain(edges: DataFrame) -> DataFrame:
    """(person, boss, steps, cycle): all who are reached by following REPORTS_TO any number of times, with the least number of steps.

    Chains double: what is known of up to n steps is joined with itself, so a chain of n takes log2(n) rounds, each a join of written
    tables. A person on a cycle reaches oneself: that row, and only such, has cycle true and as steps the length of the shortest
    cycle. Edges without both ends are left out. The result has a row for each pair, so it grows with the length of chains.
    """
    step = edges.where("rel = 'REPORTS_TO' and src is not null and dst is not null").select(F.col("src").alias("person"), F.col("dst").alias("boss")).distinct()
    known, mark = written(step.withColumn("steps", F.lit(1).cast("long")), "chains"), None
    while True:
        # pairs only become more, and their steps fewer
        now = known.agg(F.count("*"), F.sum("steps")).first()
        if now == mark:
            return known.withColumn("cycle", F.col("person") == F.col("boss"))
        mark = now
        onward = known.select(F.col("person").alias("boss"), F.col("boss").alias("next"), F.col("steps").alias("more"))
        joined = known.where("person <> boss").join(onward, "boss").select("person", F.col("next").alias("boss"), (F.col("steps") + F.col("more")).alias("steps"))
        known = written(known.unionByName(joined).groupBy("person", "boss").agg(F.min("steps").alias("steps")), "chains")
