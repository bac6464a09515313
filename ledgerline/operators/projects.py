"""The projects layer (J1 to J6): grants and resolutions as one kind of row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T

from .panels import day, dedupe_grants

ADMINISTRATIVE = ("budget", "appointment")
IN_FLIGHT = ("Active", "Awarded", "Proposed")


def dedupe_resolutions(resolutions: DataFrame) -> DataFrame:
    """The first row of each number; rows without a number are all kept."""
    rows = resolutions.withColumn("number_key", F.trim(F.coalesce("resolution_number", F.lit(""))))
    first = Window.partitionBy("number_key").orderBy("id")
    one = rows.where("number_key <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return one.unionByName(rows.where("number_key = ''"))


def grant_projects(grants: DataFrame, as_of: str, horizon_days: int = 120) -> DataFrame:
    """De-duplicated grants with a name; those that end soon need attention."""
    rows = dedupe_grants(grants).where("title_key <> ''")
    soon = F.coalesce(F.col("end_date").between(day(as_of), F.date_add(day(as_of), horizon_days)), F.lit(False))
    return rows.select(
        F.concat(F.lit("grant-"), F.col("id").cast("string")).alias("project"), F.lit("grant").alias("type"), F.trim("grant_name").alias("title"), "department",
        F.col("amount").cast("double").alias("amount"), T.grant_status(F.coalesce("status", F.lit(""))).alias("status"), soon.alias("attention"), F.lit(None).cast("string").alias("group_key"),
    )


def resolution_projects(resolutions: DataFrame) -> DataFrame:
    """Resolutions with a title, by type; stalled ones need attention, and those of one party and type group, where there is a vendor. Of one number the first row counts, titled or not."""
    kind, status = T.resolution_type(F.coalesce("title", F.lit(""))), T.resolution_status(F.coalesce("status", F.lit("")))
    group = F.when(F.col("vendor") != "", F.concat(T.norm_party("vendor"), F.lit("|"), kind))
    rows = dedupe_resolutions(resolutions).where("trim(title) <> ''")
    return rows.select(
        F.concat(F.lit("resolution-"), F.col("id").cast("string")).alias("project"), kind.alias("type"), F.trim("title").alias("title"), "department", F.col("amount").cast("double").alias("amount"),
        status.alias("status"), (status == "Stalled").alias("attention"), group.alias("group_key"),
    )


def projects(grants: DataFrame, resolutions: DataFrame, as_of: str, horizon_days: int = 120) -> DataFrame:
    """Both kinds with `administrative`, those that need attention first, then by amount."""
    rows = grant_projects(grants, as_of, horizon_days).unionByName(resolution_projects(resolutions))
    return rows.withColumn("administrative", F.col("type").isin(*ADMINISTRATIVE)).orderBy(F.desc("attention"), F.desc(F.coalesce("amount", F.lit(0.0))), F.lower("title"), "project")


def project_counts(rows: DataFrame) -> DataFrame:
    """Counts by type, active ones, those that need attention, and money in flight; administrative rows left out."""
    return rows.where("not administrative").groupBy("type").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if("attention").alias("attention"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*IN_FLIGHT), F.col("amount").cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias("in_flight"),
    )


def project_groups(rows: DataFrame) -> DataFrame:
    """Cards of two or more projects with one group key in a department."""
    rows = rows.where("group_key is not null and not administrative").withColumn("dept_key", T.dept_key("department"))
    common = rows.groupBy("dept_key", "group_key", "status").agg(F.count("*").alias("k")).groupBy("dept_key", "group_key").agg(F.min_by("status", F.struct(-F.col("k"), "status")).alias("usual"))
    per = rows.groupBy("dept_key", "group_key").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"), F.bool_or(F.col("status") == "Active").alias("any_active"), F.bool_or("attention").alias("attention"))
    out = per.where("n >= 2").join(common, ["dept_key", "group_key"])
    return out.select("dept_key", "group_key", "n", "amount", F.when(F.col("any_active"), "Active").otherwise(F.col("usual")).alias("status"), "attention")
