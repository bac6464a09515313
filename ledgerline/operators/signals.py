"""Gap-detection signals (Q1 to Q10): findings with one common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T

from .panels import by_department, dollars, in_latest, labelled, latest_spend_period

PRIORITY = {"highest": 0, "high": 1, "medium": 2, "low": 3}
PACE = {"Q1": 0.25, "Q2": 0.5, "Q3": 0.75, "Q4": 1.0}
AHEAD, BEHIND = 1.5, 0.5


def clean_period() -> Column:
    return F.struct(F.coalesce("year", F.lit(0)).alias("year"), F.trim(F.coalesce("quarter", F.lit(""))).alias("quarter"))


def label(p: str) -> Column:
    year, quarter = F.col(f"{p}.year"), F.col(f"{p}.quarter")
    return F.when(year == 0, quarter).otherwise(F.trim(F.concat_ws(" ", quarter, year.cast("string"))))


def finding(signal: str, priority: str, question: Column, evidence: Column) -> list[Column]:
    return [F.col("dept_key"), F.col("department"), F.lit(signal).alias("signal"), F.lit(priority).alias("priority"), question.alias("question"), evidence.cast("string").alias("evidence")]


def say(template: str, *args: Column) -> Column:
    """Q9: wording with the arguments in place of each {}."""
    parts, out = template.split("{}"), []
    for i, p in enumerate(parts):
        out.append(F.lit(p))
        if i < len(args):
            out.append(F.coalesce(args[i].cast("string"), F.lit("")))
    return F.concat(*out)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def goal_history(goals: DataFrame) -> DataFrame:
    """Per (department, title): distinct periods, whether any row has a status, and the latest row; of one period that of the last department as written, then id.

    The latest period and the labels are those of all rows, whether or not they have a title.
    """
    rows = goals.where("department is not null and goal_title is not null").withColumn("title_key", T.norm_title("goal_title"))
    rows = rows.where("title_key <> ''").withColumn("p", clean_period()).withColumn("eff", F.trim(F.coalesce(F.nullif("user_status", F.lit("")), "status", F.lit(""))))
    # keys are made for the distinct names, which are few
    keyed = goals.where("department is not null").select("department").distinct().withColumn("dept_key", T.dept_key("department")).where("dept_key <> ''")
    rows = rows.join(keyed, "department")
    names = labelled(keyed).withColumnRenamed("department", "label")
    last = F.struct("p", "department", "id")
    out = rows.groupBy("dept_key", "title_key").agg(
        F.count_distinct("p").alias("n"), F.bool_and(F.col("eff") == "").alias("silent"), F.min("p").alias("first"), F.max("p").alias("last"),
        F.max_by("goal_title", last).alias("goal_title"), F.max_by("eff", last).alias("eff"), F.max_by(F.trim(F.coalesce("target", F.lit(""))), last).alias("target"),
    )
    top = F.broadcast(goals.agg(F.max(clean_period()).alias("top")))  # one row
    return out.join(names.withColumnRenamed("label", "department"), "dept_key").crossJoin(top)


def stalled() -> Column:
    return (F.col("n") >= 2) & F.col("silent")


def goal_stalled(goals: DataFrame) -> DataFrame:
    """Q1: no status in two or more periods; takes the place of Q2 and Q3."""
    return goal_findings(goals).where("signal = 'goal_stalled'")


def target_clause() -> Column:
    return F.when(F.col("target") != "", say(" (target: {})", F.col("target"))).otherwise("")


def goal_no_progress(goals: DataFrame) -> DataFrame:
    """Q2: the latest row is of the latest period and has no status."""
    return goal_findings(goals).where("signal = 'goal_no_progress'")


def goal_in_progress(goals: DataFrame) -> DataFrame:
    """Q3: the latest row is of the latest period and its status is neither empty nor complete."""
    return goal_findings(goals).where("signal = 'goal_in_progress'")


def goal_findings(goals: DataFrame) -> DataFrame:
    """Q1 to Q3 from one history of the goals; at most one of them holds for a goal."""
    one = lambda signal, priority, question, evidence: F.struct(*finding(signal, priority, question, evidence)[2:])
    q1 = say("“{}” has appeared in {} quarterly reports ({}→{}) with no status update — what progress has been made since {}?", F.col("goal_title"), F.col("n"), label("first"), label("last"), label("last"))
    q2 = say("{}'s goal “{}”{} has no progress reported for {}. What's the current status?", F.col("department"), F.col("goal_title"), target_clause(), label("last"))
    q3 = say("{}'s goal “{}”{} was reported “{}” as of {}. What progress has been made since?", F.col("department"), F.col("goal_title"), target_clause(), F.col("eff"), label("last"))
    status, now = T.goal_status(F.col("eff")), F.col("last") == F.col("top")
    found = F.when(stalled(), one("goal_stalled", "highest", q1, F.col("n")))
    found = found.when(now & (status == "none"), one("goal_no_progress", "high", q2, F.col("target"))).when(now & (status == "in_progress"), one("goal_in_progress", "medium", q3, F.col("eff")))
    return goal_history(goals).withColumn("f", found).where("f is not null").select("dept_key", "department", "f.*")


def budget_pace(expenditures: DataFrame) -> DataFrame:
    """Q4: spending far from the share of the budget expected at the quarter's end; without figures nothing is spent."""
    rows = in_latest(expenditures, latest_spend_period(expenditures)).where(~F.col("line_item").ilike("%total%")).withColumn("quarter", F.trim("quarter"))
    per = rows.groupBy("department", "year", "quarter").agg(F.sum("revised_budget").alias("budget"), F.sum("ytd_expended").alias("ytd"))
    per = by_department(per, dollars("budget").alias("budget"), F.coalesce(dollars("ytd"), F.lit(0.0)).alias("ytd"), F.first("year").alias("year"), F.first("quarter").alias("quarter")).where("dept_key <> ''")
    expected = F.element_at(F.create_map(*(F.lit(x) for kv in PACE.items() for x in kv)), F.col("quarter"))
    per = per.where("budget > 0").withColumn("expected", expected).withColumn("pace", F.col("ytd") / F.col("budget"))
    per = per.where((F.col("pace") > F.col("expected") * AHEAD) | (F.col("pace") < F.col("expected") * BEHIND))
    args = F.bround(F.col("pace") * 100).cast("long"), T.period_label(F.col("year"), F.col("quarter")), F.bround(F.col("expected") * 100).cast("long")
    ahead = say("{} is at {}% of its revised budget by {} (≈{}% expected) — what's driving the elevated spend?", F.col("department"), *args)
    behind = say("{} has spent only {}% of its revised budget by {} (≈{}% expected) — why is spending behind pace?", F.col("department"), *args)
    return per.select(*finding("budget_pace", "high", F.when(F.col("pace") > F.col("expected") * AHEAD, ahead).otherwise(behind), F.bround("pace", 3)))


def vacancy(vacancies: DataFrame) -> DataFrame:
    """Q5: open positions of the department's own latest period."""
    rows = vacancies.where(F.lower("status") == "open").where(~F.lower("position_title").isin("", "none"))
    rows = rows.withColumn("p", clean_period())
    per = rows.groupBy("department").agg(F.max("p").alias("last"))
    last = by_department(per, F.max("last").alias("last")).where("dept_key <> ''").withColumnRenamed("department", "label")
    keyed = per.select("department", T.dept_key("department").alias("dept_key"))
    rows = rows.join(keyed, "department")
    now = rows.join(last, "dept_key").where("p = last")
    item = F.concat(F.trim("position_title"), F.when(F.col("open_count") != 0, say(" ({})", F.col("open_count"))).otherwise(""))
    per = now.groupBy("dept_key", "label", "last").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))), lambda x: x["item"]), ", ").alias("listing"), F.count("*").alias("n"), F.nullif(F.sum("open_count"), F.lit(0)).alias("total")
    ).withColumnRenamed("label", "department")
    clause = F.when(F.col("total").isNotNull(), plural(F.col("total"), "open position")).otherwise(plural(F.col("n"), "open role"))
    return per.select(*finding("vacancy", "medium", say("{} reported {} in {} ({}). What's the current hiring status?", F.col("department"), clause, label("last"), F.col("listing")), F.col("total")))


def grant(grants: DataFrame, per_dept: int = 5) -> DataFrame:
    """Q6: the department's largest grants that are not closed, as read (not de-duplicated)."""
    rows = grants.where("department is not null and grant_name <> ''").where(~F.coalesce(F.lower("status").rlike("|".join(T.CLOSED_GRANT)), F.lit(False)))
    rows = rows.withColumn("dept_key", T.dept_key("department")).where("dept_key <> ''")
    names = labelled(rows.select("dept_key", "department").distinct()).withColumnRenamed("department", "label")
    top = Window.partitionBy("dept_key").orderBy(F.coalesce("amount", F.lit(0)).desc(), "id")
    rows = rows.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= per_dept).drop("department").join(names.withColumnRenamed("label", "department"), "dept_key")
    amount = F.when(F.col("amount").isNotNull(), say(" (${})", F.format_number(F.bround(F.col("amount").cast("double"), 0), 0))).otherwise("")
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("active"))
    q = say("{}'s grant “{}”{} was reported {}. What's the current status / drawdown for next quarter?", F.col("department"), F.col("grant_name"), amount, status)
    return rows.select(*finding("grant", "low", q, F.col("grant_number")))


def quiet_department(documents: DataFrame) -> DataFrame:
    """Q7: departments whose last quarterly report is older than the latest one on record."""
    rows = documents.where("document_type = 'quarterly_report' and department is not null and department <> ''").groupBy("department").agg(F.max(clean_period()).alias("last"))
    per = by_department(rows, F.max("last").alias("last")).where("dept_key <> ''")
    top = F.broadcast(per.agg(F.max("last").alias("top")))  # one row
    late = per.crossJoin(top).where("last < top and top.year <> 0")
    since = F.coalesce(F.nullif(label("last"), F.lit("")), F.lit("the period on record"))
    q = say("{} hasn't filed a quarterly report since {} (latest on record is {}). Please provide an update.", F.col("department"), since, label("top"))
    return late.select(*finding("quiet_department", "high", q, label("last")))


def all_findings(goals, expenditures, vacancies, grants, documents) -> DataFrame:
    out = goal_findings(goals)
    for more in (budget_pace(expenditures), vacancy(vacancies), grant(grants), quiet_department(documents)):
        out = out.unionByName(more)
    return out


def prep_sheet(findings: DataFrame) -> DataFrame:
    """Q8: findings of each department ranked by priority and signal; its label is that of its first finding."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("priority"))
    order = Window.partitionBy("dept_key").orderBy(rank, "signal", "question")
    out = findings.withColumn("place", F.row_number().over(order)).withColumn("label", F.first("department").over(order))
    return out.select("dept_key", F.col("label").alias("department"), F.col("place").cast("long").alias("place"), "signal", "priority", "question").orderBy(F.lower("department"), "dept_key", "place")


def questions_for_department(findings: DataFrame, department: str) -> DataFrame:
    """Q10: the questions of one department, with a hash of their wordings in order."""
    rows = prep_sheet(findings).where(F.col("dept_key") == T.dept_key(F.lit(department)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "question"))), lambda x: x["question"]), "\n")
    return rows.groupBy("dept_key", "department").agg(F.count("*").alias("n"), F.sha2(said, 256).alias("wording"))
