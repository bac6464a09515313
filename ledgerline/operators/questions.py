"""Questions that the tables must answer (U1 to U16), as named queries with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T

from .graph import department_staff, related
from .panels import by_department, dedupe_grants, dollars, in_latest, latest_spend_period, vacancies_open
from .retrieval import vector_topk


def of_department(rows: DataFrame, department: str | None) -> DataFrame:
    return rows if department is None else rows.where(T.dept_key(F.col("department")) == T.dept_key(F.lit(department)))


def in_period(rows: DataFrame, year: int | None = None, quarter: str | None = None) -> DataFrame:
    rows = rows if year is None else rows.where(F.col("year") == year)
    return rows if quarter is None else rows.where(F.col("quarter") == quarter)


def line_item_spend(expenditures: DataFrame, item: str, year=None, quarter=None) -> DataFrame:
    """Spending and budget of a line item."""
    rows = in_period(expenditures.where(F.col("line_item").ilike(item)), year, quarter)
    return rows.groupBy("year", "quarter").agg(dollars("ytd_expended").alias("ytd"), dollars("revised_budget").alias("budget"))


def top_spender(expenditures: DataFrame, year=None, quarter=None) -> DataFrame:
    """The department that spent most."""
    per = by_department(in_period(expenditures, year, quarter).groupBy("department").agg(F.sum("ytd_expended").alias("ytd")), dollars("ytd").alias("ytd")).select("dept_key", "ytd")
    return per.orderBy(F.desc("ytd"), "dept_key").limit(1)


def department_totals(expenditures: DataFrame, department: str | None = None, year: int | None = None, quarter: str | None = None) -> DataFrame:
    """U4: budget and spending of one department, or of each, in a period (the latest if none is given), without totals."""
    asked = year is not None or quarter is not None
    rows = in_period(expenditures, year, quarter) if asked else in_latest(expenditures, latest_spend_period(expenditures))
    rows = rows.where(~F.col("line_item").ilike("%total%"))
    per = rows.groupBy("department").agg(F.sum("revised_budget").alias("budget"), F.sum("ytd_expended").alias("ytd"))
    return by_department(of_department(per, department), dollars("budget").alias("budget"), dollars("ytd").alias("ytd")).drop("department")


def metric_total(metrics: DataFrame, name: str, department: str | None = None, year=None, quarter=None) -> DataFrame:
    """A metric by name, summed per department and period."""
    rows = of_department(in_period(metrics.where(F.col("metric_name").ilike(f"%{name}%")), year, quarter), department)
    return rows.groupBy("department", "year", "quarter").agg(dollars("metric_value").alias("total"), F.count("*").alias("n"))


def grants_of(grants: DataFrame, department: str | None = None, year: int | None = None) -> DataFrame:
    """Grants of a department that start in a year."""
    rows = of_department(dedupe_grants(grants), department)
    rows = rows if year is None else rows.where(F.year("start_date") == year)
    return rows.select("id", "dept_key", "grant_name", "start_date", F.col("amount").cast("double").alias("amount"))


def vacancies_of(vacancies: DataFrame, department: str | None = None) -> DataFrame:
    """Open positions and their count per department that has any."""
    rows = of_department(vacancies_open(vacancies), department)
    return rows.groupBy("dept_key").agg(F.count("*").alias("positions"), F.sum("open_count").alias("open_count"))


def most_vacancies(vacancies: DataFrame) -> DataFrame:
    """U8."""
    return vacancies_of(vacancies).orderBy(F.desc("positions"), "dept_key").limit(1)


def total_grants(grants: DataFrame) -> DataFrame:
    """Amount of all grants, each once."""
    return dedupe_grants(grants).agg(dollars("amount").alias("amount"), F.count("*").alias("n"))


def vacancies_and_projects(vacancies: DataFrame, projects: DataFrame) -> DataFrame:
    """Departments with both."""
    return vacancies_open(vacancies).select("dept_key").intersect(projects.select(T.dept_key("department").alias("dept_key")))


def top_spender_director(expenditures: DataFrame, edges: DataFrame, item: str) -> DataFrame:
    """The top spender on a line item, with those who direct it."""
    per = expenditures.where(F.col("line_item").ilike(item)).groupBy(T.dept_key("department").alias("dept_key")).agg(dollars("ytd_expended").alias("ytd"))
    top = per.orderBy(F.desc("ytd"), "dept_key").limit(1)
    who = related(edges, "DIRECTS").select(F.col("src").alias("director"), T.dept_key("dst").alias("dept_key"))
    return top.join(who, "dept_key", "left")


def leaders_and_spend(expenditures: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders of each department with its total spending."""
    who = related(edges, "DIRECTS").select(F.col("src").alias("leader"), T.dept_key("dst").alias("dept_key"))
    return who.join(department_totals(expenditures), "dept_key").select("dept_key", "leader", "ytd")


def grants_and_managers(grants: DataFrame, edges: DataFrame) -> DataFrame:
    """Grant money of each department with those who manage it."""
    who = related(edges, "MANAGES").select(F.col("src").alias("manager"), T.dept_key("dst").alias("dept_key"))
    return who.join(dedupe_grants(grants).groupBy("dept_key").agg(dollars("amount").alias("amount")), "dept_key")


def metric_and_budget(metrics: DataFrame, expenditures: DataFrame, name: str, year: int | None = None, quarter: str | None = None) -> DataFrame:
    """A metric's total beside budget and spending per department, both of a period; without one, all of the metric and the latest spending."""
    one = in_period(metrics, year, quarter).where(F.col("metric_name").ilike(f"%{name}%")).groupBy("department").agg(F.sum("metric_value").alias("total"))
    return by_department(one, dollars("total").alias("total")).drop("department").join(department_totals(expenditures, None, year, quarter), "dept_key")


def staff(edges: DataFrame, department: str | None = None) -> DataFrame:
    """U14."""
    return department_staff(edges, department)


def narrative(requests: DataFrame, chunks: DataFrame, filters: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """Retrieval under a filter."""
    return vector_topk(requests, chunks, k, filters)


def narrative_and_figures(requests: DataFrame, chunks: DataFrame, figures: DataFrame, k: int = 5) -> DataFrame:
    """U16: retrieved chunks with the figures of their department."""
    found = vector_topk(requests, chunks, k).join(chunks.select("chunk_id", "department"), "chunk_id")
    return found.join(figures, "department", "left")
