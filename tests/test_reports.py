"""Signals, projects, reports and questions on rows made by hand."""

import datetime
from decimal import Decimal

import pytest

from ledgerline.operators import projects as J
from ledgerline.operators import questions as U
from ledgerline.operators import reports as M
from ledgerline.operators import signals as Q

GOAL = "id long, department string, goal_title string, target string, status string, user_status string, year int, quarter string"
LINE = "department string, line_item string, revised_budget decimal(15,2), ytd_expended decimal(15,2), quarter string, year int"
LOG = "query_id long, retrieval decimal(3,2), accuracy decimal(3,2), completeness decimal(3,2), store string, asked date, run_id string"


def money(x):
    return None if x is None else Decimal(x)


def lines(spark, *rows):
    return spark.createDataFrame([(d, item, money(b), money(y), q, year) for d, item, b, y, q, year in rows], LINE)


def logs(spark, *rows):
    return spark.createDataFrame([(i, money(r), money(a), money(c), None, datetime.date.fromisoformat(d), run) for i, r, a, c, d, run in rows], LOG)


def test_the_latest_period_of_goals_is_that_of_all_rows(spark):
    goals = spark.createDataFrame([(1, "Parks", "Trees", "", None, None, 2026, "Q1"), (2, None, "Other", "", None, None, 2026, "Q2"), (3, "Codes", "Signs", "", None, None, 2026, "Q2")], GOAL)
    assert [(r.dept_key, r.signal) for r in Q.goal_findings(goals).collect()] == [("codes", "goal_no_progress")]


def test_the_latest_row_of_a_goal_is_that_of_the_last_department_as_written(spark):
    goals = spark.createDataFrame([(9, "Bureau of Parks", "Trees", "", "done", None, 2026, "Q1"), (1, "Parks", "trees", "7", "begun", "", 2026, "Q1")], GOAL)
    row = Q.goal_findings(goals).first()
    assert (row.signal, row.evidence) == ("goal_in_progress", "begun") and "“trees” (target: 7)" in row.question


def test_labels_of_departments_come_from_goals_without_titles_too(spark):
    goals = spark.createDataFrame([(1, "Parks", "Trees", "", "begun", None, 2026, "Q1"), (2, "Bureau of Parks", None, "", None, None, 2026, "Q1")], GOAL)
    assert Q.goal_findings(goals).first().department == "Bureau of Parks"


def test_no_figures_are_no_spending_and_quarters_are_trimmed(spark):
    rows = lines(spark, ("Parks", "Pens", 100, None, " Q2", 2026), ("Codes", "Pens", 100, 50, " Q2", 2026), ("Fire", "Pens", None, 50, " Q2", 2026), (None, "Pens", 100, 90, " Q2", 2026))
    got = [(r.department, r.question.split(" (")[0]) for r in Q.budget_pace(rows).collect()]
    assert got == [("Parks", "Parks has spent only 0% of its revised budget by Q2 2026")]


def test_vacancies_are_open_as_written(spark):
    rows = [(1, "Parks", " Clerk ", "OPEN", 2), (2, "Parks", "none", "open", 3), (3, "Parks", "Guard", " open", 4), (4, "Parks", "", "open", 5), (5, "Parks", None, "open", 6), (6, "Parks", "Cook", None, 7), (7, "Parks", "Aide", "open", None)]
    frame = spark.createDataFrame([(*r, 2026, "Q1") for r in rows], "id long, department string, position_title string, status string, open_count int, year int, quarter string")
    assert Q.vacancy(frame).first().question == "Parks reported 2 open positions in Q1 2026 (Clerk (2), Aide). What's the current hiring status?"


def test_resolutions_group_wherever_there_is_a_vendor(spark):
    rows = spark.createDataFrame([(i, str(i), "Contract", Decimal(1), v, "Parks", "passed") for i, v in enumerate(["A, LLC", "a llc", "LLC", "", None])], "id long, resolution_number string, title string, amount decimal(15,2), vendor string, department string, status string")
    assert [r.group_key for r in J.resolution_projects(rows).orderBy("project").collect()] == ["a|contract", "a|contract", "|contract", None, None]


def test_tokens_that_no_call_states_are_null(spark):
    usage = spark.createDataFrame([("a", "model-a", 1, None, "2026-01-01"), ("a", "model-a", 2, None, "2026-01-02")], "call_site string, model string, input_tokens int, output_tokens int, timestamp string")
    usage = usage.selectExpr("*", "cast(null as int) AS cache_read_tokens", "0 AS cache_write_tokens").withColumn("timestamp", usage.timestamp.cast("timestamp"))
    row = M.usage_report(M.usage_cost(usage), "2026-01-01", "2026-02-01").first()
    assert (row.calls, row.input_tokens, row.output_tokens, row.cache_read_tokens, row.cache_write_tokens, row.cost) == (2, 3, None, None, 0, pytest.approx(9e-6))


def test_a_clock_limits_incomplete_answers_only(spark):
    rows = logs(spark, (1, 1, 5, 5, "2020-01-01", "a"), (2, 5, 1, 5, "2026-05-01", "a"), (3, 5, 5, 1, "2020-01-01", "a"), (4, 5, 5, 1, "2026-03-01", "a"), (5, 5, 5, 5, "2026-05-01", "a"), (6, None, None, 1, "2026-05-02", "a"))
    assert [r.query_id for r in M.low_scoring(rows, 3.0, "2026-06-01").collect()] == [6, 2, 4, 1]
    assert sorted(r.query_id for r in M.low_scoring(rows, 3.0).collect()) == [1, 2, 3, 4, 6]


def test_reports_of_runs(spark):
    rows = logs(spark, (1, 1, 2, 3, "2026-01-01", "a"), (2, 3, 3, 3, "2026-01-02", "a"), (3, 5, 4, "4.5", "2026-01-02", "a"), (4, 5, 5, 5, "2026-01-02", "0"))
    report = M.eval_report(rows).first()
    assert (report.total, report.passed, report.failed, report.pass_rate, report.avg_retrieval, report.first_failures) == (4, 3, 1, 0.75, 3.5, "1 R:1.0 A:2.0 C:3.0")
    assert M.eval_report(rows.where("query_id < 4")).first().pass_rate == 0.67
    assert M.last_run(rows).first()[:7] == ("a", datetime.date(2026, 1, 2), 2, 2, 4.0, 3.5, 3.75)


@pytest.mark.parametrize("rate, least, most", [(-1, 0, 0), (0, 0, 0), (0.3, 230, 370), (1, 1000, 1000), (2, 1000, 1000)])
def test_shares_of_queries(spark, rate, least, most):
    assert least <= M.sample_queries(spark.range(1000).toDF("query_id"), rate).count() <= most


def test_readers_are_those_of_resolution_files(spark):
    documents = spark.createDataFrame([("RESOLUTIONS 1.pdf", "minutes", "ocr"), ("resolutions 2.pdf", "resolution", "ocr"), ("Other.pdf", "resolution", "text")], "source_file string, document_type string, parser_used string")
    votes, resolutions = spark.createDataFrame([], "resolution_number string"), spark.createDataFrame([(None,)], "amount int")
    assert {tuple(r) for r in M.vote_counts(votes, resolutions, documents).collect()} == {("amounts", "", 0), ("readers", "ocr", 2)}


def test_budgets_of_a_period_or_the_latest(spark):
    rows = lines(spark, ("Parks", "Pens", 5, 1, "Q1", 2026), ("Parks", "Pens", 6, 3, "Q2", 2026), ("Bureau of Parks", "Ink", 1, 1, "Q2", 2026), ("Parks", "Total", 7, 4, "Q2", 2026), ("Codes", "Pens", 9, 9, "Q1", 2026))
    assert [tuple(r) for r in U.department_totals(rows).collect()] == [("parks", 7.0, 4.0)]
    assert sorted(tuple(r) for r in U.department_totals(rows, year=2026, quarter="Q1").collect()) == [("codes", 9.0, 9.0), ("parks", 5.0, 1.0)]
    metrics = spark.createDataFrame([("Parks", "Inspections done", Decimal(2), 2026, "Q1"), ("Bureau of Parks", "inspections", Decimal(3), 2026, "Q2"), ("Fire", "inspections", Decimal(4), 2026, "Q1")], "department string, metric_name string, metric_value decimal(15,2), year int, quarter string")
    assert [tuple(r) for r in U.metric_and_budget(metrics, rows, "inspection").collect()] == [("parks", 5.0, 7.0, 4.0)]
    assert [tuple(r) for r in U.metric_and_budget(metrics, rows, "inspection", 2026, "Q1").collect()] == [("parks", 2.0, 5.0, 1.0)]
