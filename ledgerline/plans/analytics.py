"""Queries of panels, signals, projects, reports and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import panels as A
from ledgerline.operators import projects as J
from ledgerline.operators import questions as U
from ledgerline.operators import reports as M
from ledgerline.operators import signals as Q
from ledgerline.sources.conform import AS_OF, BOARDS_AS_OF, with_views
from ledgerline.sources.scratch import scratch_path

from .graphs import all_edges
from .registry import ACTIVE, LATEST, LINES, SQL, dk, grants, label, nt, pk, query

D = f"DATE '{AS_OF}'"
LIVE = f"(coalesce(lower(trim(status)) IN ({ACTIVE}), false) OR coalesce(end_date >= {D}, false))"

# Panels -------------------------------------------------------------------------------------------------------------

LDP = "SELECT max(year) AS year, coalesce((SELECT max(quarter) FROM v_registry WHERE year = (SELECT max(year) FROM v_registry)), '') AS quarter FROM v_registry"
query("A1_latest_document_period", lambda t: A.latest_document_period(t.registry), LDP, "registry")
query("A2_latest_spend_period", lambda t: A.latest_spend_period(t.expenditures), LATEST, "expenditures")
query("A3_dedupe_grants", lambda t: A.dedupe_grants(t.grants).select("id", "title_key", "dept_key", "amount"), f"SELECT id, title_key, dept_key, amount::DOUBLE AS amount FROM {grants()}", "grants")
query(
    "A4_kpi_grants", lambda t: A.kpi_grants(t.grants, AS_OF),
    f"SELECT count(*) AS live, coalesce(sum(amount)::DOUBLE, 0) AS amount, count(*) FILTER (WHERE end_date <= {D} + 90) AS expiring FROM {grants(scored=('amount', 'end_date', 'status'))} WHERE {LIVE}", "grants",
)
query("A5_kpi_spend", lambda t: A.kpi_spend(t.expenditures), f"SELECT coalesce(sum(ytd_expended)::DOUBLE, 0) AS ytd, coalesce(sum(revised_budget)::DOUBLE, 0) AS budget FROM ({LINES})", "expenditures")
query(
    "A6_kpi_coverage", lambda t: A.kpi_coverage(t.registry),
    f"SELECT count(DISTINCT k) AS roster, count(DISTINCT CASE WHEN r.year = l.year AND r.quarter = l.quarter THEN k END) AS filed FROM (SELECT year, quarter, nullif({dk('department')}, '') AS k FROM v_registry WHERE document_type = 'quarterly_report' AND quarter <> '') r, ({LDP}) l", "registry",
)
query("A7_kpi_counts", lambda t: A.kpi_counts(t.resolutions, t.registry), "SELECT (SELECT count(*) FROM v_resolutions) AS resolutions, (SELECT count(*) FROM v_registry WHERE document_type = 'unclassified') AS unclassified", "resolutions", "registry")
query(
    "A8_timeline_grants", lambda t: A.timeline_grants(t.grants),
    f"SELECT id, coalesce(nullif(grant_name, ''), 'Grant') AS label, department, dept_key, start_date::VARCHAR AS start_date, coalesce(end_date, (start_date + INTERVAL 12 MONTH)::DATE)::VARCHAR AS end_date, status, amount::DOUBLE AS amount FROM {grants('(SELECT * FROM v_grants WHERE start_date IS NOT NULL)', order='start_date, id')}", "grants",
)
query(
    "A9_timeline_reports", lambda t: A.timeline_reports(t.registry),
    "SELECT id, source_file, department, make_date(year, CASE quarter WHEN 'Q2' THEN 4 WHEN 'Q3' THEN 7 WHEN 'Q4' THEN 10 ELSE 1 END, 1)::VARCHAR AS at FROM v_registry WHERE year IS NOT NULL AND quarter <> ''".replace(" AS at ", ' AS "at" '), "registry",
)
query(
    "A10_timeline_resolutions", lambda t: A.timeline_resolutions(t.resolutions),
    "SELECT id, coalesce(nullif(trim(resolution_number), ''), nullif(trim(title), ''), 'Resolution') AS label, adopted_date::VARCHAR AS adopted_date, department FROM v_resolutions WHERE adopted_date IS NOT NULL", "resolutions",
)
query("A11_timeline_spending", lambda t: A.timeline_spending(t.expenditures), "SELECT year, quarter, coalesce(sum(ytd_expended)::DOUBLE, 0) AS ytd FROM v_expenditures WHERE year IS NOT NULL GROUP BY ALL", "expenditures")
query(
    "A12_table_grants", lambda t: A.table_grants(t.grants),
    f"SELECT id, grant_name, department, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, amount::DOUBLE AS amount, status FROM {grants('(SELECT * FROM v_grants ORDER BY start_date DESC NULLS LAST, id LIMIT 200)', order='start_date DESC NULLS LAST, id')}", "grants",
)
query("A13_table_spend_by_dept", lambda t: A.table_spend_by_dept(t.expenditures), "SELECT department, coalesce(sum(revised_budget)::DOUBLE, 0) AS budget, coalesce(sum(ytd_expended)::DOUBLE, 0) AS ytd FROM v_expenditures GROUP BY 1", "expenditures")
query("A14_table_reports", lambda t: A.table_reports(t.registry), "SELECT id, source_file, department, document_type, quarter, year FROM v_registry ORDER BY year DESC NULLS FIRST, quarter DESC NULLS FIRST, id LIMIT 200", "registry")
SPEND = f"SELECT {dk('department')} AS k, sum(revised_budget)::DOUBLE AS budget, sum(ytd_expended)::DOUBLE AS spend FROM ({LINES}) WHERE department IS NOT NULL GROUP BY 1"
query(
    "A15_departments", lambda t: A.departments(t.registry, t.expenditures),
    f"""SELECT d.dept_key, d.department, d.reports, coalesce(s.budget, 0) AS budget, coalesce(s.spend, 0) AS spend FROM (SELECT {dk('department')} AS dept_key, {label()} AS department, count(*) FILTER (WHERE document_type = 'quarterly_report') AS reports
  FROM v_registry WHERE document_type IN ('quarterly_report', 'budget') AND {dk('department')} <> '' GROUP BY 1) d LEFT JOIN ({SPEND}) s ON s.k = d.dept_key""", "registry", "expenditures",
)
query("A16_resolutions_list", lambda t: A.resolutions_list(t.resolutions), "SELECT id, resolution_number, title, amount::DOUBLE AS amount, vendor, department, adopted_date::VARCHAR AS adopted_date, status FROM v_resolutions", "resolutions")
query("A16_legislation_list", lambda t: A.legislation_list(t.legislation), "SELECT id, bill_number, amount::DOUBLE AS amount, adopted_date::VARCHAR AS adopted_date, status FROM v_legislation", "legislation")
query("A16_goals_list", lambda t: A.goals_list(t.goals), "SELECT id, department, goal_title, target, status, user_status, year, quarter FROM v_goals", "goals")
BUCKET = "CASE WHEN lower(trim(v.vote)) IN ('yea','yeas','yes','aye','ayes','y','for','in favor') THEN 'yea' WHEN lower(trim(v.vote)) IN ('nay','nays','no','noes','n','against') THEN 'nay' WHEN lower(trim(v.vote)) IN ('abstain','abstained','abstention','abstentions') THEN 'abstain' WHEN lower(trim(v.vote)) IN ('absent','away') THEN 'absent' ELSE 'other' END"
TALLY = ", ".join(f"count(*) FILTER (WHERE b = '{b}') AS {b}" for b in A.BUCKETS)
JOINED = f"SELECT v.*, r.id AS rid, r.title, r.amount, {BUCKET} AS b FROM v_votes v LEFT JOIN v_resolutions r ON v.resolution_number = r.resolution_number"
BY_NUMBER = f"SELECT coalesce(resolution_number, '—') AS number, arg_min(title, rid) AS title, arg_min(amount::DOUBLE, rid) AS amount, count(*) AS total, {TALLY}, string_agg(council_member || ':' || b, ',' ORDER BY council_member, b, id) AS members FROM ({JOINED}) GROUP BY 1"
query(
    "A17_votes_by_resolution", lambda t: A.votes_by_resolution(t.fixture_votes, t.fixture_resolutions),
    BY_NUMBER.replace("v_votes", "v_fixture_votes").replace("v_resolutions", "v_fixture_resolutions"), "fixture_votes", "fixture_resolutions",
)
query("A18_votes_by_member", lambda t: A.votes_by_member(t.votes, t.resolutions), f"SELECT council_member, count(*) AS total, {TALLY} FROM ({JOINED}) GROUP BY 1", "votes", "resolutions")
NONZERO = f"SELECT *, coalesce({dk('department')}, '') AS dept_key FROM ({LINES}) WHERE coalesce(revised_budget, 0) <> 0 OR coalesce(ytd_expended, 0) <> 0"
BUDGET = f"SELECT dept_key, first(department ORDER BY department IS NULL, ({pk('department')} <> {dk('department')}), -length(department), department) AS department, coalesce(sum(revised_budget)::DOUBLE, 0) AS budget, coalesce(sum(ytd_expended)::DOUBLE, 0) AS ytd FROM ({NONZERO}) GROUP BY 1"
query("A19_budget_by_dept", lambda t: A.budget_by_dept(t.expenditures), BUDGET, "expenditures")
query(
    "A20_budget_lines", lambda t: A.budget_lines(t.expenditures),
    f"SELECT l.id, l.dept_key, b.department, l.account_number, l.line_item, coalesce(l.revised_budget, 0)::DOUBLE AS budget, coalesce(l.ytd_expended, 0)::DOUBLE AS ytd FROM ({NONZERO}) l JOIN ({BUDGET}) b ON l.dept_key = b.dept_key", "expenditures",
)
as_text = lambda actions: F.array_join(F.transform(actions, lambda a: F.concat_ws(":", a["id"], a["line"], a["part"], a["item_type"], a["item_number"])), ",")
query(
    "A21_meetings", lambda t: A.meetings(t.meetings, t.meeting_actions, as_text).select("id", "meeting_date", "session_type", "actions"),
    "SELECT m.id, m.meeting_date::VARCHAR AS meeting_date, m.session_type, a.actions FROM v_meetings m LEFT JOIN (SELECT meeting_date, string_agg(concat_ws(':', id, line, part, item_type, item_number), ',' ORDER BY id, line, part, item_type, item_number) AS actions FROM v_meeting_actions GROUP BY 1) a ON m.meeting_date IS NOT DISTINCT FROM a.meeting_date", "meetings", "meeting_actions",
)
VAC = f"""SELECT id, dept_key, department, position_title AS title, status, open_count, year, quarter FROM (SELECT *, row_number() OVER (PARTITION BY dept_key, lower(trim(position_title)) ORDER BY coalesce(year, 0) DESC, coalesce(quarter, '') DESC, department, position_title, id) AS k
  FROM (SELECT *, {dk('department')} AS dept_key FROM v_vacancies WHERE lower(status) = 'open' AND department IS NOT NULL AND lower(position_title) NOT IN ('', 'none'))) WHERE k = 1"""
query("A22_vacancies_open", lambda t: A.vacancies_open(t.vacancies), VAC, "vacancies")
query(
    "A23_boards", lambda t: A.boards(t.boards, t.board_members, BOARDS_AS_OF),
    f"""SELECT b.board_name, b.total_seats AS seats, coalesce(m.filled, 0) AS filled, b.total_seats - coalesce(m.filled, 0) AS vacant, coalesce(m.ending, 0) AS ending FROM v_boards b LEFT JOIN
  (SELECT board_name, count(*) FILTER (WHERE trim(coalesce(member_name, '')) <> '') AS filled, count(*) FILTER (WHERE trim(coalesce(member_name, '')) <> '' AND term_expiration_date <= DATE '{BOARDS_AS_OF}' + 365) AS ending
   FROM v_board_members WHERE roster_year = (SELECT max(roster_year) FROM v_boards) GROUP BY 1) m ON b.board_name = m.board_name WHERE b.roster_year = (SELECT max(roster_year) FROM v_boards)""", "boards", "board_members",
)
query(
    "A24_metrics_latest", lambda t: A.metrics_latest(t.metrics),
    "SELECT department, metric_name, metric_value::DOUBLE AS value, year, quarter FROM (SELECT *, row_number() OVER (PARTITION BY department, metric_name ORDER BY year DESC NULLS LAST, quarter DESC NULLS LAST, id) AS k FROM v_metrics) WHERE k = 1", "metrics",
)
query(
    "A25_vendor_spend", lambda t: A.vendor_spend(t.resolutions),
    "SELECT vendor, sum(amount)::DOUBLE AS amount, count(*) AS n, string_agg(DISTINCT department, '|' ORDER BY department) AS departments FROM v_resolutions WHERE vendor <> '' AND amount IS NOT NULL GROUP BY 1", "resolutions",
)
query(
    "A26_authorized_vs_spent", lambda t: A.authorized_vs_spent(t.resolutions, t.expenditures),
    f"""SELECT dept_key, {label()} AS department, coalesce(sum(a)::DOUBLE, 0) AS authorized, coalesce(sum(s)::DOUBLE, 0) AS spent FROM (SELECT *, {dk('department')} AS dept_key FROM
  (SELECT department, amount AS a, NULL AS s FROM v_resolutions WHERE amount IS NOT NULL UNION ALL SELECT department, NULL, ytd_expended FROM ({LINES}))) WHERE dept_key <> '' GROUP BY 1""", "resolutions", "expenditures",
)
query(
    "A27_grants_expiring", lambda t: A.grants_expiring(t.grants, AS_OF).withColumn("days_left", F.col("days_left").cast("long")),
    f"SELECT id, grant_name, dept_key, end_date::VARCHAR AS end_date, (end_date - {D})::BIGINT AS days_left, amount::DOUBLE AS amount FROM {grants('(SELECT * FROM v_grants WHERE end_date IS NOT NULL)', ('amount', 'end_date'), 'end_date, id')} WHERE end_date BETWEEN {D} AND {D} + 180", "grants",
)
# each panel by the SQL of its own query; that of votes_by_resolution is over the numbers of A18's votes
PANELS = {
    "kpi_grants": "A4_kpi_grants", "kpi_spend": "A5_kpi_spend", "kpi_coverage": "A6_kpi_coverage", "kpi_counts": "A7_kpi_counts", "timeline_grants": "A8_timeline_grants", "timeline_reports": "A9_timeline_reports",
    "timeline_resolutions": "A10_timeline_resolutions", "timeline_spending": "A11_timeline_spending", "table_grants": "A12_table_grants", "table_spend_by_dept": "A13_table_spend_by_dept", "table_reports": "A14_table_reports",
    "departments": "A15_departments", "resolutions": "A16_resolutions_list", "legislation": "A16_legislation_list", "goals": "A16_goals_list", "votes_by_resolution": "A17_votes_by_resolution", "votes_by_member": "A18_votes_by_member",
    "budget_by_dept": "A19_budget_by_dept", "budget_lines": "A20_budget_lines", "meetings": "A21_meetings", "vacancies": "A22_vacancies_open", "boards": "A23_boards", "metrics": "A24_metrics_latest", "vendors": "A25_vendor_spend",
    "authorized_vs_spent": "A26_authorized_vs_spent", "grants_expiring": "A27_grants_expiring",
}
PANEL_SQL = SQL | {"A17_votes_by_resolution": with_views(BY_NUMBER, "votes", "resolutions")}


def built(t):
    """The status of each panel of a dashboard that has been made and written."""
    return A.build_dashboard(t.spark, A.dashboard(t, AS_OF, BOARDS_AS_OF), scratch_path(t.spark, "dashboard"), AS_OF)


query("A28_dashboard", built, " UNION ALL ".join(f"SELECT '{k}' AS panel, '{AS_OF}' AS generated_at, count(*) AS n_rows, NULL::VARCHAR AS error FROM ({PANEL_SQL[q]}) x" for k, q in PANELS.items()))

# Signals ------------------------------------------------------------------------------------------------------------

CP = "struct_pack(year := coalesce(year, 0), quarter := trim(coalesce(quarter, '')))"
PL = lambda p: f"CASE WHEN {p}.year = 0 THEN {p}.quarter ELSE trim({p}.quarter || ' ' || {p}.year) END"
GOALS = f"""+ g AS (SELECT *, {dk('department')} AS dept_key, {nt('goal_title')} AS title_key, {CP} AS p, trim(coalesce(nullif(user_status, ''), status, '')) AS eff FROM v_goals WHERE department IS NOT NULL AND goal_title IS NOT NULL AND dept_key <> '' AND title_key <> ''),
h AS (SELECT dept_key, title_key, count(DISTINCT p) AS n, bool_and(eff = '') AS silent, min(p) AS first, max(p) AS last, last(goal_title ORDER BY p, department, id) AS goal_title, last(eff ORDER BY p, department, id) AS eff, last(trim(coalesce(target, '')) ORDER BY p, department, id) AS target FROM g GROUP BY ALL),
n AS (SELECT {dk('department')} AS dept_key, {label()} AS department FROM v_goals WHERE department IS NOT NULL GROUP BY 1), f AS (SELECT h.*, n.department, (SELECT max({CP}) FROM v_goals) AS top, (h.n >= 2 AND h.silent) AS stalled FROM h JOIN n USING (dept_key))"""
TARGET = "CASE WHEN target <> '' THEN ' (target: ' || target || ')' ELSE '' END"
DONE = "regexp_matches(lower(eff), 'complete|done|achieved|finished|closed|met')"
Q1 = f"SELECT dept_key, department, 'goal_stalled' AS signal, 'highest' AS priority, '“' || goal_title || '” has appeared in ' || n || ' quarterly reports (' || {PL('first')} || '→' || {PL('last')} || ') with no status update — what progress has been made since ' || {PL('last')} || '?' AS question, n::VARCHAR AS evidence FROM f WHERE stalled"
Q2 = f"SELECT dept_key, department, 'goal_no_progress' AS signal, 'high' AS priority, department || '''s goal “' || goal_title || '”' || {TARGET} || ' has no progress reported for ' || {PL('last')} || '. What''s the current status?' AS question, target AS evidence FROM f WHERE NOT stalled AND last = top AND eff = ''"
Q3 = f"SELECT dept_key, department, 'goal_in_progress' AS signal, 'medium' AS priority, department || '''s goal “' || goal_title || '”' || {TARGET} || ' was reported “' || eff || '” as of ' || {PL('last')} || '. What progress has been made since?' AS question, eff AS evidence FROM f WHERE NOT stalled AND last = top AND eff <> '' AND NOT {DONE}"
query("Q1_goal_stalled", lambda t: Q.goal_stalled(t.goals), f"{GOALS} {Q1}", "goals")
query("Q2_goal_no_progress", lambda t: Q.goal_no_progress(t.goals), f"{GOALS} {Q2}", "goals")
query("Q3_goal_in_progress", lambda t: Q.goal_in_progress(t.goals), f"{GOALS} {Q3}", "goals")
Q4 = f"""SELECT dept_key, department, 'budget_pace' AS signal, 'high' AS priority, CASE WHEN pace > x * 1.5 THEN department || ' is at ' || pct || '% of its revised budget by ' || lbl || ' (≈' || xp || '% expected) — what''s driving the elevated spend?'
  ELSE department || ' has spent only ' || pct || '% of its revised budget by ' || lbl || ' (≈' || xp || '% expected) — why is spending behind pace?' END AS question, round_even(pace, 3)::VARCHAR AS evidence
  FROM (SELECT *, round_even(pace * 100, 0)::BIGINT AS pct, round_even(x * 100, 0)::BIGINT AS xp, quarter || ' ' || year AS lbl FROM (SELECT *, ytd / budget AS pace, CASE quarter WHEN 'Q1' THEN 0.25::DOUBLE WHEN 'Q2' THEN 0.5 WHEN 'Q3' THEN 0.75 WHEN 'Q4' THEN 1.0 END AS x FROM
  (SELECT {dk('department')} AS dept_key, {label()} AS department, sum(revised_budget)::DOUBLE AS budget, coalesce(sum(ytd_expended), 0)::DOUBLE AS ytd, any_value(year) AS year, any_value(trim(quarter)) AS quarter FROM ({LINES}) GROUP BY 1) WHERE budget > 0 AND dept_key <> '') WHERE pace > x * 1.5 OR pace < x * 0.5)"""
query("Q4_budget_pace", lambda t: Q.budget_pace(t.expenditures), Q4, "expenditures")
Q5 = f"""SELECT dept_key, department, 'vacancy' AS signal, 'medium' AS priority, department || ' reported ' || CASE WHEN total IS NOT NULL THEN total || ' open position' || CASE WHEN total = 1 THEN '' ELSE 's' END ELSE n || ' open role' || CASE WHEN n = 1 THEN '' ELSE 's' END END
  || ' in ' || {PL('last')} || ' (' || listing || '). What''s the current hiring status?' AS question, total::VARCHAR AS evidence FROM (SELECT v.dept_key, d.department, d.last, string_agg(trim(position_title) || CASE WHEN open_count <> 0 THEN ' (' || open_count || ')' ELSE '' END, ', ' ORDER BY id) AS listing, count(*) AS n, nullif(sum(open_count), 0) AS total
  FROM v JOIN (SELECT dept_key, max(p) AS last, {label()} AS department FROM v GROUP BY 1) d ON v.dept_key = d.dept_key AND v.p = d.last GROUP BY ALL)"""
V5 = f"v AS (SELECT *, {dk('department')} AS dept_key, {CP} AS p FROM v_vacancies WHERE lower(status) = 'open' AND lower(position_title) NOT IN ('', 'none'))"
query("Q5_vacancy", lambda t: Q.vacancy(t.vacancies), f"+ {V5} {Q5}", "vacancies")
Q6 = f"""SELECT g.dept_key, n.department, 'grant' AS signal, 'low' AS priority, n.department || '''s grant “' || grant_name || '”' || CASE WHEN amount IS NOT NULL THEN ' ($' || format('{{:,}}', round_even(amount::DOUBLE, 0)::BIGINT) || ')' ELSE '' END
  || ' was reported ' || coalesce(nullif(trim(status), ''), 'active') || '. What''s the current status / drawdown for next quarter?' AS question, grant_number AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY dept_key ORDER BY coalesce(amount, 0) DESC, id) AS k FROM gr) g JOIN (SELECT dept_key, {label()} AS department FROM gr GROUP BY 1) n ON g.dept_key = n.dept_key WHERE k <= 5"""
G6 = f"gr AS (SELECT *, {dk('department')} AS dept_key FROM v_grants WHERE department IS NOT NULL AND grant_name <> '' AND NOT regexp_matches(lower(status), 'closed|complete|expired|terminated|ended'))"
query("Q6_grant", lambda t: Q.grant(t.grants), f"+ {G6} {Q6}", "grants")
Q7 = f"""SELECT dept_key, department, 'quiet_department' AS signal, 'high' AS priority, department || ' hasn''t filed a quarterly report since ' || coalesce(nullif({PL('last')}, ''), 'the period on record') || ' (latest on record is ' || {PL('top')} || '). Please provide an update.' AS question, {PL('last')} AS evidence
  FROM (SELECT *, (SELECT max(p) FROM qd) AS top FROM (SELECT dept_key, max(p) AS last, {label()} AS department FROM qd GROUP BY 1)) WHERE last < top AND top.year <> 0"""
D7 = f"qd AS (SELECT *, {dk('department')} AS dept_key, {CP} AS p FROM v_registry WHERE document_type = 'quarterly_report' AND department <> '')"
query("Q7_quiet_department", lambda t: Q.quiet_department(t.registry), f"+ {D7} {Q7}", "registry")
ALL = f"{GOALS}, {V5}, {G6}, {D7}, fi AS ({Q1} UNION ALL {Q2} UNION ALL {Q3} UNION ALL {Q4} UNION ALL {Q5} UNION ALL {Q6} UNION ALL {Q7})"
SHEET = "SELECT dept_key, first(department) OVER w AS department, row_number() OVER w AS place, signal, priority, question FROM (SELECT *, CASE priority WHEN 'highest' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM fi) WINDOW w AS (PARTITION BY dept_key ORDER BY r, signal, question)"
SIGNALS = ("goals", "expenditures", "vacancies", "grants", "registry")
findings = lambda t: Q.all_findings(t.goals, t.expenditures, t.vacancies, t.grants, t.registry)
query("Q8_prep_sheet", lambda t: Q.prep_sheet(findings(t)), f"{ALL} {SHEET}", *SIGNALS)
query("Q9_question_text", lambda t: findings(t).groupBy("signal").agg(F.count("*").alias("n"), F.max(F.length("question")).cast("long").alias("longest")), f"{ALL} SELECT signal, count(*) AS n, max(length(question)) AS longest FROM fi GROUP BY 1", *SIGNALS)
query("Q10_questions_for_department", lambda t: Q.questions_for_department(findings(t), "Department of NATION_3"), f"{ALL} SELECT dept_key, department, count(*) AS n, sha256(string_agg(question, chr(10) ORDER BY place)) AS wording FROM ({SHEET}) WHERE dept_key = 'nation 3' GROUP BY ALL", *SIGNALS)

# Projects -----------------------------------------------------------------------------------------------------------

RES = "(SELECT * EXCLUDE (k) FROM (SELECT *, trim(coalesce(resolution_number, '')) AS number_key, row_number() OVER (PARTITION BY trim(coalesce(resolution_number, '')) ORDER BY id) AS k FROM v_resolutions) WHERE k = 1 OR number_key = '')"
PG = f"""SELECT 'grant-' || id AS project, 'grant' AS type, trim(grant_name) AS title, department, amount::DOUBLE AS amount, CASE lower(trim(coalesce(status, ''))) WHEN 'active' THEN 'Active' WHEN 'awarded' THEN 'Awarded' WHEN 'applied' THEN 'Proposed' WHEN 'pending' THEN 'Proposed' WHEN 'closed' THEN 'Closed' ELSE 'Active' END AS status,
  coalesce(end_date BETWEEN {D} AND {D} + 120, false) AS attention, NULL::VARCHAR AS group_key FROM {grants()} WHERE title_key <> ''"""
TYPE = "CASE WHEN regexp_matches(lower(title), 'land development|subdivision|zoning|plat|rezon') THEN 'land_development' WHEN regexp_matches(lower(title), 'grant') THEN 'grant_action' WHEN regexp_matches(lower(title), 'agreement|contract|professional services|purchase|negotiat|lease') THEN 'contract' WHEN regexp_matches(lower(title), 'budget|appropriat|millage|\\btax\\b') THEN 'budget' WHEN regexp_matches(lower(title), 'appoint|reappoint|resign|confirm') THEN 'appointment' ELSE 'other' END"
RSTATUS = "CASE WHEN regexp_matches(lower(status), 'tabl') THEN 'Stalled' WHEN regexp_matches(lower(status), 'fail|defeat|reject') THEN 'Closed' WHEN regexp_matches(lower(status), 'pass|adopt|approv|ratif') THEN 'Active' ELSE 'Proposed' END"
PARTY = "trim(regexp_replace(regexp_replace(lower(vendor), '[,.]?\\s*\\b(llc|l\\.l\\.c|inc|incorporated|co|company|corp|corporation|lp|llp|pllc)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
PR = f"SELECT 'resolution-' || id AS project, {TYPE} AS type, trim(title) AS title, department, amount::DOUBLE AS amount, {RSTATUS} AS status, {RSTATUS} = 'Stalled' AS attention, CASE WHEN vendor <> '' THEN {PARTY} || '|' || {TYPE} END AS group_key FROM {RES} WHERE trim(title) <> ''"
PP = f"SELECT *, type IN ('budget', 'appointment') AS administrative FROM ({PG} UNION ALL {PR})"
both = lambda t: J.projects(t.grants, t.resolutions, AS_OF)
query("J1_dedupe_resolutions", lambda t: J.dedupe_resolutions(t.resolutions).select("id", "number_key"), f"SELECT id, number_key FROM {RES}", "resolutions")
query("J2_grant_projects", lambda t: J.grant_projects(t.grants, AS_OF), PG, "grants")
query("J3_resolution_projects", lambda t: J.resolution_projects(t.resolutions), PR, "resolutions")
query("J4_projects", both, PP, "grants", "resolutions")
query(
    "J5_project_counts", lambda t: J.project_counts(both(t)),
    f"SELECT type, count(*) AS n, count(*) FILTER (WHERE status = 'Active') AS active, count(*) FILTER (WHERE attention) AS attention, coalesce(sum(amount::DECIMAL(18,2)) FILTER (WHERE status IN ('Active', 'Awarded', 'Proposed'))::DOUBLE, 0) AS in_flight FROM ({PP}) WHERE NOT administrative GROUP BY 1", "grants", "resolutions",
)
query(
    "J6_project_groups", lambda t: J.project_groups(both(t)),
    f"""+ p AS (SELECT *, {dk('department')} AS dept_key FROM ({PP}) WHERE group_key IS NOT NULL AND NOT administrative), c AS (SELECT dept_key, group_key, first(status ORDER BY k DESC, status) AS usual FROM (SELECT dept_key, group_key, status, count(*) AS k FROM p GROUP BY ALL) GROUP BY ALL)
  SELECT g.dept_key, g.group_key, n, amount, CASE WHEN any_active THEN 'Active' ELSE usual END AS status, attention FROM (SELECT dept_key, group_key, count(*) AS n, sum(amount::DECIMAL(18,2))::DOUBLE AS amount, bool_or(status = 'Active') AS any_active, bool_or(attention) AS attention FROM p GROUP BY ALL HAVING count(*) >= 2) g JOIN c ON g.dept_key = c.dept_key AND g.group_key = c.group_key""",
    "grants", "resolutions",
)

# Reports ------------------------------------------------------------------------------------------------------------

_price = lambda b, other: f"CASE model WHEN 'model-b' THEN {b} ELSE {other} END"
COST = f"SELECT *, (round_even((coalesce(input_tokens, 0) * {_price(100, 300)} + coalesce(output_tokens, 0) * {_price(500, 1500)} + coalesce(cache_read_tokens, 0) * {_price(10, 30)} + coalesce(cache_write_tokens, 0) * {_price(125, 375)}) / 100, 0) / 1e6)::DECIMAL(12,6) AS cost FROM v_llm_usage"
SPAN = ("2024-01-02", "2024-01-20")
IN = f"timestamp >= TIMESTAMP '{SPAN[0]}' AND timestamp < TIMESTAMP '{SPAN[1]}'"
costs = lambda t: M.usage_cost(t.llm_usage)
query("M1_usage_cost", lambda t: costs(t).select("id", "model", "cost"), f"SELECT id, model, cost::DOUBLE AS cost FROM ({COST})", "llm_usage")
query("M2_usage_report", lambda t: M.usage_report(costs(t), *SPAN), "SELECT call_site, model, count(*) AS calls, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in M.TOKENS) + f", sum(cost)::DOUBLE AS cost FROM ({COST}) WHERE {IN} GROUP BY ALL", "llm_usage")
query("M3_usage_total", lambda t: M.usage_total(costs(t), *SPAN), f"SELECT coalesce(call_site, '(all)') AS call_site, count(*) AS calls, coalesce(sum(cost)::DOUBLE, 0) AS cost FROM ({COST}) WHERE {IN} GROUP BY ROLLUP (call_site)", "llm_usage")
#: Of M4, the SQL and its view: running prefixes in order.
M4 = (
    """SELECT chunk_id, count(*) AS retrieved, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad, bool_or(k >= 5 AND g / k * 5 < 2.5) AS flagged, CASE WHEN count(*) >= 5 THEN round_even(count(*) FILTER (WHERE good) / count(*) * 5, 2) END AS score
  FROM (SELECT *, count(*) OVER w AS k, count(*) FILTER (WHERE good) OVER w AS g FROM v_judgements WINDOW w AS (PARTITION BY chunk_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", "judgements",
)
query("M4_chunk_performance", lambda t: M.chunk_performance(t.judgements), *M4)
low = lambda t: M.low_scoring(t.query_scores.withColumn("retrieval", F.col("retrieval")), 2.0, "2026-06-01")
LOW = "retrieval < 2 OR accuracy < 2 OR (completeness < 2 AND asked >= DATE '2026-03-01')"
query("M5_low_scoring", lambda t: low(t).select("query_id", "store", "asked"), f"SELECT query_id, store, asked::VARCHAR AS asked FROM v_query_scores WHERE {LOW}", "query_scores")
query("M6_failures_by_store", lambda t: M.failures_by_store(low(t)), f"SELECT coalesce(store, 'unknown') AS store, count(*) AS n FROM v_query_scores WHERE {LOW} GROUP BY 1", "query_scores")
EV = "SELECT *, (retrieval + accuracy + completeness)::DOUBLE / 3 AS m FROM v_query_scores"
query("M7_eval_score", lambda t: M.eval_score(t.query_scores).select("query_id", "mean", "passed"), f"SELECT query_id, round_even(m, 4) AS mean, m >= 3.0 AS passed FROM ({EV})", "query_scores")
query(
    "M8_eval_report", lambda t: M.eval_report(t.query_scores),
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE m >= 3) AS passed, count(*) FILTER (WHERE m < 3) AS failed, round_even(count(*) FILTER (WHERE m >= 3) * 100 / count(*), 0) / 100 AS pass_rate, round_even(avg(retrieval::DOUBLE), 2) AS avg_retrieval, round_even(avg(accuracy::DOUBLE), 2) AS avg_accuracy, round_even(avg(completeness::DOUBLE), 2) AS avg_completeness,
  (SELECT string_agg(query_id || ' R:' || retrieval::DOUBLE || ' A:' || accuracy::DOUBLE || ' C:' || completeness::DOUBLE, ',' ORDER BY query_id) FROM (SELECT * FROM ({EV}) WHERE m < 3 ORDER BY query_id LIMIT 10)) AS first_failures FROM ({EV})""", "query_scores",
)
query("M9_last_run", lambda t: M.last_run(t.query_scores), "SELECT run_id, asked::VARCHAR AS run_date, count(*) AS total, count(*) FILTER (WHERE m >= 3) AS passed, " + ", ".join(f"sum({c})::DOUBLE / count({c}) AS avg_{c}" for c in ("retrieval", "accuracy", "completeness")) + f" FROM ({EV}) GROUP BY run_id, asked ORDER BY asked DESC, run_id DESC LIMIT 1", "query_scores")
query("M10_review_queue", lambda t: M.review_queue(t.review_flags).drop("newest"), "SELECT stage, count(*) AS n, last(source_file ORDER BY created_at, id) AS newest_file FROM v_review_flags WHERE NOT resolved GROUP BY 1", "review_flags")
PROPOSED = "SELECT event_id AS id, 'type_' || (user_id % 7) AS proposed_type, CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'approved' END AS status, ts AS created_at FROM {events} WHERE event_type = 'error'"
proposals = lambda t: t.spark.sql(PROPOSED, events=t.events)
query("M11_pending_proposals", lambda t: M.pending_proposals(proposals(t)).select("id", "proposed_type"), f"SELECT id, proposed_type FROM ({PROPOSED.format(events='events')}) WHERE status = 'pending'")
query("M12_stats", lambda t: M.stats(t.registry, t.query_scores, M.chunk_performance(t.judgements)), "SELECT (SELECT count(*) FROM v_registry) AS documents, (SELECT count(*) FROM v_query_scores) AS queries, (SELECT count(DISTINCT chunk_id) FROM (SELECT *, count(*) OVER w AS k, count(*) FILTER (WHERE good) OVER w AS g FROM v_judgements WINDOW w AS (PARTITION BY chunk_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE k >= 5 AND g / k * 5 < 2.5) AS flagged_chunks", "registry", "query_scores", "judgements")
query("M13_sample_queries", lambda t: M.sample_queries(t.query_scores, 0.1).select("query_id"), f"SELECT query_id FROM v_query_scores WHERE left(md5(query_id::VARCHAR), 8) < '{int(0.1 * 16**8):08x}'", "query_scores")
query(
    "M14_vote_counts", lambda t: M.vote_counts(t.votes, t.resolutions, t.registry, "reports - 1995%"),
    "SELECT 'votes' AS what, coalesce(resolution_number, '—') AS key, count(*) AS n FROM v_votes GROUP BY ALL UNION ALL SELECT 'amounts', '', count(amount) FROM v_resolutions UNION ALL SELECT 'readers', parser_used, count(*) FROM v_registry WHERE source_file ILIKE 'Reports - 1995%' GROUP BY ALL", "votes", "resolutions", "registry",
)
HAVE = f"SELECT DISTINCT {dk('department')} AS dept_key, year, quarter FROM v_registry WHERE document_type = 'quarterly_report' AND year IS NOT NULL AND quarter <> ''"
query("M15_coverage_gap", lambda t: M.coverage_gap(t.registry), f"+ h AS ({HAVE}) SELECT d.dept_key, p.year, p.quarter FROM (SELECT DISTINCT dept_key FROM h) d, (SELECT DISTINCT year, quarter FROM h) p EXCEPT SELECT dept_key, year, quarter FROM h", "registry")


def facts(t):
    got = M.unpivoted(t.resolutions, "resolutions", ["resolution_number", "vendor", "status"])
    want = M.unpivoted(t.resolutions.withColumn("status", F.lit("Passed")), "resolutions", ["resolution_number", "status"])
    return M.hard_fact_check(got, want).groupBy("field").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


query("M16_hard_fact_check", facts, "SELECT 'resolution_number' AS field, count(*) AS n, count(*) AS ok FROM v_resolutions UNION ALL SELECT 'status', count(*), count(*) FILTER (WHERE status = 'Passed') FROM v_resolutions", "resolutions")

# Questions ----------------------------------------------------------------------------------------------------------

ITEM = "SELECT year, quarter, sum(ytd_expended)::DOUBLE AS ytd, sum(revised_budget)::DOUBLE AS budget FROM v_expenditures WHERE line_item ILIKE 'Item 7'"
query("U1_line_item_ytd", lambda t: U.line_item_spend(t.expenditures, "Item 7", 1995, "Q2"), f"{ITEM} AND year = 1995 AND quarter = 'Q2' GROUP BY ALL", "expenditures")
query("U2_line_item_budget", lambda t: U.line_item_spend(t.expenditures, "Item 7"), f"{ITEM} GROUP BY ALL", "expenditures")
query("U3_top_spender", lambda t: U.top_spender(t.expenditures), f"SELECT {dk('department')} AS dept_key, sum(ytd_expended)::DOUBLE AS ytd FROM v_expenditures GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "expenditures")
TOTALS = f"SELECT {dk('department')} AS dept_key, sum(revised_budget)::DOUBLE AS budget, sum(ytd_expended)::DOUBLE AS ytd FROM ({LINES}) GROUP BY 1"
query("U4_department_totals", lambda t: U.department_totals(t.expenditures), TOTALS, "expenditures")
query("U5_metric_total", lambda t: U.metric_total(t.metrics, "CLICK", year=2021), "SELECT department, year, quarter, sum(metric_value)::DOUBLE AS total, count(*) AS n FROM v_metrics WHERE metric_name ILIKE '%click%' AND year = 2021 GROUP BY ALL", "metrics")
query("U6_grants_of", lambda t: U.grants_of(t.grants, "Bureau of NATION_3"), f"SELECT id, dept_key, grant_name, start_date::VARCHAR AS start_date, amount::DOUBLE AS amount FROM {grants()} WHERE dept_key = 'nation 3'", "grants")
POS = f"SELECT dept_key, count(*) AS positions, sum(open_count)::BIGINT AS open_count FROM ({VAC}) GROUP BY 1"
query("U7_vacancies_of", lambda t: U.vacancies_of(t.vacancies), POS, "vacancies")
query("U8_most_vacancies", lambda t: U.most_vacancies(t.vacancies), f"{POS} ORDER BY 2 DESC, 1 LIMIT 1", "vacancies")
query("U9_total_grants", lambda t: U.total_grants(t.grants), f"SELECT sum(amount)::DOUBLE AS amount, count(*) AS n FROM {grants()}", "grants")
query("U10_vacancies_and_projects", lambda t: U.vacancies_and_projects(t.vacancies, t.projects), f"SELECT dept_key FROM ({VAC}) INTERSECT SELECT {dk('department')} FROM v_projects", "vacancies", "projects")
WHO = lambda rel: f"(SELECT name, {dk('department')} AS k FROM v_persons WHERE rel = '{rel}')"
query(
    "U11_top_spender_director", lambda t: U.top_spender_director(t.expenditures, all_edges(t), "Item 7"),
    f"SELECT s.dept_key, s.ytd, w.name AS director FROM (SELECT {dk('department')} AS dept_key, sum(ytd_expended)::DOUBLE AS ytd FROM v_expenditures WHERE line_item ILIKE 'Item 7' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) s LEFT JOIN {WHO('DIRECTS')} w ON w.k = s.dept_key", "expenditures", "persons",
)
query("U12_leaders_and_spend", lambda t: U.leaders_and_spend(t.expenditures, all_edges(t)), f"SELECT s.dept_key, w.name AS leader, s.ytd FROM ({TOTALS}) s JOIN {WHO('DIRECTS')} w ON w.k = s.dept_key", "expenditures", "persons")
query("U12_grants_and_managers", lambda t: U.grants_and_managers(t.grants, all_edges(t)), f"SELECT g.dept_key, w.name AS manager, g.amount FROM (SELECT dept_key, sum(amount)::DOUBLE AS amount FROM {grants()} GROUP BY 1) g JOIN {WHO('MANAGES')} w ON w.k = g.dept_key", "grants", "persons")
query("U13_metric_and_budget", lambda t: U.metric_and_budget(t.metrics, t.expenditures, "error"), f"SELECT m.*, p.budget, p.ytd FROM (SELECT {dk('department')} AS dept_key, sum(metric_value)::DOUBLE AS total FROM v_metrics WHERE metric_name ILIKE '%error%' GROUP BY 1) m JOIN ({TOTALS}) p ON p.dept_key = m.dept_key", "metrics", "expenditures")
query("U14_staff", lambda t: U.staff(all_edges(t)), "SELECT department, name AS person, lower(rel) AS role FROM v_persons WHERE rel IN ('DIRECTS', 'MANAGES')", "persons")
