"""Small cases of operators: first-seen rules, sticky states, edge rows."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import corpus as C
from ledgerline.operators import graph as G
from ledgerline.operators import panels as A
from ledgerline.operators import reports as M
from ledgerline.operators import retrieval as R
from ledgerline.operators import writes as S
from ledgerline.plans import registry, stores  # noqa: F401  stores registers T3
from ledgerline.streaming import jobs

GRANT = "id long, department string, grant_name string, grant_number string, amount decimal(15,2), start_date date, end_date date, status string"


def test_grants_keep_the_most_complete_row(spark):
    day = datetime.date(2026, 1, 1)
    rows = [
        (1, "Police", "COPS  Grant", None, None, None, None, None), (2, "Bureau of Police", "cops grant", None, Decimal(5), day, None, "active"), (3, "Police", "Cops Grant", None, Decimal(9), day, None, "Active"),
        (4, "Fire", "", None, None, None, None, None), (5, "Fire", None, None, None, None, None, None),
    ]
    got = A.dedupe_grants(spark.createDataFrame(rows, GRANT)).orderBy("id").collect()
    assert [r.id for r in got] == [3, 4, 5] or [r.id for r in got] == [2, 4, 5]


def test_boards_without_tables(spark):
    assert A.boards(None, None, "2026-06-01").columns == ["board_name", "seats", "filled", "vacant", "ending"]


def test_leap_year_end(spark):
    rows = [(1, "A", "g", None, None, datetime.date(2024, 2, 29), None, None)]
    assert A.timeline_grants(spark.createDataFrame(rows, GRANT)).first().end_date == datetime.date(2025, 2, 28)


def test_character_budget(spark):
    rows = spark.createDataFrame([("f", i, "x" * 10) for i in range(4)], "source_file string, seq int, text string")
    assert [r.batch for r in C.pack_char_budget(rows, 25).orderBy("seq").collect()] == [0, 0, 1, 1]


def elements(spark, rows):
    return spark.createDataFrame([("f", i, 1, k, t) for i, (k, t) in enumerate(rows)], "source_file string, elem_idx int, page_number int, element_type string, text string")


def test_keep_together(spark):
    rows = [("Text", "WHEREAS one " + "a" * 60), ("Text", "RESOLVED that " + "b" * 60), ("Text", "Whereas two " + "c" * 60), ("Text", "whereas three"), ("Text", "resolved " + "d" * 60)]
    got = C.chunk_keep_together(elements(spark, rows), ["whereas", "resolved"]).orderBy("seq").collect()
    assert [r.text.split()[1] for r in got] == ["one", "two"] and "three" in got[1].text


def test_section_chunks(spark):
    body = "word " * 60
    rows = [("Title", "Budget section"), ("NarrativeText", body), ("Table", "t" * 2000), ("NarrativeText", body), ("Title", "Next"), ("NarrativeText", "short")]
    got = C.chunk_sections(elements(spark, rows)).orderBy("seq").collect()
    assert [r.element_type for r in got] == ["Title", "Table", "NarrativeText", "Title"]
    assert got[1].text == "t" * 2000, "tables are not cut"
    assert got[2].text.startswith(got[0].text[-100:].strip()[:50]), "the tail goes on after a table"
    assert all(len(r.text) >= 100 for r in got)


def test_section_chunks_split_long_text(spark):
    rows = [("NarrativeText", f"{i} " + "x" * 400) for i in range(10)]
    got = C.chunk_sections(elements(spark, rows)).orderBy("seq").collect()
    assert all(len(r.text) <= 1500 + 102 for r in got) and len(got) > 2
    assert all(f"\n\n{i} x" in "\n\n" + "\n\n".join(r.text for r in got) for i in range(10))


def test_fixed_window_chunks(spark):
    got = C.chunk_pages(elements(spark, [("Text", "y" * 90), ("Title", "T" * 90)])).collect()
    assert len(got) == 1 and got[0].section == "T" * 80


def test_responses(spark):
    raw = 'text {"votes": [{"member": "A", "confidence": "High"}, {"member": null, "confidence": "high"}, {"member": "B", "confidence": "low"}]} tail'
    rows = spark.createDataFrame([("r", 1, raw), ("r", 2, "none"), ("r", 3, None)], "report_id string, batch_id int, raw string")
    assert [r.member for r in C.parse_response(rows, "votes", "member: string", ["member"]).collect()] == ["A"]


@pytest.mark.parametrize(("number", "bad"), [("12-2026", False), ("2026-2026", True), ("x", True), (None, True)])
def test_resolution_numbers(spark, number, bad):
    res = spark.createDataFrame([("f", number)], "source_file string, resolution_number string")
    votes = spark.createDataFrame([], "source_file string")
    assert (C.validate_resolution(res, votes, res.select("source_file")).count() > 0) == bad


def test_specs(spark):
    rows = [("good", 1, "name", "TEXT"), ("good", 2, "name", "DATE"), ("good", 3, "id", "INTEGER"), ("good", 4, "9x", "TEXT"), ("good", 5, "price", "MONEY"), ("select", 6, "a", "TEXT")]
    got = C.check_specs(spark.createDataFrame(rows, "table string, seq int, column string, type string")).orderBy("seq").collect()
    assert [r.problem for r in got] == [None, "repeated column", "managed column", "bad column name", "bad type", "bad table name"]


def test_prices(spark):
    rows = [(1, "model-a", 1_000_000, 1_000_000, 0, 0), (2, "model-b", 1_000_000, 500_000, 500_000, 400_000), (3, "other", 1_000_000, 0, 0, 0)]
    got = M.usage_cost(spark.createDataFrame(rows, "id int, model string, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int")).orderBy("id").collect()
    assert [float(r.cost) for r in got] == [18.0, 4.05, 3.0]


def test_flag_is_sticky(spark):
    rows = [(1, i, i > 4) for i in range(40)]
    got = M.chunk_performance(spark.createDataFrame(rows, "chunk_id long, seq long, good boolean")).first()
    assert got.flagged and got.score > 2.5


def test_status_is_carried_once(spark):
    kind = "id long, department string, year int, quarter string, goal_title string, user_status string"
    old = spark.createDataFrame([(1, "A", 2026, "Q1", "g", "completed"), (2, "A", 2026, "Q1", "gone", "in_progress")], kind)
    fresh = spark.createDataFrame([(5, "A", 2026, "Q1", "g", None), (6, "A", 2026, "Q1", "g", None)], kind)
    out, left = S.carry_user_status(old, fresh)
    assert [r.user_status for r in out.orderBy("id").collect()] == ["completed", None]
    assert [r.goal_title for r in left.collect()] == ["gone"]


def test_deleting_a_document_leaves_no_orphans(spark):
    chunks = spark.createDataFrame([("c1", "a.pdf"), ("c2", "b.pdf")], "chunk_id string, source_file string")
    edges = spark.createDataFrame([("Chunk", "c1", "Department", "D"), ("Chunk", "c2", "Department", "D"), ("Department", "D", "Document", "a.pdf")], "src_label string, src string, dst_label string, dst string")
    assert [r.src for r in S.delete_document({"chunks": chunks}, "a.pdf", edges)["edges"].collect()] == ["c2"]


def test_last_node_wins(spark):
    nodes = spark.createDataFrame([("a", "old"), ("b", "old")], "name string, p string")
    batch = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "z", 3), ("", "z", 4)], "name string, p string, seq int")
    assert sorted(tuple(r) for r in G.merge_nodes(nodes, batch, "name", "seq").collect()) == [("a", "y"), ("b", "old")]


def test_zero_vectors_score_nothing(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<float>")
    c = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>")
    assert [tuple(r) for r in R.vector_topk(q, c).select("query_id", "chunk_id", "score").collect()] == [("q", "a", 1.0)]


def test_named_files(spark, tmp_path):
    for n in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    have = spark.createDataFrame([("a.pdf",)], "source_file string")
    assert [r.source_file for r in S.new_files(S.listed_files(spark, str(tmp_path)), have).collect()] == ["b.pdf"]


def daily(costs):
    rows = costs.groupBy(F.date_trunc("day", "timestamp").alias("day"), "call_site").agg(F.count("*").alias("calls"), F.sum("cost").cast("double").alias("cost"))
    return sorted(str(tuple(r)) for r in rows.select(F.col("day").cast("string"), "call_site", "calls", "cost").collect())


def test_usage_stream_has_every_day(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("call_site"), F.lit("model-a").alias("model"), (F.col("event_id") % 4000).alias("input_tokens"))
    costs = M.usage_cost(events.select("*", *(F.lit(0).alias(c) for c in M.TOKENS[1:])))
    assert sorted(str(tuple(r)) for r in registry.QUERIES["T3_stream_usage_cost"](spark, sf).select("day", "call_site", "calls", "cost").collect()) == daily(costs)


def test_usage_stream_over_several_runs(spark, tmp_path):
    schema = "timestamp timestamp, call_site string, model string, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int"
    at = lambda day, hour: datetime.datetime(2026, 6, day, hour)
    for rows in ([(at(20, 9), "a", "model-a", 7, 1, 0, 0), (at(20, 23), None, "model-b", 5, 0, 2, 3)], [(at(2, 1), "a", "model-a", 9, None, 1, 0), (at(20, 10), "a", "model-x", 1, 1, 1, 1), (at(21, 0), "b", "model-a", 4, 4, 4, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.stream_usage_cost(source, f"{tmp_path}/state", f"{tmp_path}/out").awaitTermination()
    got = jobs.usage_by_day(spark, f"{tmp_path}/out").select(F.col("day").cast("string"), "call_site", "calls", "cost")
    assert sorted(str(tuple(r)) for r in got.collect()) == daily(M.usage_cost(spark.read.parquet(f"{tmp_path}/in")))


def test_coverage_ignores_reports_without_a_period(spark):
    rows = [("Parks", "quarterly_report", 2026, "Q1"), ("Works", "quarterly_report", 2026, ""), ("Codes", "quarterly_report", 2025, None), ("Fire", "budget", 2026, "Q1")]
    got = A.kpi_coverage(spark.createDataFrame(rows, "department string, document_type string, year int, quarter string")).first()
    assert (got.roster, got.filed) == (1, 1)


GOAL = "id long, department string, year int, quarter string, goal_title string, user_status string, user_status_at string"


def test_status_is_carried_once_to_the_same_goal(spark):
    key = ("Parks", 2026, None, "Trees")
    old = spark.createDataFrame([(1, *key, "in_progress", "t1"), (2, *key, "completed", "t2"), (3, *key, None, None), (4, "Parks", 2026, "Q1", "Gone", "completed", "t3")], GOAL)
    fresh = spark.createDataFrame([(11, *key, None, None), (12, *key, "in_progress", "own"), (13, "Parks", 2026, "Q1", "Trees", None, None)], GOAL)
    out, left = S.carry_user_status(old, fresh)
    assert sorted((r.id, r.user_status, r.user_status_at) for r in out.collect()) == [(11, "completed", "t2"), (12, "in_progress", "own"), (13, None, None)]
    assert out.columns == fresh.columns and [r.id for r in left.collect()] == [4]


def test_long_sections_are_cut_between_paragraphs(spark):
    para = [f"{i} " + "x" * 600 for i in range(4)]
    rows = [("a", 0, 1, "Title", "Budget"), ("a", 1, 1, "NarrativeText", "\n\n".join(para)), ("a", 2, 1, "Table", "t" * 2000), ("a", 3, 2, "NarrativeText", "after the table")]
    df = spark.createDataFrame(rows, "source_file string, elem_idx int, page_number int, element_type string, text string")
    got = [(r.seq, r.section, r.element_type, r.text) for r in C.chunk_sections(df).orderBy("seq").collect()]
    one = f"Budget\n\n{para[0]}\n\n{para[1]}"
    two = f"{one[-100:]}\n\n{para[2]}\n\n{para[3]}"
    assert got == [(0, "Budget", "Title", one), (1, "Budget", "Title", two), (2, "Budget", "Table", "t" * 2000), (3, "Budget", "NarrativeText", f"{two[-100:]}\n\nafter the table")]


def test_batches_over_several_runs(spark):
    rows = [("f", i, "x" * (i * 37 % 900)) for i in range(700)]
    got = {r.seq: r.batch for r in C.pack_char_budget(spark.createDataFrame(rows, "source_file string, seq int, text string"), 2000).collect()}
    used = batch = 0
    for _, i, t in rows:
        if used and used + len(t) > 2000:
            batch, used = batch + 1, 0
        used += len(t)
        assert got[i] == batch


def test_last_row_of_a_chunk_wins(spark):
    old = spark.createDataFrame([("a", [1.0], "old", "{}")], "chunk_id string, embedding array<float>, text string, payload string")
    batch = spark.createDataFrame([("a", [1.0], "x", 1, "p"), ("a", [1.0], "y", 2, "q"), ("b", None, "z", 3, "r")], "chunk_id string, embedding array<float>, text string, seq int, dept string")
    assert [tuple(r) for r in S.upsert_chunks(old, batch).select("chunk_id", "text", "payload").collect()] == [("a", "y", '{"dept":"q"}')]


def test_citations_of_bare_chunks(spark):
    bare = spark.createDataFrame([("q", "a", None, "")], "query_id string, chunk_id string, source_file string, department string")
    assert R.citations(bare).first().asDict() == {"query_id": "q", "chunk_id": "a", "source_file": "unknown", "department": None, "section": None, "quarter": None, "year": None}


@pytest.mark.parametrize("table", S.COLUMNS)
def test_typed_appends_fill_what_is_missing(spark, table):
    rows = spark.createDataFrame([("f", "2026", " ", "p" * 300, 4, "x")], "source_file string, adopted_date string, vote string, department string, count int, other string")
    rows = rows.withColumns({c: F.col("adopted_date") for c in ("start_date", "end_date", "meeting_date")})
    got = S.typed_append(table, rows, source_chunk_id="c").first().asDict()
    names = [c.split()[0] for c in S.COLUMNS[table].replace("(15,2)", "").split(", ")]
    assert list(got) == [*names, "source_chunk_id", "source_file"] and (got.pop("source_chunk_id"), got.pop("source_file")) == ("c", "f")
    if "department" in got:
        assert len(got.pop("department")) == (300 if table == "goals" else 100)
    assert got.pop("open_count", 4) == 4 and not any(v is not None for v in got.values())


def test_files_are_listed_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("in/b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert sorted((r.source_file, r.length) for r in S.listed_files(spark, str(tmp_path)).collect()) == [("a.pdf", 3), ("b.pdf", 3)]


def closure(edges):
    out = {}
    for start in {a for a, _ in edges}:
        level, n = {start}, 0
        while level:
            n += 1
            level = {b for a, b in edges if a in level} - {b for p, b in out if p == start}
            out |= {(start, b): n for b in level}
    return out


def test_chains_of_any_length_and_cycles(spark):
    edges = {(f"p{i}", f"p{i + 1}") for i in range(40)} | {("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "x"), ("p3", "c")}
    rows = [("REPORTS_TO", a, b) for a, b in edges] + [("REPORTS_TO", "a", "b"), ("DIRECTS", "q", "r"), ("REPORTS_TO", None, "a"), ("REPORTS_TO", "a", None)]
    got = G.reports_to_chain(spark.createDataFrame(rows, "rel string, src string, dst string")).collect()
    assert {(r.person, r.boss): r.steps for r in got} == closure(edges) and len(got) == len(closure(edges))
    assert {r.person for r in got if r.cycle} == {"a", "b", "c", "x"}
    assert G.reports_to_chain(spark.createDataFrame([], "rel string, src string, dst string")).count() == 0


def test_character_budget_of_a_very_long_file(spark):
    rows = spark.range(400_000).selectExpr("if(id % 4 = 0, 'small', 'big') as source_file", "id as seq", "repeat('x', cast(id * 7919 % 97 as int)) as text")
    got = C.pack_char_budget(rows.repartition(7), 1000).groupBy("source_file").agg(F.max("batch").alias("last"), F.count("*").alias("n")).collect()
    want = {}
    for i in range(400_000):
        file, n = "small" if i % 4 == 0 else "big", i * 7919 % 97
        number, used = want.get(file, (0, 0))
        number, used = (number + 1, 0) if used > 0 and used + n > 1000 else (number, used)
        want[file] = number, used + n
    assert {r.source_file: r.last for r in got} == {k: v[0] for k, v in want.items()} and sum(r.n for r in got) == 400_000


def most_rows(df, kind):
    """The rows that come out of the largest operator of a kind when df is computed."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(plan.plan())
        if kind in name:
            yield plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_requests_meet_the_first_chunks_of_their_names_alone(spark):
    asked = spark.createDataFrame([(f"q{i}", name) for i in range(20) for name in ("park", "road")], "query_id string, value string")
    said = spark.createDataFrame([("MENTIONS", f"c{i:03}", "park" if i % 2 else "road") for i in range(400)] + [("MENTIONS", "c000", "park"), ("MENTIONS", "c001", "park")], "rel string, src string, dst string")
    out = R.entity_chunks(asked, said)
    assert most_rows(out, "Join") <= 20 * 2 * 5
    got = sorted((r.query_id, r.rank, r.chunk_id) for r in out.collect())
    assert got == sorted((f"q{i}", k + 1, f"c{k:03}") for i in range(20) for k in range(5))


def test_chunks_of_one_file_are_not_compared_by_edge(spark):
    chunks = spark.createDataFrame([(f"c{i}", "a") for i in range(50)] * 2 + [("c0", "b"), ("c0", None), ("c99", "none"), (None, "b")], "chunk_id string, source_file string")
    names = spark.createDataFrame([("a", "Department", f"d{i}") for i in range(9)] * 3 + [("b", "Department", "d1"), ("b", "Department", "d9"), ("b", "Department", "unknown")], "source_file string, label string, name string")
    nodes = spark.createDataFrame([("Department", f"d{i}") for i in range(10)], "label string, key string")
    out = G.mention_edges(chunks, names, nodes)
    want = {(f"c{i}", f"d{k}") for i in range(50) for k in range(9)} | {("c0", "d9"), (None, "d1"), (None, "d9")}
    got = [(r.src, r.dst) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert most_rows(out, "Aggregate") < 9 * 50


@pytest.mark.parametrize("name", ["X10_validate_resolution", "X11_withhold_invalid"])
def test_votes_are_read_once(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
