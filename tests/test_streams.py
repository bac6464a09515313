"""Streams over several batches and restarts, keyed tables, and states that merge."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import corpus as C
from ledgerline.operators import graph as G
from ledgerline.operators import reports as M
from ledgerline.operators import writes as S
from ledgerline.sources.keyed import BUCKET, KeyedTable
from ledgerline.streaming import jobs

# Judgements


def by_hand(rows):
    """chunk_id: (retrieved, good, flagged), judged one after another."""
    out = {}
    for chunk, _, good in sorted(rows, key=lambda r: r[1]):
        n, g, flag = out.get(chunk, (0, 0, False))
        n, g = n + 1, g + good
        out[chunk] = n, g, flag or n >= 5 and g / n * 5 < 2.5
    return out


def judged(seed, n, chunks=4):
    draw = random.Random(seed)
    return [(draw.randrange(chunks) if draw.random() < 0.5 else 0, i, draw.random() < 0.55) for i in range(n)]


@pytest.mark.parametrize("n", [1, 4, 5, 9, 40, 200])
def test_runs_of_judgements_merge(spark, n):
    for seed in range(4):
        rows = judged(seed, n)
        got = M.chunk_performance(spark.createDataFrame(rows, "chunk_id long, seq long, good boolean").repartition(3)).collect()
        assert {r.chunk_id: (r.retrieved, r.good, r.flagged) for r in got} == by_hand(rows)


def test_any_split_into_batches_gives_the_same_flag(spark, tmp_path):
    schema, rows = "chunk_id long, seq long, good boolean", judged(7, 120)
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    for part, (a, b) in enumerate([(0, 3), (3, 4), (4, 61), (61, 120)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{source}/{part}")
        jobs.stream_chunk_performance(spark.readStream.schema(schema).parquet(f"{source}/*"), state, out).awaitTermination()
        got = {r.chunk_id: (r.retrieved, r.good, r.flagged) for r in jobs.performance_so_far(spark, out).collect()}
        assert got == by_hand(rows[:b])
        if part == 1:
            jobs.compact_performance(spark, out)
            assert {r.chunk_id: (r.retrieved, r.good, r.flagged) for r in jobs.performance_so_far(spark, out).collect()} == got
    log = spark.read.parquet(out).where("kind = 'log'").groupBy("batch").agg(F.count("*").alias("n")).collect()
    assert {r.batch: r.n for r in log} == {k: len({c for c, _, _ in rows[a:b]}) for k, (a, b) in enumerate([(0, 3), (3, 4), (4, 61), (61, 120)])}


# Whole files

ELEMENT = "source_file string, elem_idx int, page_number int, element_type string, text string, last boolean"


def file_of(name, n, marked=True):
    texts = ["Budget" if i % 9 == 0 else f"{name} paragraph {i} " + "word " * (40 + i % 30) for i in range(n)]
    return [(name, i, i // 20 + 1, "Title" if i % 9 == 0 else "Table" if i % 13 == 5 else "NarrativeText", t, marked and i == n - 1) for i, t in enumerate(texts)]


def test_a_file_in_two_batches_is_cut_as_one(spark, tmp_path):
    a, b, c = file_of("a.pdf", 60), file_of("b.pdf", 45), file_of("c.pdf", 10, marked=False)
    profiles = spark.createDataFrame([("a.pdf", "budget", "Parks", "q2 2026"), ("b.pdf", "minutes", "Clerk", "2025")], "source_file string, document_type string, department string, period string")
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))

    def run(part, rows, idle=3_600_000):
        spark.createDataFrame(rows, ELEMENT).coalesce(1).write.parquet(f"{source}/{part}")
        jobs.stream_new_elements(spark.readStream.schema(ELEMENT).parquet(f"{source}/*"), state, out, profiles, idle_ms=idle).awaitTermination()

    def batch(*files):
        return jobs.chunked(spark.createDataFrame([r for f in files for r in f], ELEMENT), profiles, None)

    same = lambda want: sorted(map(str, jobs.new_chunks(spark, out).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    run("1", b + a[30:] + c)  # the end of a file may come first
    assert same(batch(b)) and {r.source_file for r in jobs.new_chunks(spark, out).select("source_file").distinct().collect()} == {"b.pdf"}
    run("2", a[:30])
    assert same(batch(a, b))
    newer = file_of("b.pdf", 12)
    run("3", newer)
    assert same(batch(a, newer))


def test_an_unmarked_file_is_whole_when_nothing_comes(spark, tmp_path):
    rows, source, state, out = file_of("c.pdf", 25, marked=False), *(str(tmp_path / x) for x in ("in", "state", "out"))
    for part, some in enumerate((rows[:10], rows[10:], file_of("d.pdf", 9))):
        spark.createDataFrame(some, ELEMENT).coalesce(1).write.parquet(f"{source}/{part}")
        jobs.stream_new_elements(spark.readStream.schema(ELEMENT).parquet(f"{source}/*"), state, out, idle_ms=60_000 if part < 1 else 1).awaitTermination()
    got = jobs.new_chunks(spark, out).where("source_file = 'c.pdf'")
    want = jobs.chunked(spark.createDataFrame(rows, ELEMENT), None, None)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


class Handle:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.calls = 0

    def __getattr__(self, name):
        def call(*args, **kw):
            self.calls += 1
            return False if name == "exists" else self

        return call


class Clock:
    getCurrentProcessingTimeInMs = staticmethod(lambda: 0)


def test_whole_files_of_a_group_pass_in_one_call(spark):
    """calls of the state store do not follow the number of files that are whole at once."""
    rows = pd.DataFrame([r for i in range(500) for r in file_of(f"{i}.pdf", 3)], columns=[c.split()[0] for c in ELEMENT.split(", ")]).sample(frac=1, random_state=1)
    task, handle = jobs.WholeFiles(1000), Handle()
    task.init(handle)
    before = handle.calls
    got = pd.concat(task.handleInputRows((0,), iter([rows[:700], rows[700:]]), Clock()))
    assert handle.calls - before <= 2
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, rows[got.columns].itertuples(index=False, name=None)))


def test_open_files_of_one_group_wait_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 1)
    files = {n: file_of(n, k) for n, k in (("a", 30), ("b", 12), ("c", 25), ("d", 9))} | {None: file_of(None, 11)}
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    for part, some in enumerate((files["a"][:10] + files["b"] + files[None][5:], files["c"][20:] + files["a"][10:20], files["a"][20:] + files["c"][:20] + files["d"][:4] + files[None][:5])):
        spark.createDataFrame(some, ELEMENT).coalesce(1).write.parquet(f"{source}/{part}")
        jobs.stream_new_elements(spark.readStream.schema(ELEMENT).parquet(f"{source}/*"), state, out).awaitTermination()
    want = jobs.chunked(spark.createDataFrame([r for n in ("a", "b", "c", None) for r in files[n]], ELEMENT), None, None)
    assert sorted(map(str, jobs.new_chunks(spark, out).select(*want.columns).collect())) == sorted(map(str, want.collect()))


# Keyed tables


def files(path):
    return {f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 16)
    with pytest.raises(ValueError):
        table.read()
    table.upsert(spark.range(200).selectExpr("cast(id as string) as k", "id as v", "0 as seq"), "seq")
    before = files(table.path)
    batch = spark.createDataFrame([("5", 1, 1), ("5", 2, 2), ("new", 3, 1), (None, 4, 1)], "k string, v long, seq int")
    table.upsert(batch, "seq")
    assert len(before) == 16
    touched = {r[0] for r in table.bucketed(batch).select(BUCKET).collect()}
    assert len(before - files(table.path)) == len(touched) < 4
    want = {str(i): i for i in range(200)} | {"5": 2, "new": 3, None: 4}
    assert {r.k: r.v for r in table.read().collect()} == want
    table.upsert(batch, "seq")  # again, as after a failure
    assert {r.k: r.v for r in table.read().collect()} == want
    table.replace(spark.createDataFrame([], "k string, v long"), spark.createDataFrame([("7",), (None,), ("not there",)], "k string"))
    assert {r.k for r in table.read().collect()} == set(want) - {"7", None}


def test_a_bucket_may_lose_its_last_row(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 8)
    table.replace(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    table.replace(spark.createDataFrame([], "k string, v int"), spark.createDataFrame([("a",)], "k string"))
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)]


def test_keyed_documents_keep_their_first_time(spark, tmp_path):
    """S5 on disk gives what S5 gives as a frame."""
    table = KeyedTable(spark, str(tmp_path / "t"), "source_file", 8)
    first = spark.createDataFrame([(f"f{i}", "budget") for i in range(20)], "source_file string, document_type string").selectExpr("*", "timestamp '2026-01-01' as ingested_at", "cast(null as timestamp) as reingested_at")
    table.replace(first)
    batch = spark.createDataFrame([("f3", "memo", 1), ("f3", "minutes", 2), ("g", "memo", 1)], "source_file string, document_type string, seq int")
    S.put_documents(table, batch, "2026-06-01")
    want = S.upsert_documents(first, batch, "2026-06-01")
    assert sorted(map(str, table.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    before = files(table.path)
    S.put_documents(table, batch, "2026-06-01")
    assert len(before - files(table.path)) <= 2


def test_keyed_chunks_and_nodes(spark, tmp_path):
    """S6 and G1 on disk give what they give as frames."""
    old = spark.createDataFrame([(f"c{i}", [1.0], "old", "{}") for i in range(40)], "chunk_id string, embedding array<double>, text string, payload string")
    batch = spark.createDataFrame([("c1", [2.0], "x", 1, "Parks"), ("c1", [3.0], "y", 2, "Codes"), ("n", [1.0], "z", 1, None), ("c2", None, "none", 1, "Parks")], "chunk_id string, embedding array<double>, text string, seq int, dept string")
    chunks = KeyedTable(spark, str(tmp_path / "c"), "chunk_id", 16)
    chunks.replace(old)
    before = files(chunks.path)
    S.put_chunks(chunks, batch)
    want = S.upsert_chunks(old, batch)
    assert sorted(map(str, chunks.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert 1 <= len(before - files(chunks.path)) <= 2
    people = spark.createDataFrame([(f"p{i}", "old") for i in range(40)], "name string, prop string")
    more = spark.createDataFrame([("p1", "a", 1), ("p1", "b", 2), ("", "c", 1), (None, "d", 1), ("q", "e", 1)], "name string, prop string, seq int")
    nodes = KeyedTable(spark, str(tmp_path / "n"), "name", 16)
    nodes.replace(people)
    G.put_nodes(nodes, more, "seq")
    want = G.merge_nodes(people, more, "name", "seq")
    assert sorted(map(str, nodes.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_sections_in_a_stream_and_in_a_batch_agree(spark):
    rows = spark.createDataFrame(file_of("a.pdf", 60), ELEMENT)
    assert jobs.chunked(rows, None, None).count() == C.chunk_sections(rows).count()


def test_the_ratio_of_a_chunk_is_made_once(spark):
    """the content rule looks at it three times; given as a column it gives the same types."""
    texts = ["12 34 5,6 $7 " * 12, "budget 10 20 30 40 " * 9, "The director of parks " * 5, "a grant for the city " * 9, "open  position " * 12, "capital project, phase 2 " * 9, "plain words " * 30, "NoBudget grants " * 20, "Budgetary 1234567 x"]
    rows = spark.createDataFrame([(k, t) for t in texts for k in ("NarrativeText", "Table", "OrgData", None)], "kind string, text string")
    kind, text = F.col("kind"), F.col("text")
    got = rows.withColumn("r", T.numeric_ratio(text)).select(T.content_rule(kind, text).alias("a"), T.content_rule(kind, text, F.col("r")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got[::4]} == {"metrics", "table", "org_data", "project", "narrative", None}
    ratio = jobs.chunked(spark.createDataFrame(file_of("a.pdf", 9), ELEMENT), None, None)._jdf.queryExecution().optimizedPlan().toString()
    assert ratio.count("[0-9,$%.]") == 1
