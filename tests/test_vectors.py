"""Exact and indexed vector search against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.operators import retrieval as R
from ledgerline.operators import vectors
from ledgerline.plans import registry, stores  # noqa: F401
from ledgerline.sources.conform import Tables


def frame(spark, v, name="chunk_id", **columns):
    return spark.createDataFrame(pa.table({name: [str(i) for i in range(len(v))], "embedding": [None if x is None else list(map(float, x)) for x in v], **columns}))


def nearest(q, v, k):
    """(request, chunk, rank) by rounded cosine, then by name."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.floor(unit(q) @ unit(v).T * 1e6 + 0.5)
    out = set()
    for i, row in enumerate(score):
        for rank, j in enumerate(np.lexsort((np.arange(len(v)).astype(str), -row))[:k], 1):
            out.add((str(i), str(j), rank))
    return out


def clusters(n, dim=16, seed=1):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(n // 100, dim))
    return centres[g.integers(0, len(centres), n)] + 0.1 * g.normal(size=(n, dim))


def test_exact_search_skips_blocks(spark):
    v = clusters(6000)
    count = spark.sparkContext.accumulator(0)
    got = R.vector_topk(frame(spark, v[::10], "query_id"), frame(spark, v).repartition(2), 5, counter=count).collect()
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == nearest(v[::10], v, 5)
    assert 0 < count.value < 0.6 * 600 * 6000


def test_many_copies_tie_by_name(spark):
    v = np.ones((3000, 4))
    got = R.vector_topk(frame(spark, v[:200], "query_id"), frame(spark, v), 3).collect()
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == {(str(i), c, n) for i in range(200) for n, c in enumerate(["0", "1", "10"], 1)}


def test_filters_and_odd_vectors(spark):
    v = [[1, 0], [0.9, 0.1], None, [0, 0], [float("nan"), 1], [1, 0, 0], [], [1, 0.2]]
    chunks = frame(spark, v, kind=["a", "b", "a", "a", "a", "a", "a", None])
    asked = frame(spark, [[1, 0], [1, 0], [0, 0], None, [1, 0]], "query_id", kind=["a", "b", "a", "a", None])
    found = lambda *f: sorted((r.query_id, r.chunk_id) for r in R.vector_topk(asked, chunks, 5, f).collect())
    assert found("kind") == [("0", "0"), ("1", "1")]
    assert found() == [(q, c) for q in ("0", "1", "4") for c in ("0", "1", "7")]
    assert R.vector_topk(asked.where("false"), chunks).count() == R.vector_topk(asked, chunks.where("false")).count() == 0


def test_requests_in_blocks_find_the_same(spark, sf, monkeypatch):
    t = Tables(spark, sf)
    run = lambda *f: sorted(map(tuple, R.vector_topk(t.requests, t.chunks, 3, f).select("query_id", "chunk_id", "score", "rank").collect()))
    whole = [run("label"), run()]
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 3000)
    assert [run("label"), run()] == whole


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    vectors.build_index(frame(spark, clusters(5000)), path)
    return path


def test_index_finds_most(spark, index):
    v = clusters(5000)
    got = R.vector_topk_approx(frame(spark, v[::20], "query_id"), index).collect()
    want = nearest(v[::20], v, 5)
    assert len(got) == len(want)
    assert len({(r.query_id, r.chunk_id) for r in got} & {x[:2] for x in want}) >= 0.95 * len(want)
    assert len({(r.query_id, r.chunk_id, r.rank) for r in R.vector_topk_approx(frame(spark, v[::20], "query_id"), index, probes=10_000).collect()} & want) >= 0.98 * len(want)


def test_index_reads_probed_partitions_alone(spark, index):
    plan = vectors.in_lists(spark, index, [1, 3]).select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "ReadSchema: struct<code:binary>" in plan
    rows = spark.read.parquet(f"{index}/rows")
    assert rows.count() == 5000 and rows.select("list").distinct().count() == vectors.about(spark, index)[2].shape[0] == 71


def test_index_of_the_tables_is_written_once_and_found(spark, sf):
    t = Tables(spark, sf)
    first = stores.index_of(t)
    got = registry.QUERIES["R2_vector_topk_approx"](spark, sf).select("query_id", "chunk_id")
    exact = R.vector_topk(t.requests, t.chunks).select("query_id", "chunk_id")
    assert stores.index_of(t) == first
    assert exact.join(got, ["query_id", "chunk_id"], "left_semi").count() >= 0.95 * exact.count()


def test_small_and_empty_indexes(spark, tmp_path):
    vectors.build_index(frame(spark, [[1, 0], [0, 1], None, [0, 0]]), str(tmp_path / "a"), lists=2)
    asked = frame(spark, [[1, 0.1], None, [1, 2, 3]], "query_id")
    assert [(r.query_id, r.chunk_id) for r in R.vector_topk_approx(asked, str(tmp_path / "a"), probes=1).orderBy("rank").collect()] == [("0", "0"), ("0", "1")]
    vectors.build_index(frame(spark, [[1.0]]).where("false"), str(tmp_path / "b"))
    assert R.vector_topk_approx(asked, str(tmp_path / "b")).count() == 0
