import duckdb
import pytest

import corpus_pipeline
from ledgerline.llm import language, mixing, tokens

from .helpers import docs
from .test_dedup import near_brute
from .test_texts import contamination_brute


def test_mixing_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.op9_source_mixing(spark, sf).collect()}
    assert got == {r[0]: r[1:5] for r in con.execute(mixing.OP9_SQL).fetchall()}


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ["a", "b", None, "c", "d"][i % 5] if i > 4 else "tiny", 0) for i in range(300)] + [(900, None, "en", "a", 0), (901, "", "en", "empty", 0), (5, "w w", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    got = mixing.mix(df, carry=("source",)).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-9 for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.carried.source] = taken.get(r.carried.source, 0) + r.taken
        target[r.carried.source] = r.target
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)
    plan = spark.createDataFrame([("a", 10), ("b", 100), (None, 100), ("c", 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(plan).collect()}
    assert t["c"] == 0 and t["a"] == 30 and abs(sum(t.values()) - 210) < 1e-9
    assert mixing.mix(df.limit(0)).count() == 0
    copies = mixing.schedule(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


def test_curriculum_tilts(spark):
    rows = [(i, "w", "en", "ab"[i % 2], 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mean = {r.source: sum(r.p) / len(r.p) for r in mixing.mix(df, weights=(1, 1), tilts=(-0.9, 0.9), carry=("source",)).groupBy("carried.source").agg({"positions": "collect_list"}).toDF("source", "x").selectExpr("source", "flatten(x) as p").collect()}
    assert mean["a"] < 0.4 < 0.6 < mean["b"]


def test_pipeline(spark, sf):
    """Stage by stage against plain Python on the smallest tables."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    df, columns = table.limit(120), table.columns
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, df.unionByName(docs(spark, [(9000, None), (9001, "12 !")]).select(*columns)), sf)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in df.collect()}
    again = one.unionByName(one.limit(3))
    two = stages["near_dedup"](spark, again, sf)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = {i for i, v in near_brute(rows, 5, 80).items() if v[2]}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(want)
    three = stages["decontamination"](spark, two, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in contamination_brute([(r.doc_id, r.text) for r in two.collect()], bench, 13) if not r[5]}
    assert {r.doc_id for r in three.collect()} == clean
    four = stages["source_mixing"](spark, three, sf)
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    assert four.columns == columns and four.count() == sum(copies.values())
    five = stages["token_output"](spark, four, sf).collect()
    assert sorted(r.doc_id for r in five) == sorted(i for i, n in copies.items() for _ in range(n))


def test_rows_that_share_an_id_are_documents(spark, sf):
    stages, long = dict(corpus_pipeline.STAGES), " ".join(f"w{i}" for i in range(60))
    rows = [(5, long + " a"), (5, "a text of quite other words than those"), (3, long), (5, long + " a"), (None, "one without an id but words enough"), (None, "one without an id but words enough"), (None, long + " b"), (7, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1.5, "mine", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, nth_of_id int")
    two = stages["near_dedup"](spark, df, sf)
    assert two.columns == df.columns
    # null comes first, so the copy without an id leads its group
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=str) == sorted([rows[6], rows[1], rows[4], rows[7]], key=str)
    for name in ("language_id", "decontamination", "source_mixing"):
        got = stages[name](spark, df, sf)
        assert got.columns == df.columns
        assert all(r.score == 1.5 and r.lang_pred == "mine" and r.nth_of_id == 9 for r in got.collect())


def test_token_output_of_odd_rows(spark, sf):
    from tokenizers import Tokenizer

    long = "a1 Ünïcode\n" * 20_000
    rows = [(7, None), (None, "no id"), (5, "same"), (5, "same"), (None, None), (3, ""), (5, "other"), (9, long)]
    df = spark.createDataFrame([(i, t, -1, "x", 0.5) for i, t in rows], "doc_id long, text string, start int, row string, ids double")
    got = dict(corpus_pipeline.STAGES)["token_output"](spark, df, sf).orderBy("start").collect()
    # a null id comes first, rows of one id are ordered by text, and null and empty texts have their end id
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    encoder = Tokenizer.from_file(tokens.vocabulary())
    sizes = [len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in order]
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(i, sum(sizes[:k]), sizes[k]) for k, (i, _) in enumerate(order)]


def test_mixing_counts_long_texts_whole(spark):
    rows = [(1, "word " * 400_000, "a"), (2, "w" * 2_000_000, "a"), (3, "two words", "b"), (3, "two words", "b"), (4, None, None), (5, " \t\n", "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 400_000), (2, 1), (3, 2), (3, 2), (4, 0), (5, 0)]
    assert all(r.taken <= 3 * r.size for r in got)


def test_shared_path(spark, monkeypatch):
    from ledgerline.llm import shared

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, other: None)})()
        sparkContext = type("Context", (), {"master": "local[2]"})()

    assert shared.shared_path(Session, "x").startswith("/")
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared.shared_path(Session, "x")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_nothing(spark, sf, name):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, sf).count() == 0


def test_fold(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in (0, 7, 123456)], "doc_id long").select("doc_id", language.fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
