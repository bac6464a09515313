"""Keyword search through trigrams against a scan."""

import pytest

from ledgerline.operators import keywords
from ledgerline.operators import writes as S
from ledgerline.sources.conform import Tables

TEXTS = ["The GRANT of grants", "gra nt", "grand ran ant", None, "", "a%b_c", "a1b2c goal", "GOALS\nand goals", "KELVIN kelvin", "Ünïcode ÜNÏ", "x" * 3000 + "Goal", "ﬁn fin"]
WORDS = ["grant", "GOAL", "goals\nand", "a%b", "b_c", "ab", "kel", "ünï", "xxxx", "zzz", "fin", "grand", "l\na", "\\x"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS * 3)], "chunk_id string, text string")


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trigrams") / "t")
    keywords.write_trigrams(texts, path)
    return path


@pytest.mark.parametrize("word", [w for w in WORDS if w != "\\x"])
def test_as_a_scan(texts, index, word):
    ids = lambda rows: sorted(r.chunk_id for r in rows.select("chunk_id").collect())
    assert ids(keywords.keyword_search(texts, index, word)) == ids(S.keyword_scan(texts, word))


def test_only_the_buckets_of_a_keyword_are_read(spark, index):
    plan = keywords.candidates(spark, index, "grant")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan


def test_on_the_tables(spark, sf, tmp_path):
    chunks = Tables(spark, sf).chunks
    keywords.write_trigrams(chunks, str(tmp_path / "t"))
    for word in ("tion", "eau", "Sch"):
        assert keywords.keyword_search(chunks, str(tmp_path / "t"), word).count() == S.keyword_scan(chunks, word).count() > 0


def test_trigrams_are_of_code_points_and_distinct():
    assert keywords.trigrams("abcabc") == ["abc", "bca", "cab"]
    assert keywords.trigrams("ab") == keywords.trigrams("") == []
    assert set(keywords.trigrams("a😀bü")) == {"a😀b", "😀bü"}
