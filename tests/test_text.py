import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("a", "b"),
    [("Parks & Recreation", "Bureau of Parks & Recreation"), ("Public Works", "Department of Public Works"), ("Budget and Finance", "Finance"), ("The Mayor", "office of mayor"), ("Bureau of Planning", "Planning Bureau"), ("Codes", "Codes/Health Department"), ("The City Council", "City Council")],
)
def test_department_variants(spark, a, b):
    assert one(spark, a, T.dept_key) == one(spark, b, T.dept_key) or a == "Budget and Finance" and one(spark, b, T.dept_key) == "budget & finance"


def test_department_label(spark):
    df = spark.createDataFrame([("Codes/Health Department",), ("Bureau of Codes",), ("Codes",)], "d string")
    assert df.groupBy(T.dept_key(F.col("d"))).agg(F.min_by("d", T.display_order(F.col("d"))).alias("d")).first().d == "Bureau of Codes"


@pytest.mark.parametrize(("raw", "want"), [("Hon. Council Member  jane DOE", "Jane Doe"), ("MRS. O'BRIEN", "O'Brien"), ("Vice President Lee", "Lee"), ("", "")])
def test_person_name(spark, raw, want):
    assert one(spark, raw, T.person_name) == want


def test_readability(spark):
    assert one(spark, "The Council of the City shall authorize the agreement for this year.", T.readability) > 0.5
    assert one(spark, "xq zvt wkrp gnff brzl", T.readability) < 0.2
    assert one(spark, "", T.is_garbled)


def test_ratios(spark):
    assert one(spark, "1,234 ab", T.numeric_ratio) == pytest.approx(5 / 7)
    assert one(spark, "   ", T.numeric_ratio) == 0
    assert one(spark, "a’é", T.garbled_ratio) == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("title", "want"),
    [("Land Development plan for a grant", "land_development"), ("Grant application", "grant_action"), ("Professional Services", "contract"), ("Appropriation transfer", "budget"), ("Reappointing a member", "appointment"), ("Honoring staff", "other")],
)
def test_resolution_type(spark, title, want):
    assert one(spark, title, T.resolution_type) == want


@pytest.mark.parametrize(("status", "want"), [("Incomplete", "completed"), ("unmet", "completed"), ("", "none"), (None, "none"), ("under way", "in_progress")])
def test_goal_status_by_substring(spark, status, want):
    assert one(spark, status, T.goal_status) == want


@pytest.mark.parametrize(("raw", "want"), [("2026-01-05", datetime.date(2026, 1, 5)), ("2026-1-5", datetime.date(2026, 1, 5)), ("2026", None), ("", None), ("2026-02-30", None)])
def test_dates(spark, raw, want):
    assert one(spark, raw, T.strict_date) == want


def test_party(spark):
    assert one(spark, "ACME, L.L.C.", T.norm_party) == one(spark, "Acme llc", T.norm_party) == "acme"


def test_file_names(spark):
    meta = lambda name: spark.createDataFrame([(name,)], "n string").select(*(c.alias(k) for k, c in T.filename_meta(F.col("n"), 2030).items())).first()
    assert tuple(meta("Misc. Documents - Quarterly Reports - 2026 - Bureau of Police_Q1 2026.pdf")) == ("Bureau of Police", "Q1", 2026)
    assert tuple(meta("")) == ("Unknown Department", "Q?", 2030)


@pytest.mark.parametrize(("vote", "want"), [("Yeas ", "yea"), ("NO", "nay"), ("away", "absent"), ("maybe", "other")])
def test_votes(spark, vote, want):
    assert one(spark, vote, T.vote_bucket) == want


def test_only_the_home_citys_council_is_the_council(spark):
    names = ["Springfield City Council", "City of Springfield City Council", "Shelbyville City Council", "City Council"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.k for r in df.select(T.dept_key(F.col("name"), "springfield").alias("k")).collect()] == ["city council", "city council", "shelbyville city council", "city council"]
    assert {r.k for r in df.select(T.dept_key(F.col("name")).alias("k")).collect()} == {"springfield city council", "city of springfield city council", "shelbyville city council", "city council"}
