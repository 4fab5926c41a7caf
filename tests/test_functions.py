from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, html, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("parse", "value", "expected"),
    [
        (dates.dash_seconds, "05-08-2026 17:30:09", datetime(2026, 8, 5, 17, 30, 9)),
        (dates.dash_seconds, "05-08-2026", None),
        (dates.dash_minutes, " 30-07-2026  15:00 ", datetime(2026, 7, 30, 15)),
        (dates.dash_half_day, "13-08-2026 3:05PM", datetime(2026, 8, 13, 15, 5)),
        (dates.dash_half_day, "13-08-2026 12:00  am", datetime(2026, 8, 13)),
        (dates.slash_half_day, "3/12/2026 12:15 PM", datetime(2026, 12, 3, 12, 15)),
        (dates.slash_minutes, "25/07/2026 18:00", datetime(2026, 7, 25, 18)),
        (dates.slash_minutes, "25/07/2026", datetime(2026, 7, 25)),
        (dates.slash_minutes, "31/02/2026", None),
        (dates.month_name, "21-JUL-2026 05:00 pm", datetime(2026, 7, 21, 17)),
        (dates.month_name, "1-Aug-2026", datetime(2026, 8, 1)),
        (dates.month_name, "2026-08-01T10:00:00Z", datetime(2026, 8, 1, 10)),
        (dates.month_name, "8532", None),
        (dates.any_format, "7/8/2026", datetime(2026, 8, 7)),
        (dates.iso, "not a date", None),
        (dates.iso, None, None),
    ],
)
def test_dates(spark, parse, value, expected):
    assert one(spark, parse(lit(value))) == expected


def test_month_without_year_rolls_over(spark):
    now = F.lit("2026-12-30 10:00:00").cast("timestamp")
    at = lambda m, d, t: one(spark, dates.split_without_year(F.lit(m), F.lit(d), F.lit(t), now))
    assert at("January", "2", "05:00 PM") == datetime(2027, 1, 2, 17)
    assert at("Dec", "29", "11:00AM") == datetime(2026, 12, 29, 11)
    assert at("Dec", "29", "09:00 AM") == datetime(2027, 12, 29, 9)
    assert at("Foo", "29", "09:00 AM") is None


def test_epoch(spark):
    assert one(spark, dates.epoch_millis(F.lit(0).cast("long"))) is None
    assert one(spark, dates.epoch_millis(F.lit(86_400_000).cast("long"))) == datetime(1970, 1, 2)


def test_query_text(spark):
    assert one(spark, text.normalize_query(F.lit("  ＮＶＧ  (Sight)*  A/12_b-3.x "))) == "nvg sight a/12_b-3.x"
    assert one(spark, text.normalize_query(F.lit("!!!"))) == ""
    for value, structured, raw in (("ab/12-3", True, True), ("abc123", False, False), ("12345", False, True), ("a:1", False, True)):
        assert one(spark, text.is_structured_reference(F.lit(value))) == structured
        assert one(spark, text.is_raw_reference(F.lit(value))) == raw


@pytest.mark.parametrize(
    ("fields", "expected"),
    [
        (("Spare parts for trucks", None, "Army HQ", None), "irrelevant"),
        (("Thermal sight", None, "Indian ARMY", None), "relevant"),
        (("Desks", None, None, "City College"), "irrelevant"),
        (("Desks", None, "Agriculture office", None), "unclassified"),
        (("Desks", None, None, None), "unclassified"),
    ],
)
def test_relevance(spark, fields, expected):
    assert one(spark, text.relevance(*map(lit, fields))) == expected


def test_small_texts(spark):
    assert one(spark, text.clean(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.reference_id(F.lit("Tender No: AB/1"))) == "AB/1"
    assert one(spark, text.reference_id(F.lit(" NO./X (7) "))) == "NO./X (7)"
    assert one(spark, text.reference_id(F.lit("  "))) is None
    assert one(spark, text.bracket_values(F.lit("[t] [ r ][][id]"))) == ["t", "r", "id"]
    assert one(spark, text.stated_total(F.lit("Showing 1 to 10 of 4,321 entries"))) == 4321
    assert one(spark, text.stated_total(F.lit("Total No. of Records: 12"))) == 12
    assert one(spark, text.stated_total(F.lit("0 records found"))) is None
    assert one(spark, text.recipients(F.lit("A@x.org; b@y.org,a@x.org"))) == ["a@x.org", "b@y.org"]
    assert one(spark, text.recipients(F.lit("a@x.org, nobody"))) is None
    assert one(spark, text.short_name(F.lit("x"), F.lit("Coal Works e-Procurement (beta)"))) == "Coal Works"
    assert one(spark, text.slug(F.lit("West Land"), {"West Land": "wl"})) == "wl"
    work = one(spark, text.division_split(F.lit("Road work in Division No: PWD 3.")))
    assert (work["title"], work["department"]) == ("Road work", "PWD 3")
    assert one(spark, text.page_gate(F.lit("Please login, CAPTCHA"))) == "captcha"
    for base, href, expected in (("http://a.b/c/d?x", "e", "http://a.b/c/e"), ("http://a.b", "?q", "http://a.b?q"), ("http://a.b/c", "/z", "http://a.b/z"), ("http://a.b/c", "https://q", "https://q")):
        assert one(spark, text.absolute_url(F.lit(base), F.lit(href))) == expected


def test_leaf_rows_skip_layout_tables(spark):
    page = "<table><tr><td><table><tr><td>x</td><td>y<!-- <td>no</td> --></td></tr></table></td></tr></table>"
    found = one(spark, html.leaf_rows(F.lit(page)))
    assert len(found) == 1
    assert one(spark, F.transform(html.cells(F.lit(found[0])), html.text_of)) == ["x", "y"]
