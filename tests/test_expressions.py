import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fareline.functions import display as D
from fareline.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("  plain \t\n", "plain"),
        ("\x00\x0bx\r", "x"),
        (" <b>u1</b> ", "u1"),
        ("a < b", "a &lt; b"),
        ("a <b", "a "),
        ("<>x", "x"),
        ("x<", "x"),
        ("<p>one\ntwo</p\n>three", "one\ntwothree"),
        ("Tom & \"Jo's\" &amp;", "Tom &amp; &quot;Jo&#039;s&quot; &amp;amp;"),
        ("1 > 0", "1 &gt; 0"),
    ],
)
def test_sanitize(spark, raw, want):
    assert one(spark, X.sanitize(text(raw))) == want


def test_sanitize_takes_whole_texts(spark):
    long = "<i>" + "ab & " * 50_000 + "</i>end"
    assert one(spark, X.sanitize(text(long))) == "ab &amp; " * 50_000 + "end"


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, 0),
        ("", 0),
        ("abc", 0),
        ("42", 42),
        (" 42 seats", 42),
        ("-7x", -7),
        ("+7", 7),
        ("3.99", 3),
        (".9", 0),
        ("1e3", 1000),
        ("12-34", 12),
        ("9" * 25, 2**63 - 1),
        ("-" + "9" * 25, -(2**63)),
        ("9" * 60, 2**63 - 1),
        ("-" + "9" * 60, -(2**63)),
        ("9223372036854775807", 2**63 - 1),
    ],
)
def test_whole_number(spark, raw, want):
    assert one(spark, X.whole_number(text(raw))) == want


@pytest.mark.parametrize(
    "raw, want",
    [(None, 0.0), ("x", 0.0), ("12.50 BDT", 12.5), ("-.5", -0.5), ("1e2km", 100.0), ("7.", 7.0)],
)
def test_number(spark, raw, want):
    assert one(spark, X.number(text(raw))) == want


@pytest.mark.parametrize(
    "raw, want", [(None, True), ("", True), ("0", True), ("0.0", False), (" ", False), ("a", False)]
)
def test_is_empty(spark, raw, want):
    assert one(spark, X.is_empty(text(raw))) is want


def test_capitalise_touches_the_first_letter_only(spark):
    assert one(spark, X.capitalise(F.lit("on HOLD"))) == "On HOLD"
    assert one(spark, X.capitalise(F.lit(""))) == ""
    assert one(spark, X.capitalise(F.lit("état"))) == "état"


def test_line_breaks(spark):
    assert one(spark, X.line_breaks(F.lit("a\nb\r\nc\rd"))) == "a<br />\nb<br />\r\nc<br />\rd"


def test_date_and_time(spark):
    assert one(spark, D.date_text(F.lit(dt.date(2024, 3, 5)))) == "05 Mar 2024"
    for raw, want in [
        ("00:05:00", "12:05 AM"),
        ("12:00:00", "12:00 PM"),
        ("21:05:00", "09:05 PM"),
        ("09:30:00", "09:30 AM"),
    ]:
        assert one(spark, D.time_text(F.lit(raw))) == want
    assert one(spark, D.time_text(F.lit("later"))) is None


@pytest.mark.parametrize(
    "raw, places, want",
    [
        ("0.125", 2, "0.13"),
        ("2.5", 0, "3"),
        ("-2.5", 0, "-3"),
        ("1234567.891", 2, "1,234,567.89"),
        ("999.5", 0, "1,000"),
        ("0", 2, "0.00"),
    ],
)
def test_grouped_rounds_half_away_from_zero(spark, raw, places, want):
    assert one(spark, D.grouped(F.lit(Decimal(raw)), places)) == want


def test_no_negative_zero(spark):
    assert one(spark, D.grouped(F.lit(-0.004), 2)) == "0.00"
    assert one(spark, D.grouped(F.lit(Decimal("-0.004")), 2)) == "0.00"


def test_money(spark):
    assert one(spark, D.money(F.lit(Decimal("1234.5")))) == "৳1,234.50"


def test_labels(spark):
    for raw, want in [("confirmed", "success"), ("pending", "warning"), ("odd", "danger"), (None, "danger")]:
        assert one(spark, D.status_label(text(raw))) == want
    for raw, want in [("completed", "Completed"), (None, "Not Paid"), ("", "Not Paid"), ("0", "Not Paid")]:
        assert one(spark, D.payment_label(text(raw))) == want
    assert one(spark, D.paid_via(text("completed"), text("Cash"))) == "Paid via Cash"
    assert one(spark, D.paid_via(text("0"), text("Cash"))) is None
    assert one(spark, D.paid_or_pending(text("completed"))) == "Paid"
    assert one(spark, D.paid_or_pending(text(None))) == "Pending"
    assert one(spark, D.active_label(F.lit(1))) == "Active"
    assert one(spark, D.active_label(F.lit(0))) == "Inactive"
    assert one(spark, D.active_label(F.lit(None).cast("int"))) == "Inactive"
    for raw, want in [(None, "N/A"), ("", "N/A"), ("0", "N/A"), ("01", "01")]:
        assert one(spark, D.or_missing(text(raw))) == want


def test_composed_texts(spark):
    assert one(spark, X.full_name(text("Ann"), text(None))) == "Ann "
    assert one(spark, D.journey(text("Rome"), text("Oslo"))) == "Rome → Oslo"
    assert one(spark, D.joined(F.array(F.lit("A1"), F.lit("A2")))) == "A1, A2"


def test_codes(spark):
    at = F.lit(dt.datetime(2024, 3, 5, 7, 8, 9))
    assert one(spark, D.transaction_code(at, F.lit(9001))) == "TXN202403050708091001"
    assert one(spark, D.booking_code(F.lit(dt.date(2024, 3, 5)), F.lit(5))) == "BKG202403051005"


def test_fare_and_dates(spark):
    assert one(spark, D.total_fare(F.lit(Decimal("19.99")), F.lit(3))) == Decimal("59.97")
    today = F.lit(dt.date(2024, 1, 2))
    assert one(spark, D.not_past(F.lit(dt.date(2024, 1, 2)), today)) is True
    assert one(spark, D.not_past(F.lit(dt.date(2024, 1, 1)), today)) is False


@pytest.mark.parametrize(
    "value, key",
    [
        ("José", "jose"),
        ("JOSÉ", "jose"),
        ("Jose\u0301", "jose"),
        ("Ångström", "angstrom"),
        ("ΆΛΦΑ", "αλφα"),
        ("Ж Й", "ж и"),
        ("한국", "한국"),
        ("plain ASCII 1", "plain ascii 1"),
        ("", ""),
        (None, None),
    ],
)
def test_text_key(spark, value, key):
    assert one(spark, X.text_key(text(value))) == key
    if value is not None:
        assert X.key_of(value) == key
        for other in (key, value, value.upper()):
            assert one(spark, X.same_text(text(value), other)) is True
        assert one(spark, X.same_text(text(value), key + "x")) is False
    else:
        assert one(spark, X.same_text(text(value), "x")) is None
