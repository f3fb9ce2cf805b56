"""Stamps in mixed notations: notations, clocks, daylight-saving changes, and unreadable input."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.timestamps import article_moments, normalised_moments, price_moments

SOURCES = [("Paris", "p.example", "Europe/Paris", "dmy"), ("York", "y.example", "America/New_York", "mdy"), ("Delhi", "d.example", "Asia/Kolkata", "dmy")]


def utc(text):
    return int(dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=dt.UTC).timestamp())


def news(spark, rows):
    sources = spark.createDataFrame(SOURCES, "source_name string, host string, home_tz string, date_order string")
    articles = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id long, published_at string, source_name string, utc_second_hint string")
    return {r["id"]: (r["utc_second"], r["utc_second_status"]) for r in article_moments(articles, sources).collect()}


def test_notations(spark):
    cases = [
        (("2024-03-01T09:41:07Z", "Paris"), "2024-03-01 09:41:07"),
        (("2024-03-01T09:41:07,5Z", "York"), "2024-03-01 09:41:07"),
        (("20240301T094107Z", "York"), "2024-03-01 09:41:07"),
        (("2024-03-01 09:41:07 +0530", "Paris"), "2024-03-01 04:11:07"),
        (("2024-03-01T09:41+01", "York"), "2024-03-01 08:41:00"),
        (("2024-03-01T09:41:07-05:00[America/New_York]", "Paris"), "2024-03-01 14:41:07"),
        (("Fri, 01 Mar 2024 09:41:07 GMT", "York"), "2024-03-01 09:41:07"),
        (("March 1, 2024 9:41 PM", "York"), "2024-03-02 02:41:00"),
        (("1 Mar 2024, 09:41:07 IST", "Delhi"), "2024-03-01 04:11:07"),
        (("01/03/2024 12:05 AM", "Paris"), "2024-02-29 23:05:00"),
        (("03/01/2024", "York"), "2024-03-01 05:00:00"),
        (("01.03.2024 09:41:07", "Paris"), "2024-03-01 08:41:07"),
        (("1709286067", "York"), "2024-03-01 09:41:07"),
        (("1709286067123", "York"), "2024-03-01 09:41:07"),
        (("1709286067.9", "York"), "2024-03-01 09:41:07"),
        (("\t 1 March 2024 \t", "Paris"), "2024-02-29 23:00:00"),
        (("2024-07-01 09:00:00", None), None),
        (("2023-13-45", "Paris"), None),
        (("30 February 2024", "Paris"), None),
        (("2024-03-01T25:00:00Z", "Paris"), None),
        (("yesterday", "Paris"), None),
        (("", "Paris"), None),
        ((None, "Paris"), None),
    ]
    got = news(spark, [c[0] for c in cases])
    assert [got[i][0] for i in range(len(cases))] == [utc(e) if e else None for _, e in cases]


def test_clock_changes(spark):
    got = news(spark, [("2024-10-27 02:30:00", "Paris"), ("2024-03-31 02:30:00", "Paris"), ("2024-11-03 01:30:00", "York"), ("2024-06-01 00:00:00", "York")])
    assert got[0] == (utc("2024-10-27 00:30:00"), "ambiguous")  # the first of the two
    assert got[1] == (utc("2024-03-31 01:30:00"), "nonexistent")  # moved forward by the gap
    assert got[2] == (utc("2024-11-03 05:30:00"), "ambiguous")
    assert got[3] == (utc("2024-06-01 04:00:00"), "exact")


def test_prices_and_empty_tables(spark):
    companies = spark.createDataFrame([("ABCD", "Europe/London")], "ticker string, listing_tz string")
    rows = [(1, " abcd\t", "45293"), (2, "ABCD", "02/07/2024 10:00"), (3, "XXXXX", "02/07/2024 10:00"), (4, None, "2024-07-02T10:00:00+0300"), (5, "ABCD", "20240702100000"), (6, "ABCD", "2024-07-02T10:00:00Z")]
    prices = spark.createDataFrame(rows, "price_id long, `Stock Code` string, Date string")
    got = {r["price_id"]: r["utc_second"] for r in price_moments(prices, companies).collect()}
    assert got == {1: utc("2024-01-02 00:00:00"), 2: utc("2024-07-02 09:00:00"), 3: None, 4: utc("2024-07-02 07:00:00"), 5: utc("2024-07-02 09:00:00"), 6: utc("2024-07-02 10:00:00")}
    sources = spark.createDataFrame(SOURCES, "source_name string, host string, home_tz string, date_order string")
    articles = spark.createDataFrame([], "id long, published_at string, source_name string")
    found = normalised_moments(articles, prices, sources, companies)
    assert {r["row_id"] for r in found.collect()} == {1, 2, 4, 5}
    assert normalised_moments(articles, prices.where(F.lit(False)), sources, companies).count() == 0
