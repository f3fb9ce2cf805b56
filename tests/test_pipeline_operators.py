"""As-of join, labels, metrics, validation, scalars and news operators on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, metrics, news, validate


def prices(spark):
    raw = [("KCB", "2024-03-01", "45.00"), ("KCB", "2024-03-04", "47.25"), ("KCB", "2024-03-05", "41.00"), ("KCB", "2024-03-05", "43.00"), ("EQTY", "2024-03-01", "52.50"), ("EQTY", "2024-03-04", "52.50"), ("ABC", "2024-03-01", "N/A"), ("", "2024-03-01", "1"), (None, None, None), ("BIG", "2024-03-01", "\t1,234.50 ")]
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], "`Stock Code` string, Date string, `Day's Final Price` string, line long")
    return asof.latest_prices(rows, F.col("line"))


def test_latest_prices(spark):
    got = {(r["ticker"], str(r["day"])): r["price"] for r in prices(spark).collect()}
    assert got == {("KCB", "2024-03-01"): 45.0, ("KCB", "2024-03-04"): 47.25, ("KCB", "2024-03-05"): 43.0, ("EQTY", "2024-03-01"): 52.5, ("EQTY", "2024-03-04"): 52.5, ("BIG", "2024-03-01"): 1234.5}


@pytest.mark.parametrize(
    ("ticker", "day", "expected"),
    [
        ("KCB", "2024-03-01", (45.0, 47.25, 5.0)), ("KCB", "2024-01-01", (None, None, None)), ("EQTY", "2024-03-01", (52.5, 52.5, 0.0)),
        ("KCB", "2024-03-02", (47.25, None, None)), ("KCB", "not-a-date", (None, None, None)), ("FAKE", "2024-03-01", (None, None, None)),
        ("KCB", "2024-02-25", (45.0, 47.25, 5.0)), ("KCB", "2024-02-24", (None, None, None)), (None, "2024-03-01", (None, None, None)),
    ],
)
def test_price_change(spark, ticker, day, expected):
    probes = spark.createDataFrame([(ticker, day)], "ticker string, raw string").withColumn("d", scalars.strict_day(F.col("raw")))
    r = asof.price_change(probes, prices(spark), "d").first()
    assert (r["price_t0"], r["price_tn"], r["pct_change"]) == expected


def test_labels(spark):
    values = [2.0, 1.5, -2.0, -1.5, 0.5, -1.4, 0.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(scalars.direction_label(F.col("v"))).collect()]
    assert got == ["UP", "UP", "DOWN", "DOWN"] + ["NEUTRAL"] * 5


def test_label_predictions_and_repeats(spark):
    rows = [("KCB", "UP"), ("KCB", "DOWN"), ("KCB", "DOWN"), ("FAKE", "NEUTRAL"), ("FAKE", None)]
    p = spark.createDataFrame([(*r, dt.date(2024, 3, 1), "x") for r in rows], "ticker string, dir string, d date, price string")
    got = sorted((r["ticker"], str(r["dir"]), r["correct"]) for r in asof.label_predictions(p.drop("price"), prices(spark), "d", "dir").collect())
    assert got == [("FAKE", "NEUTRAL", True), ("FAKE", "None", False), ("KCB", "DOWN", False), ("KCB", "DOWN", False), ("KCB", "UP", True)]
    assert asof.label_predictions(p.drop("price"), prices(spark), "d", "dir", require_price=True).count() == 3
    assert asof.label_predictions(p.drop("price"), prices(spark).limit(0), "d", "dir").count() == 5


def labelled(spark, rows):
    return spark.createDataFrame(rows, "ticker string, predicted_direction string, price_label string, predicted_confidence double, impact_type string, correct boolean")


def test_metrics(spark):
    rows = labelled(spark, [("A", "UP", "UP", 0.49, "direct", True), ("A", "UP", "DOWN", 0.50, None, False), ("B", "DOWN", "DOWN", 0.70, "", True), ("B", "SIDE", "UP", 0.71, "direct", None), (None, "UP", "UP", None, "direct", True)])
    assert metrics.overall(rows).first().asDict() == {"total_predictions": 5, "overall_accuracy": 0.6}
    bands = {r["band"]: (r["accuracy"], r["n"]) for r in metrics.by_confidence(rows).collect()}
    assert bands == {"low (<0.50)": (1.0, 1), "medium (0.50-0.70)": (0.5, 2), "high (>0.70)": (0.0, 1)}
    classes = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.precision_recall_f1(rows).collect()}
    assert classes == {"UP": (0.6667, 1.0, 0.8, 2), "DOWN": (1.0, 0.5, 0.6667, 2), "NEUTRAL": (0.0, 0.0, 0.0, 0)}
    assert [tuple(r) for r in metrics.by_group(rows, "impact_type").collect()] == [("direct", 0.6667, 3), ("unknown", 0.5, 2)]
    assert [r["group"] for r in metrics.by_group(rows, "ticker", top=2).collect()] == ["A", "B"]
    empty = rows.limit(0)
    assert metrics.overall(empty).first()["overall_accuracy"] == 0.0
    assert {r["n"] for r in metrics.by_confidence(empty).collect()} == {0}


def test_validation(spark):
    import json

    good, other = {"ticker": "KCB", "direction": "UP", "impact_type": "direct", "confidence": 0.85}, {"ticker": "EQTY", "direction": "NEUTRAL", "impact_type": "competitor", "confidence": 0.4}
    p = lambda direct, indirect=(), event="legal": json.dumps({"event_type": event, "directly_affected": direct, "indirectly_affected": indirect})
    bad = {"ticker": "FAKE", "direction": "SIDEWAYS", "impact_type": "rumour", "confidence": 1.5}
    data = [
        ("ok", p([good], [other])), ("many", p([bad], None, "gossip")), ("both", p([good], [good])), ("null", None), ("text", "no object"), ("entry", p([None])), ("missing", '{"event_type": "macro"}'),
        ("object", p(good)), ("words", p("KCB")), ("string", p([{**good, "confidence": "0.8"}])), ("boolean", p([{**good, "confidence": True}])), ("nothing", p([{**good, "confidence": None}])), ("empty", p([{}])),
    ]
    df = spark.createDataFrame(data, "k string, record string")
    companies = spark.createDataFrame([("KCB",), ("EQTY",)], "ticker string")
    checked = validate.with_errors(df, F.col("record"), companies)
    n = {r["k"]: r["errors"] for r in checked.collect()}
    assert n["ok"] == [] and len(n["many"]) == 5 and n["both"] == ["in both groups: KCB"] and n["null"] == n["text"] == ["prediction is not an object"] and len(n["entry"]) == 4
    assert n["missing"] == n["boolean"] == [] and n["object"] == n["words"] == ["no list: directly_affected"]
    assert n["string"] == n["nothing"] == ["invalid confidence for KCB"] and len(n["empty"]) == 4
    valid, invalid = validate.split_valid(checked)
    assert (valid.count(), invalid.count()) == (3, 10)


def test_entities_to_labels(spark):
    import json

    records = [(1, json.dumps({"directly_affected": [{"ticker": "KCB", "direction": "UP", "confidence": 0.9}, None], "indirectly_affected": {"ticker": "EQTY", "direction": "DOWN"}, "data_quality": {"article_date": "2024-03-01"}})), (2, None), (3, '{"directly_affected": null}')]
    entities = asof.affected_entities(spark.createDataFrame(records, "extraction_id long, record string"))
    probes = entities.withColumn("d", scalars.strict_day(F.col("article_date")))
    got = sorted((r["ticker"], r["pos"], r["price_label"], r["correct"]) for r in asof.label_predictions(probes, prices(spark), "d", "predicted_direction").collect())
    assert got == [("EQTY", 0, "NEUTRAL", False), ("KCB", 0, "UP", True)]


def test_scalars(spark):
    row = spark.createDataFrame([("KCB Group Plc Ord 1_00", "01-June-2020", "Co/Op Ord 1.00", "```json\n{\"a\": 1}\n```", "1_000", "12d")], "n string, d string, f string, r string, a string, b string")
    got = row.select(scalars.strip_share_suffix(F.col("n")), scalars.normalise_date(F.col("d")).cast("string"), scalars.safe_file_name(F.col("f")), scalars.strip_fences(F.col("r")), scalars.to_number(F.col("a")), scalars.to_number(F.col("b"))).first()
    assert tuple(got) == ("KCB Group Plc", "2020-06-01", "Co_Op Ord 1_00", '{"a": 1}', None, None)
    days = spark.createDataFrame([(x,) for x in ("2024-03-15", "15/03/2024", "15-03-2024", "March 15", "31-02-2024", "", None)], "d string")
    assert [r[0] for r in days.select(scalars.normalise_date(F.col("d")).cast("string")).collect()] == ["2024-03-15"] * 3 + [None] * 4
    stamps = spark.createDataFrame([(x,) for x in ("2024-03-01T09:00:00+03:00", "2024-03-01 09:00:00", "2024-03-01", "soon", None)], "s string")
    local = scalars.published_local(F.col("s"), F.lit("2000-01-01").cast("timestamp")).cast("string")
    assert [r[0] for r in stamps.select(local).collect()] == ["2024-03-01 09:00:00"] * 2 + ["2024-03-01 00:00:00"] + ["2000-01-01 00:00:00"] * 2
    assert row.select(scalars.preview(F.array(*[F.lit(str(i)) for i in range(7)])), scalars.days_before(F.lit("2024-03-01"), 1).cast("string")).first()[:] == ("0, 1, 2, 3, 4, …", "2024-02-29")
    div = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [str(r[0]) for r in div.select(scalars.ieee_divide(F.col("a"), F.col("b"))).collect()] == ["inf", "-inf", "nan", "0.5", "None"]


def test_news(spark):
    companies = spark.createDataFrame([("AB", "Alpha Limited", "x"), ("BE", "Beta Ltd", "x"), ("GA", "Gamma Plc", "y")], "ticker string, name string, sector string")
    articles = spark.createDataFrame([(1, "ALPHA and beta", None, "", "u1"), (2, "ALPHA and beta", None, "", "u1"), (3, None, None, None, None), (4, "none", "x", "y", "")], "id long, title string, description string, content string, url string")
    assert {r["id"]: r["matched"] for r in news.match_companies(articles, companies).collect()} == {1: "AB,BE", 2: "AB,BE", 3: "MULTIPLE", 4: "MULTIPLE"}
    assert [r["id"] for r in news.first_by_hash(articles, [F.col("id")]).collect()] == [1]
    assert news.new_by_hash(news.first_by_hash(articles, [F.col("id")]), articles, [F.col("id")]).count() == 0
    assert [r["matched"] for r in news.match_companies(articles, companies.limit(0)).where("id = 1").collect()] == ["MULTIPLE"]
    assert sorted(r["id"] for r in news.union_sources(articles.where("id < 4"), articles.where("id = 4"), ["id"]).collect()) == [1, 3]
    assert news.insert_new(articles.where("id = 1"), articles.where("id = 2"), "url", [F.col("id")]).count() == 0
    assert sorted(tuple(r) for r in news.sector_peers(companies).collect()) == [("AB", "BE"), ("BE", "AB")]
    edges = spark.createDataFrame([("AB", "BE", "c"), ("BE", "AB", "c"), ("AB", "Unlisted", "c"), (None, "AB", "c")], "ticker_1 string, ticker_2 string, relationship_type string")
    assert sorted(tuple(r) for r in news.competitor_pairs(edges, companies).collect()) == [("AB", "BE"), ("BE", "AB")]
    assert news.query_strings(companies, 2).orderBy("chunk").first()["query"] == '("Alpha" OR "Beta")'
    symbols = spark.createDataFrame([(2, "SCOM"), (1, "SCBK")], "id long, symbol string")
    asked = spark.createDataFrame([("sc",), ("COM",), ("",), (None,), ("zz",)], "ticker string")
    assert {r["ticker"]: r["symbol_id"] for r in news.match_symbols(asked, symbols).collect()} == {"sc": 1, "COM": 2, "": None, None: None, "zz": None}
