"""Sinks, outside calls and the command line."""

import json

from pyspark.sql import functions as F

from tidemark import cli, settings
from tidemark.sources import articles, remote, sinks


def test_outside_calls(spark):
    articles = spark.createDataFrame([(1, "t" * 60, None, "", None, None), (2, "short", None, None, None, None)], "id long, title string, description string, content string, published_at string, source_name string")
    asked = remote.article_requests(articles)
    assert [r["id"] for r in asked.collect()] == [1]
    answered = remote.ask(asked, "request", remote.with_retries(remote.stub_sentiment))
    assert -1 <= answered.select(remote.sentiment_score(F.col("reply"))).first()[0] <= 1
    calls = []

    def failing(x):
        calls.append(x)
        raise OSError

    assert remote.with_retries(failing)("x") is None and len(calls) == 3
    assert remote.with_retries(failing, permanent=(OSError,))("x") is None and len(calls) == 4

    def gone(x):
        calls.append(x)
        raise remote.Missing

    assert remote.with_retries(gone)("x") is None and len(calls) == 5
    lost = remote.ask(asked, "request", remote.with_retries(lambda x: 1 / 0))
    assert lost.select("reply", remote.sentiment_score(F.col("reply")).alias("s")).first().asDict() == {"reply": None, "s": 0.0}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Co/Op Ord", "2020-01-02", 1), ("Co/Op Ord", "2020-01-01", 2)], "security string, date string, v int")
    sinks.write_securities(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).select("file").distinct().first()[0] == "Co_Op Ord"
    first = sinks.append_with_ids(rows, str(tmp_path / "a"), ["date"]).collect()
    second = sinks.append_with_ids(rows, str(tmp_path / "a"), ["date"]).collect()
    assert len(first) == len(second) == 2 and max(r["id"] for r in first) < min(r["id"] for r in second)
    changed = spark.read.parquet(str(tmp_path / "a")).orderBy("id").limit(1).withColumn("v", F.lit(9))
    sinks.update_by_key(spark, str(tmp_path / "a"), str(tmp_path / "b"), changed, "id")
    assert spark.read.parquet(str(tmp_path / "b")).where("v = 9").count() == 1
    sent = []
    messages = spark.createDataFrame([("b",), ("a",)], "message string")
    assert sinks.notify(messages, lambda m: sent.append(m) or True) == 2 and sent == ["a", "b"]
    seen, counter = sinks.counted(rows, "n")
    seen.collect()
    assert counter.get["n"] == 2
    sinks.write_csv(rows, str(tmp_path / "c"), files=1)
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2


def test_command_line(spark, capsys):
    assert cli.main(["backtest", "--json"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0]["total_predictions"] == 500


def test_articles_and_graph(spark, tmp_path):
    reply = {"status": "ok", "articles": [{"title": "T", "description": None, "url": "u", "publishedAt": "2024", "source": {"name": "S"}}, {"title": "V", "published_at": None, "publishedAt": "x", "source": "R"}]}
    (tmp_path / "r.txt").write_text("\n".join([json.dumps(reply), json.dumps({**reply, "status": "error"}), "{broken"]))
    got = [tuple(r) for r in articles.api_articles(spark, str(tmp_path / "r.txt"), "key").collect()]
    assert got == [("T", "", "", "u", "2024", "S"), ("V", "", "", "", "", "R")]
    assert articles.api_articles(spark, str(tmp_path / "r.txt"), None).count() == 0 and articles.api_articles(spark, str(tmp_path / "none"), "key").count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"companies": [{"ticker": "A", "name": "Alpha"}]}))
    assert [tuple(r) for r in articles.graph_companies(spark, str(tmp_path / "g.json")).collect()] == [("A", "Alpha", None)]
    companies = spark.createDataFrame([("A", "Alpha Plc"), ("B", "Beta/Co")], "ticker string, name string")
    stems = spark.createDataFrame([("Alpha Plc Ord 5_00",), ("BETA_CO Ord 1",), ("Other Ord 1",)], "file_stem string")
    assert {r["file_stem"]: r["ticker"] for r in articles.file_tickers(stems, companies).collect()} == {"Alpha Plc Ord 5_00": "A", "BETA_CO Ord 1": "B", "Other Ord 1": None}
    one, two = (articles.generated_prices(companies, "2024-01-02", seed).collect() for seed in (1, 1))
    assert one == two and all(10 <= r["open"] <= 150 and r["low"] <= r["high"] for r in one)


def test_kept_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE kept LOCATION 'file://{tmp_path}/kept'")
    try:
        assert settings.health(spark, "kept")["status"] == "incomplete"
        assert settings.create_tables(spark, "kept") == settings.create_tables(spark, "kept")
        settings.add_feedback(spark, "kept", 7, True, "fine")
        assert settings.health(spark, "kept") == {"status": "ok", "missing": []}
        assert {r["table"]: r["n"] for r in settings.table_counts(spark, "kept").collect()}["feedback"] == 1
    finally:
        spark.sql("DROP DATABASE kept CASCADE")
