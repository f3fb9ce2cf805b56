"""Features against pandas, file sources, and streams against their batch forms."""

import datetime as dt
import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, model
from tidemark.sources import files
from tidemark.streaming import streams


def series(kind, n=40):
    rng = np.random.default_rng(5)
    close = {"up": np.arange(1.0, n + 1), "flat": np.full(n, 7.0), "random": 50 + rng.normal(0, 1, n).cumsum()}[kind]
    volume = rng.integers(1, 100, n).astype(float)
    volume[10] = 0
    return pd.DataFrame({"ticker": kind, "time": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)], "close": close, "volume": volume})


@pytest.fixture(scope="module")
def frames(spark):
    pdf = pd.concat([series(k) for k in ("up", "flat", "random")])
    return pdf, spark.createDataFrame(pdf)


def test_rolling_features_equal_pandas(frames):
    pdf, df = frames
    got = features.returns(df).toPandas().sort_values(["ticker", "time"]).reset_index(drop=True)
    for name, own in pdf.sort_values(["ticker", "time"]).groupby("ticker"):
        mine = got[got.ticker == name]
        for c, e in {"ret_1d": own.close.pct_change(1), "ret_20d": own.close.pct_change(20), "vol_change": own.volume.pct_change(1), "sma_20": own.close.rolling(20).mean()}.items():
            np.testing.assert_allclose(mine[c].astype(float).to_numpy(), e.to_numpy(), rtol=1e-9)


def test_rsi_equals_pandas(frames):
    pdf, df = frames
    got = features.rsi(df).toPandas().sort_values(["ticker", "time"])
    for name, own in pdf.groupby("ticker"):
        d = own.close.diff()
        rs = d.clip(lower=0).ewm(com=13, adjust=False).mean() / (-d.clip(upper=0)).ewm(com=13, adjust=False).mean()
        np.testing.assert_allclose(got[got.ticker == name]["rsi_14"].astype(float).to_numpy(), (100 - 100 / (1 + rs)).to_numpy(), rtol=1e-9)


def test_feature_frame(spark, frames):
    scores = spark.createDataFrame([("random", dt.datetime(2024, 1, 25, 3), 0.5), ("random", dt.datetime(2024, 1, 25, 9), 0.1)], "ticker string, created_at timestamp, sentiment_score double")
    frame = features.feature_frame(frames[1], scores, "2024-01-10", "2024-02-09").toPandas()
    assert set(frame.ticker) == {"up", "random"}  # a flat series has no RSI
    assert (frame[frame.ticker == "up"][["score", "score_trend_3d"]] == 0).all().all()
    day = frame[(frame.ticker == "random") & (frame.time == dt.date(2024, 1, 25))].iloc[0]
    assert day.score == pytest.approx(0.3) and day.score_trend_3d == pytest.approx(0.1)
    assert frame[frame.ticker == "up"].rsi_14.eq(100).all()
    assert features.feature_frame(frames[1].limit(0), scores, "2024-01-10", "2024-02-09").count() == 0
    last = features.latest_features(features.feature_frame(frames[1], scores, "2024-01-10", "2024-02-09"))
    assert {r["time"] for r in last.collect()} == {dt.date(2024, 2, 9)}


def test_split(frames):
    got = features.chronological_split(frames[1]).groupBy("ticker").agg(F.count_if("is_test").alias("t")).collect()
    assert {r["t"] for r in got} == {8}


def workbook(rows):
    cell = lambda v, i, j: f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    body = "".join(f'<row r="{i}">' + "".join(cell(v, i, j) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/><sheet name="Sheet1" sheetId="2" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    head = ["name"] + [""] * 6
    plain, shifted = ["Equity Ord 0.50", "1000000", "5000000", "45.0", "46.0", "44.0"], ["Equity Ord 0.50", "KE1000001234", "1000000", "5000000", "45.0", "46.0", "44.0"]
    (tmp_path / "01-June-2020.xlsx").write_bytes(workbook([head, plain, shifted, ["Safaricom Plc", "1"], [None, "2"], ["X Ord 1", "US1000001234", "3"]]))
    (tmp_path / "broken.xls").write_bytes(b"no workbook")
    got = files.security_rows(files.workbooks(spark, str(tmp_path))).collect()
    assert [r["vwap"] for r in got if r["security"].startswith("Equity")] == ["45.0", "45.0"]
    assert [r["shares"] for r in got if r["security"].startswith("X")] == ["US1000001234"]
    assert files.workbooks(spark, str(tmp_path / "none")).count() == 0


def test_json_lines_and_links(spark, tmp_path):
    (tmp_path / "news_a.jsonl").write_text('{"article": {}, "prediction": {"event_type": "legal"}}\nbroken{\n{"event_type": "macro"}\n{"prediction": null}\n')
    lines = files.json_lines(spark, str(tmp_path / "*.jsonl"))
    kinds = files.unwrap_predictions(lines).select(F.try_variant_get("prediction", "$.event_type", "string")).collect()
    assert sorted(r[0] for r in kinds) == ["legal", "macro"]
    assert files.latest_file(spark, str(tmp_path)).endswith("news_a.jsonl")
    assert files.latest_file(spark, str(tmp_path / "none")) is None
    assert files.having_key(lines, "event_type").count() == 1 and files.having_key(lines, "prediction").count() == 2
    pages = spark.createDataFrame([(1, '<a href="/n/x">T <b>x</b></a><time datetime="2024-01-01">1 Jan</time><a href="/n/x">again</a><a href="/o">no</a>'), (2, None), (3, "<a href='/n/y'>")], "page_id long, html string")
    got = files.page_links(pages, "https://h.example/", "/n/").collect()
    assert [tuple(r) for r in got] == [(1, "https://h.example/n/x", "T x", "2024-01-01")]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    streams.enqueue(df.limit(0), str(tmp_path / "in"))
    stream = streams.file_queue(spark, str(tmp_path / "in"), df.schema)
    run = lambda s, n, *more: streams.run_available(s, str(tmp_path / f"o{n}"), str(tmp_path / f"c{n}"), *more)
    assert run(streams.deduplicated(stream, ["user_id"]), 1).count() == 5
    assert run(streams.deduplicated(stream, ["user_id"], "ts", "30 days"), 2).count() == 5
    daily = run(streams.daily_means(stream, "user_id", "ts", "value"), 3, "update", ["user_id", "day"])
    batch = {(r["user_id"], r["d"]): r["m"] for r in df.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("m")).collect()}
    assert {(r["user_id"], r["day"]): r["mean"] for r in daily.collect()} == batch  # windows no watermark has closed too


def test_chained_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id long, p double")
    df.write.parquet(str(tmp_path / "q"))
    steps = [(lambda b: b.withColumn("side", F.when(F.col("p") > 0.5, "UP")), str(tmp_path / "predictions")), (lambda b: b.where("side = 'UP'").select("id"), str(tmp_path / "alerts"))]
    streams.chained(streams.file_queue(spark, str(tmp_path / "q"), df.schema), steps, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == 2
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == [1]


def test_queue_quarantines_failures(spark, tmp_path):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string")
    df.write.parquet(str(tmp_path / "q"))
    score = lambda b: b.withColumn("score", F.when(F.col("text") == "good", 0.5))
    q = streams.process_queue(streams.file_queue(spark, str(tmp_path / "q"), df.schema), score, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "c"))
    q.awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_models_by_ticker(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for ticker, n in (("learns", 300), ("short", 20), ("same", 80)):
        x = rng.normal(size=(n, len(features.FEATURES)))
        x[0, 0] = np.inf
        for i in range(n):
            rows.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), int(x[i, 3] > 0.2) if ticker == "learns" else 1))
    frame = spark.createDataFrame(rows, "ticker string, time date, " + ", ".join(f"{f} double" for f in features.FEATURES) + ", target int")
    model.save(model.train(frame), str(tmp_path / "m"))
    models = model.load(spark, str(tmp_path / "m"))
    got = {r["ticker"]: (r["accuracy"], r["n_train"], r["n_test"]) for r in models.collect()}
    assert set(got) == {"learns", "same"} and got["learns"][0] > 0.9 and got["learns"][1:] == (240, 60) and got["same"][0] == 1.0
    assert model.load(spark, str(tmp_path / "m"), "learns").count() == 1 and model.load(spark, str(tmp_path / "none")).count() == 0
    last = {r["ticker"]: (r["probability"], r["predicted_direction"]) for r in model.predict_latest(models, frame).collect()}
    expected = {t: next(r[-1] for r in reversed(rows) if r[0] == t) for t in got}
    assert {t: d for t, (_, d) in last.items()} == expected and all(0 < p < 1 for p, _ in last.values())
    assert model.train(frame, days=30).count() == 0 and model.train(frame.limit(0)).count() == 0
    assert (model.ROUNDS, model.TREE_DEPTH, model.RATE, model.LEAST_ROWS) == (100, 3, 0.05, 50)
