"""Queries of the core over a data directory, by name. Their SQL is in ``tidemark.sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, features, metrics, model, nested, news, timestamps, validate
from tidemark.plans import roles
from tidemark.scratch import materialize, new_path
from tidemark.sources import articles, files
from tidemark.sql import SQL  # noqa: F401
from tidemark.streaming import streams
from tidemark.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def p1_found(spark, d):
    """Every child of every extraction, linked through interval labels."""
    return nested.child_rows(table(spark, d, "extractions"))


@query
def p1_nodes(spark, d):
    """All nodes of all extractions with their interval labels."""
    return nested.label_nodes(table(spark, d, "extractions"))


def _flat(kind: str) -> Query:
    def run(spark, d):
        return nested.flat_table(materialize(nested.label_nodes(table(spark, d, "extractions")), "nodes"), kind)

    run.__name__ = f"p1_{kind}"
    run.__doc__ = f"The flat table of ``{kind}``, its fields linked to its rows by interval containment."
    return run


for _kind in (*nested.LISTS, *nested.STRUCTS):
    query(_flat(_kind))


@query
def p3_found(spark, d):
    """Every readable stamp not yet canonical, with its UTC second."""
    t = lambda name: table(spark, d, name)
    return timestamps.normalised_moments(t("news_articles"), t("prices"), t("news_sources"), t("companies"))


def _prices(spark, d):
    """The daily prices, made once for both as-of searches."""
    return materialize(roles.asof_prices(spark, d), "prices")


@query
def daily_prices(spark, d):
    """Cleaned daily prices."""
    return _rounded(roles.daily_prices(spark, d), "close", "high", "low")


@query
def price_change_forward_asof(spark, d):
    """First price from each order's day on, and from three days after the day found."""
    moved = asof.price_change(roles.predictions(spark, d), _prices(spark, d), "article_day")
    return _rounded(moved.select("id", "ticker", "t0_day", "price_t0", "tn_day", "price_tn", "pct_change"), "price_t0", "price_tn", "pct_change")


def _labelled(spark, d):
    return asof.label_predictions(roles.predictions(spark, d), _prices(spark, d), "article_day", "predicted_direction")


@query
def labeled_predictions(spark, d):
    """Predictions with their label and whether they were right."""
    return _labelled(spark, d).select("id", "predicted_direction", "price_label", "correct")


@query
def accuracy_overall(spark, d):
    """A1, A8."""
    return metrics.overall(_labelled(spark, d))


@query
def accuracy_by_confidence(spark, d):
    """A4."""
    return metrics.by_confidence(_labelled(spark, d))


@query
def accuracy_by_impact(spark, d):
    """A5, O5."""
    return metrics.by_group(_labelled(spark, d), "impact_type")


@query
def accuracy_by_ticker_top15(spark, d):
    """The fifteen most frequent tickers."""
    return metrics.by_group(_labelled(spark, d), "ticker", top=15)


@query
def direction_distribution(spark, d):
    """Directions over all affected companies of the extractions."""
    return metrics.distribution(_entities(spark, d), "predicted_direction")


def _entities(spark, d):
    return asof.affected_entities(nested.record_json(table(spark, d, "extractions")))


@query
def entity_labels(spark, d):
    """Every affected company of every extraction against the change of its price from the article's day on."""
    rows = table(spark, d, "prices").select(F.upper("Stock Code").alias("Stock Code"), "Date", "Day's Final Price", "price_id")
    prices = materialize(asof.latest_prices(rows, F.col("price_id")), "prices")
    entities = _entities(spark, d).withColumn("article_day", scalars.strict_day(F.substring("article_date", 1, 10)))
    labelled = asof.label_predictions(entities, prices, "article_day", "predicted_direction")
    return _rounded(labelled.select("extraction_id", "group", "pos", "ticker", "article_day", "t0_day", "tn_day", "pct_change", "price_label", "correct"), "pct_change")


@query
def confusion_per_class(spark, d):
    """A2."""
    return metrics.confusion(_labelled(spark, d))


@query
def precision_recall_f1(spark, d):
    """A3."""
    return metrics.precision_recall_f1(_labelled(spark, d))


def _series(spark, d):
    return roles.daily_prices(spark, d).select("ticker", F.col("day").alias("time"), "close", "volume")


@query
def returns_1_5_20(spark, d):
    """W1."""
    return _rounded(features.returns(_series(spark, d)).select("ticker", "time", "ret_1d", "ret_5d", "ret_20d"), "ret_1d", "ret_5d", "ret_20d")


@query
def volume_change(spark, d):
    """W2."""
    return _rounded(features.returns(_series(spark, d)).select("ticker", "time", "vol_change"), "vol_change")


@query
def sma_20(spark, d):
    """W3."""
    return _rounded(features.returns(_series(spark, d)).select("ticker", "time", "sma_20"), "sma_20")


@query
def rsi_14(spark, d):
    """W4-W7."""
    return _rounded(features.rsi(_series(spark, d)).select("ticker", "time", "rsi_14"), "rsi_14")


@query
def next_day_target(spark, d):
    """W8."""
    return features.next_day_target(_series(spark, d)).select("ticker", "time", "target")


@query
def sentiment_daily(spark, d):
    """A9."""
    return _rounded(features.daily_sentiment(roles.sentiment(spark, d)), "score")


@query
def feature_frame(spark, d):
    """M4: A9, W1-W9, J5, P13, P14."""
    return _rounded(_frame(spark, d), "close", *features.FEATURES)


def _frame(spark, d):
    """The features of the whole table, from its first day to its last."""
    days = _series(spark, d).agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    return features.feature_frame(_series(spark, d), roles.sentiment(spark, d), days["a"], days["b"])


@query
def latest_features(spark, d):
    """W10."""
    return _rounded(features.latest_features(_frame(spark, d)), "close", *features.FEATURES)


@query
def chronological_split_counts(spark, d):
    """W11."""
    split = features.chronological_split(_series(spark, d))
    return split.groupBy("ticker").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query
def trainable_tickers(spark, d):
    """A12."""
    return features.trainable_tickers(_series(spark, d))


@query
def sector_peers(spark, d):
    """J11."""
    return news.sector_peers(table(spark, d, "companies"))


@query
def competitor_pairs(spark, d):
    """J12, J13, A14."""
    return news.competitor_pairs(table(spark, d, "relationships"), table(spark, d, "companies"))


@query
def news_dedup_hash(spark, d):
    """The first article of each content hash."""
    return news.first_by_hash(table(spark, d, "news_articles"), [F.col("id")]).select("id", "content_hash")


@query
def news_dedup_stored_hash(spark, d):
    """Of the later batches, what the stored first one lacks by content hash."""
    articles = table(spark, d, "news_articles").select("id", "title", "content", "url", "batch_no")
    stored = news.first_by_hash(articles.where("batch_no = 0"), [F.col("id")])
    return news.new_by_hash(stored, articles.where("batch_no > 0"), [F.col("id")]).select("id", "content_hash")


@query
def news_dedup_first_url(spark, d):
    """What an insert-or-ignore of the later batches into the first one adds."""
    articles = table(spark, d, "news_articles").where(F.coalesce("url", F.lit("")) != "")
    return news.insert_new(articles.where("batch_no = 0"), articles.where("batch_no > 0"), "url", [F.col("id")]).select("id", "url")


@query
def news_union_sources(spark, d):
    """Two sources in one, first row a url."""
    a = table(spark, d, "news_articles").select("id", "url", "batch_no")
    return news.union_sources(a.where("batch_no % 2 = 0"), a.where("batch_no % 2 = 1"), ["id"]).select("id", "source_rank")


@query
def price_upsert(spark, d):
    """The table of prices after merging the later loads into it."""
    rows = table(spark, d, "prices").select(scalars.trimmed(F.col("Stock Code")).alias("code"), F.col("Date").alias("date"), F.col("Day's Final Price").alias("price"), "price_id").where("code is not null and date is not null")
    half = F.lit(1) + F.col("price_id") % 2
    old, new = rows.where(half == 1), rows.where(half == 2)
    latest = news.upsert(old.limit(0), old, ["code", "date"], [F.desc("price_id")])
    return news.upsert(latest, new, ["code", "date"], [F.desc("price_id")]).select("code", "date", "price", "price_id")


@query
def ticker_text_match(spark, d):
    """The companies named in each article."""
    return news.match_companies(table(spark, d, "news_articles"), table(spark, d, "companies"))


@query
def ticker_ilike_match(spark, d):
    """For each printed stock code the first company whose ticker contains it, in any case."""
    ranked = table(spark, d, "companies").select(F.row_number().over(Window.orderBy("ticker")).alias("id"), F.col("ticker").alias("symbol"))
    rows = table(spark, d, "prices").select("price_id", scalars.trimmed(F.col("Stock Code")).alias("ticker"))
    return news.match_symbols(rows, ranked).select("price_id", "symbol_id")


@query
def short_text_filter(spark, d):
    """Articles with at least fifty characters in all."""
    whole = F.concat(*[F.coalesce(c, F.lit("")) for c in ("content", "description", "title")])
    return table(spark, d, "news_articles").where(F.length(whole) >= 50).select("id")


@query
def truncated_text(spark, d):
    """The first text that is not empty, cut to two thousand characters."""
    t = scalars.article_text(F.col("content"), F.col("description"), F.col("title"))
    return table(spark, d, "news_articles").select("id", F.md5(t).alias("text_md5"), F.length(t).alias("n"))


@query
def query_strings(spark, d):
    """Search expressions of fifteen names each."""
    return news.query_strings(table(spark, d, "companies"))


@query
def price_validity(spark, d):
    """P10: whether each day's row of prices is valid."""
    p = roles.daily_prices(spark, d)
    ok = validate.price_row_valid(p["close"], p["high"], p["low"], p["close"], p["volume"])
    return p.select("ticker", "day", ok.alias("ok"))


def _checked(spark, d):
    return validate.with_errors(nested.record_json(table(spark, d, "extractions")), F.col("record"), table(spark, d, "companies"))


@query
def prediction_validity_errors(spark, d):
    """P8, P8a-P8g: how often each kind of error occurs in each extraction, replies as text included."""
    count = lambda prefix, name: F.size(F.filter("errors", lambda x: x.startswith(prefix))).alias(f"n_{name}")
    kinds = {"prediction is": "no_object", "invalid event_type": "event_type", "no list": "no_list", "invalid ticker": "ticker", "invalid direction": "direction", "invalid impact_type": "impact_type", "invalid confidence": "confidence", "in both": "both"}
    return _checked(spark, d).select("extraction_id", *[count(p, n) for p, n in kinds.items()])


@query
def valid_invalid_split(spark, d):
    """Numbers of valid and invalid predictions."""
    return _checked(spark, d).agg(F.count_if(F.size("errors") == 0).alias("n_valid"), F.count_if(F.size("errors") > 0).alias("n_invalid"))


@query
def name_normalise(spark, d):
    """names without share class and legal form, and as file names."""
    n = F.concat(F.col("name"), F.lit(" Ord 1_00"))
    return table(spark, d, "companies").select("ticker", scalars.strip_share_suffix(n).alias("bare"), scalars.strip_legal_forms(F.col("name")).alias("short"), scalars.safe_file_name(n).alias("file_name"))


@query
def date_normalise(spark, d):
    """The price dates in one of four notations."""
    day = scalars.normalise_date(F.col("Date"))
    return table(spark, d, "prices").select("price_id", day.alias("day")).where("day is not null")


@query
def price_numbers(spark, d):
    """Prices as numbers."""
    return table(spark, d, "prices").select("price_id", F.round(scalars.to_number(F.col("Day's Final Price")), 6).alias("price")).where("price is not null and not isnan(price)")


@query
def ticker_lookup(spark, d):
    """Securities found by their lower-cased name without the share class; partners that are no company get none."""
    companies = table(spark, d, "companies")
    named = companies.select(F.concat(F.upper("name"), F.lit("  Ord 5.00")).alias("security")).unionByName(table(spark, d, "relationships").select(F.col("ticker_2").alias("security")))
    bare = lambda c: F.lower(scalars.strip_share_suffix(c))
    known = companies.select("ticker", bare(F.col("name")).alias("k"))
    return named.distinct().join(known, bare(F.col("security")) == F.col("k"), "left").select("security", "ticker")


@query
def unmatched_names(spark, d):
    """Partners that are no listed company."""
    names = table(spark, d, "relationships").select(F.col("ticker_2").alias("name")).distinct()
    return names.join(table(spark, d, "companies").select(F.col("ticker").alias("name")), "name", "left_anti")


@query
def latest_100_alerts(spark, d):
    """Of the last hundred scores those from a threshold on, with a message."""
    scored = table(spark, d, "orders").select("o_orderkey", "o_custkey", ((F.col("o_orderkey") * 37 % 101) / F.lit(100.0)).alias("p"))
    last = scored.orderBy(F.desc("o_orderkey")).limit(100).where("p >= 0.7")
    named = last.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    side = F.when(F.col("p") > 0.5, "BUY/UP").otherwise("SELL/DOWN")
    return named.select("o_orderkey", F.concat_ws(" ", "c_name", F.format_string("%.1f%%", F.col("p") * 100), side).alias("message"))


@query
def event_props_json(spark, d):
    """a number out of a JSON field, 0 where it is missing."""
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "double"), F.lit(0.0)).alias("k"))


@query
def reply_json(spark, d):
    """replies from which a JSON object can be read once the fence around them is gone."""
    kind = F.coalesce(F.schema_of_variant(scalars.parse_reply(F.col("raw_reply"))), F.lit(""))
    return table(spark, d, "extractions").where("raw_reply is not null").select("extraction_id", kind.startswith("OBJECT").alias("is_object"))


@query
def published_calendar(spark, d):
    """ISO stamps as the calendar time they show, the offset dropped; others at the fallback."""
    t = scalars.published_local(F.col("published_at"), F.lit("1970-01-01").cast("timestamp"))
    return table(spark, d, "news_articles").select("id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("published"))


@query
def api_articles(spark, d):
    """The articles of stored replies of a news service, of which some report an error."""
    a = table(spark, d, "news_articles")
    article = F.struct("title", "description", "content", "url", F.col("published_at").alias("publishedAt"), F.struct(F.col("source_name").alias("name")).alias("source"))
    path = new_path(spark, "replies")
    a.select(F.to_json(F.struct(F.when(F.col("id") % 7 == 0, "error").otherwise("ok").alias("status"), F.array(article).alias("articles"))).alias("value")).write.text(path)
    return articles.api_articles(spark, path, "key")


@query
def graph_companies(spark, d):
    """Companies read from a knowledge graph's JSON and added where the stored ones lack them."""
    companies = table(spark, d, "companies")
    path = new_path(spark, "graph")
    companies.select(F.to_json(F.struct(F.array(F.struct("ticker", "name", "sector")).alias("companies"))).alias("value")).write.text(path)
    stored = companies.where("ticker < 'M'").select("ticker", "name", "sector")
    return news.insert_new(stored, articles.graph_companies(spark, path), "ticker", [F.col("name")])


@query
def file_name_tickers(spark, d):
    """Tickers of the tables that are named after a security."""
    named = table(spark, d, "companies").select(F.concat(scalars.safe_file_name(F.col("name")), F.lit(" Ord 5_00")).alias("file_stem"))
    return articles.file_tickers(named.unionByName(named.select(F.lit("No such firm Ord 1_00").alias("file_stem")).distinct()), table(spark, d, "companies"))


@query
def generated_prices(spark, d):
    """Generated prices of every company; whether all are valid and in range, as their values are random."""
    p = articles.generated_prices(table(spark, d, "companies").select("ticker"), "2024-01-02")
    fine = validate.price_row_valid(p["open"], p["high"], p["low"], p["close"], p["volume"]) & F.col("open").between(10, 150) & F.col("volume").between(1000, 500000)
    return p.select("ticker", "day", fine.alias("fine"), (F.abs(F.col("high") / F.col("open") - 1.05) < 1e-9).alias("high_ok"))


@query
def labeled_rows_with_key(spark, d):
    """Of JSON lines those that have the key, be its value null."""
    path = new_path(spark, "lines")
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id"))).otherwise(F.to_json(F.struct("event_id", F.when(F.col("event_id") % 3 == 1, "UP").alias("predicted_direction")), {"ignoreNullFields": "false"}))
    e.select(line.alias("value")).write.text(path)
    rows = files.having_key(files.json_lines(spark, path), "predicted_direction")
    return rows.select(F.try_variant_get("value", "$.event_id", "long").alias("event_id"), F.try_variant_get("value", "$.predicted_direction", "string").alias("direction"))


@query
def security_cells(spark, d):
    """Price list rows that name ordinary shares; those with an ISIN hold their values one cell further on."""
    c = table(spark, d, "companies")
    isin = F.length("ticker") % 2 == 0
    name = F.concat("name", F.when(F.length("name") % 3 == 0, F.lit(" Pref 4")).otherwise(F.lit(" Ord 5.00 ")))
    vals = [F.concat(F.lit(f"v{i}-"), "ticker") for i in range(5)]
    shifted = [F.when(isin, F.lit("KE0000000001")).otherwise(vals[0]), *[F.when(isin, vals[i]).otherwise(vals[i + 1] if i < 4 else F.lit(None)) for i in range(5)]]
    cells = c.select(F.lit("02-January-2024").alias("file_stem"), F.lit(0).alias("row_no"), name.alias("c0"), *[v.alias(f"c{i + 1}") for i, v in enumerate(shifted)])
    return files.security_rows(cells).select("security", scalars.strip_share_suffix(F.col("security")).alias("bare"), "shares", "low")


@query
def unwrapped_predictions(spark, d):
    """Predictions of JSON lines, wrapped or not; null ones are dropped."""
    path = new_path(spark, "lines")
    rows = table(spark, d, "extractions").select("extraction_id", F.to_json("prediction").alias("r"))
    wrapped = F.concat(F.lit('{"id": 1, "prediction": '), F.coalesce("r", F.lit("null")), F.lit("}"))
    rows.select(F.when(F.col("extraction_id") % 2 == 0, wrapped).otherwise(F.col("r")).alias("value")).where("value is not null").write.text(path)
    kept = files.unwrap_predictions(files.json_lines(spark, path))
    return kept.select(F.try_variant_get("prediction", "$.event_type", "string").alias("event_type"), F.try_variant_get("prediction", "$.article_summary", "string").alias("article_summary"))


@query
def json_lines_roundtrip(spark, d):
    """Labelled rows written as JSON lines and read back."""
    path = new_path(spark, "labelled")
    _labelled(spark, d).select("id", "predicted_direction", "price_label", "correct").write.json(path)
    got = files.json_lines(spark, path)
    field = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind).alias(name)
    return got.select(field("id", "long"), field("predicted_direction", "string"), field("price_label", "string"), field("correct", "boolean"))


@query
def price_csv_roundtrip(spark, d):
    """The prices in cents, written as CSV and loaded again."""
    path = new_path(spark, "csv")
    rows = roles.asof_prices(spark, d).select(F.col("ticker").alias("Stock Code"), F.date_format("day", "yyyy-MM-dd").alias("Date"), F.floor(F.col("price") * 100).cast("string").alias("Day's Final Price"))
    rows.write.option("header", True).csv(path)
    return asof.latest_prices(files.price_csv(spark, path), F.col("line"))


@query
def date_spine_missing(spark, d):
    """The days between the first and the last order on which nothing was ordered."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    span = orders.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    there = orders.select(F.concat(F.date_format("day", "dd-MMMM-yyyy"), F.lit(".xls")).alias("file_name")).distinct()
    return files.missing_files(files.date_spine(spark, str(span["a"] or "1970-01-02"), str(span["b"] or "1970-01-01")), there)


def _events(spark, d):
    return streams.file_queue(spark, d, table(spark, d, "events").schema, "events.parquet")


@query
def stream_dedup(spark, d):
    """Users of the event stream, each once."""
    stream = streams.deduplicated(_events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])
    return streams.run_available(stream, new_path(spark, "dedup"), new_path(spark, "stream"))


@query
def stream_daily_window(spark, d):
    """Daily means by event type, of all windows."""
    stream = streams.daily_means(_events(spark, d), "event_type", "ts", "value")
    return _rounded(streams.run_available(stream, new_path(spark, "daily"), new_path(spark, "stream"), "update", ["event_type", "day"]), "mean")


@query
def stream_chained_alerts(spark, d):
    """Each batch is scored and stored, and alerts are made of what was stored."""
    scored, alerts = new_path(spark, "scored"), new_path(spark, "alerts")
    steps = [(lambda b: b.select("event_id", (F.col("value") / 100).alias("score")), scored), (lambda b: b.where("score >= 0.7").select("event_id", F.round("score", 6).alias("score")), alerts)]
    streams.chained(_events(spark, d), steps, new_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(alerts).drop("batch")


@query
def gbt_predictions(spark, d):
    """Each ticker's model trained, stored and loaded, and its probability of a rise from its last features."""
    frame, path = materialize(_frame(spark, d), "features"), new_path(spark, "models")
    model.save(model.train(frame), path)
    return model.predict_latest(model.load(spark, path), frame)


@query
def gbt_accuracy(spark, d):
    """The share of each ticker's held-out days its model is right on."""
    return model.train(materialize(_frame(spark, d), "features")).select("ticker", "n_train", "n_test", F.round("accuracy", 6).alias("accuracy"))


@query
def synthetic_metrics(spark, d):
    """Metrics of generated labelled rows."""
    return metrics.by_confidence(files.synthetic_predictions(spark))


FLAGSHIP: Query = accuracy_by_confidence
