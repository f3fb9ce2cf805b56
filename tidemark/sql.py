"""SQL of the core queries, for an independent engine over the same tables."""

_PRICES = """SELECT l_suppkey::VARCHAR AS ticker, l_shipdate::DATE AS day,
 sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS close,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume
 FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL GROUP BY 1, 2"""
_PREDICTIONS = """SELECT o_orderkey AS id, (o_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS ticker, o_orderdate::DATE AS article_day,
 CASE WHEN o_orderpriority[1] < '3' THEN 'UP' WHEN o_orderpriority[1] < '5' THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction,
 (o_orderkey * 37 % 101) / 100.0::DOUBLE AS predicted_confidence, o_orderstatus AS impact_type FROM orders"""
_MOVED = f"""prices AS ({_PRICES}), preds AS ({_PREDICTIONS}),
 a AS (SELECT p.id, min(q.day) AS t0_day, min_by(q.close, q.day) AS price_t0 FROM preds p JOIN prices q ON p.ticker = q.ticker AND q.day BETWEEN p.article_day AND p.article_day + 5 GROUP BY p.id),
 b AS (SELECT p.id, min(q.day) AS tn_day, min_by(q.close, q.day) AS price_tn FROM preds p JOIN a ON a.id = p.id JOIN prices q ON p.ticker = q.ticker AND q.day BETWEEN a.t0_day + 3 AND a.t0_day + 8 GROUP BY p.id),
 moved AS (SELECT p.*, a.t0_day, a.price_t0, b.tn_day, b.price_tn, CASE WHEN price_t0 <> 0 THEN (price_tn - price_t0) / price_t0 * 100 END AS pct_change FROM preds p LEFT JOIN a USING (id) LEFT JOIN b USING (id)),
 labelled AS (SELECT *, CASE WHEN pct_change >= 1.5 THEN 'UP' WHEN pct_change <= -1.5 THEN 'DOWN' ELSE 'NEUTRAL' END AS price_label FROM moved),
 l AS (SELECT *, predicted_direction = price_label AS correct FROM labelled)"""
# The object of each extraction as JSON: the struct, or what its reply holds, be it quoted or set in other text.
_OBJECTS = """r AS (SELECT extraction_id, CASE WHEN json_valid(raw_reply) THEN CASE WHEN json_type(raw_reply) = 'VARCHAR' THEN raw_reply::JSON->>'$' ELSE raw_reply END
  ELSE regexp_extract(raw_reply, '\\{.*\\}', 0, 's') END AS t FROM extractions WHERE prediction IS NULL AND raw_reply IS NOT NULL),
 j AS (SELECT extraction_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN CASE WHEN json_exists(t, '$.prediction') THEN t::JSON->'$.prediction' ELSE t::JSON END END END AS p FROM r
  UNION ALL SELECT extraction_id, to_json(prediction) AS p FROM extractions WHERE prediction IS NOT NULL),
 o AS (SELECT extraction_id, p FROM j WHERE p IS NOT NULL AND json_type(p) = 'OBJECT'),
 l AS (SELECT extraction_id, k, CASE json_type(x) WHEN 'ARRAY' THEN from_json(x, '["JSON"]') WHEN 'OBJECT' THEN [x] ELSE [] END AS xs
  FROM (SELECT extraction_id, k, p->('$.' || k) AS x FROM o, unnest(['directly_affected', 'indirectly_affected']) u(k)) WHERE x IS NOT NULL),
 e AS (SELECT extraction_id, k, unnest(xs) AS e, generate_subscripts(xs, 1) - 1 AS pos FROM l)"""
_ENTRY = ("ticker", "company", "impact_type", "direction", "confidence", "reasoning")
_FIELDS = {"macro_flags": ("currency_risk", "interest_rate_sensitive", "commodity_price_sensitive", "regulatory_change"), "data_quality": ("article_date", "source_credibility", "ambiguity_notes")}


def _leaf(x: str, field: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{field}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {x}->>'$.{field}' END"


def _flat(kind: str) -> str:
    if kind in _FIELDS:
        columns = ", ".join(f"{_leaf('x', f)} AS {f}" for f in _FIELDS[kind])
        return f"WITH {_OBJECTS} SELECT extraction_id, {columns} FROM (SELECT extraction_id, p->'$.{kind}' AS x FROM o) WHERE x IS NOT NULL AND json_type(x) <> 'NULL'"
    columns = ", ".join(f"{_leaf('e', f)} AS {f}" for f in _ENTRY)
    return f"WITH {_OBJECTS} SELECT extraction_id, pos::BIGINT AS pos, {columns} FROM e WHERE k = '{kind}' AND e IS NOT NULL AND json_type(e) <> 'NULL'"


_P1_FIELDS = " UNION ALL ".join(f"SELECT extraction_id, '{k}' AS child_kind, 0 AS pos, '{f}' AS child_key FROM o WHERE json_type(p, '$.{k}.{f}') <> 'NULL'" for k, fs in _FIELDS.items() for f in fs)
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY time)"
_SERIES = f"series AS (SELECT ticker, day AS time, close, volume FROM ({_PRICES}))"
_SENTIMENT = "sentiment AS (SELECT (o_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS ticker, o_orderdate AS created_at, ((o_orderkey * 37) % 201 - 100) / 100.0::DOUBLE AS sentiment_score FROM orders)"
_RSI = """rsi AS (SELECT ticker, time, close, volume, CASE WHEN len(g) = 0 OR (u = 0 AND d = 0) THEN NULL WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / d) END AS rsi_14 FROM (
 SELECT *, CASE WHEN len(g) > 0 THEN list_reduce(g, lambda a, x: (1 - 1.0::DOUBLE / 14) * a + (1.0::DOUBLE / 14) * x) END AS u, CASE WHEN len(g) > 0 THEN list_reduce(m, lambda a, x: (1 - 1.0::DOUBLE / 14) * a + (1.0::DOUBLE / 14) * x) END AS d FROM (
 SELECT *, list(greatest(delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (PARTITION BY ticker ORDER BY time) AS g, list(greatest(-delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (PARTITION BY ticker ORDER BY time) AS m
 FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY time) AS delta FROM near))))"""
_FRAME = f"""{_SERIES}, {_SENTIMENT}, near AS (SELECT * FROM series WHERE time IS NOT NULL),
 daily AS (SELECT ticker, created_at::DATE AS time, avg(sentiment_score) AS score FROM sentiment WHERE created_at::DATE BETWEEN (SELECT min(time) FROM series) - 10 AND (SELECT max(time) FROM series) GROUP BY 1, 2), {_RSI},
 base AS (SELECT ticker, time, close, volume, rsi_14, close / lag(close) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d, close / lag(close, 20) OVER w - 1 AS ret_20d, volume / lag(volume) OVER w - 1 AS vol_change,
  CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY time ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (PARTITION BY ticker ORDER BY time ROWS 19 PRECEDING) END AS sma_20,
  coalesce((lead(close) OVER w > close)::INT, 0) AS target FROM rsi {_W}),
 joined AS (SELECT b.*, coalesce(d.score, 0.0) AS score, b.ticker IN (SELECT ticker FROM daily) AS heard FROM base b LEFT JOIN daily d ON b.ticker = d.ticker AND b.time = d.time),
 trend AS (SELECT *, CASE WHEN NOT heard THEN 0.0 WHEN count(score) OVER (PARTITION BY ticker ORDER BY time ROWS 2 PRECEDING) = 3 THEN avg(score) OVER (PARTITION BY ticker ORDER BY time ROWS 2 PRECEDING) END AS score_trend_3d FROM joined),
 frame AS (SELECT * EXCLUDE (heard) FROM trend WHERE COLUMNS(* EXCLUDE (heard)) IS NOT NULL)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("close", "rsi_14", "ret_1d", "ret_5d", "ret_20d", "vol_change", "sma_20", "score", "score_trend_3d"))
_SHORT = "trim(replace(replace(replace(replace(name, ' Limited', ''), ' PLC', ''), ' Plc', ''), ' Ltd', ''))"
_CLASSES = "(VALUES ('UP'), ('DOWN'), ('NEUTRAL')) k(class)"
_CONFUSION = f"conf AS (SELECT class, count(*) FILTER (WHERE predicted_direction = class AND price_label = class) AS tp, count(*) FILTER (WHERE predicted_direction = class AND price_label <> class) AS fp, count(*) FILTER (WHERE predicted_direction <> class AND price_label = class) AS fn FROM l, {_CLASSES} GROUP BY class)"


def _group(column: str, tail: str = "") -> str:
    return f"WITH {_MOVED} SELECT coalesce(nullif({column}, ''), 'unknown') AS \"group\", round(avg(correct::INT), 4) AS accuracy, count(*) AS n FROM l GROUP BY 1 {tail}"


# The permitted event types, directions and impact types.
_EVENTS = "('earnings', 'regulation', 'product_launch', 'disaster', 'merger_acquisition', 'macro', 'legal', 'management_change', 'other')"
_DIRECTIONS = "('UP', 'DOWN', 'NEUTRAL')"
_IMPACTS = "('direct', 'competitor', 'sector_spillover', 'supplier_chain', 'regulatory')"
_GROUP = "CASE json_type(p, '$.{0}') WHEN 'ARRAY' THEN from_json(p->'$.{0}', '[\"JSON\"]') ELSE [] END"
_ERRORS = f"""{_OBJECTS}, b AS (SELECT x.extraction_id, p, {_GROUP.format("directly_affected")} AS ds, {_GROUP.format("indirectly_affected")} AS ins, known FROM extractions x LEFT JOIN o USING (extraction_id), (SELECT list(ticker) AS known FROM companies)),
 errs AS (SELECT extraction_id, (p IS NULL)::INT AS n_no_object, (p IS NOT NULL AND NOT coalesce(p->>'$.event_type' IN {_EVENTS}, false))::INT AS n_event_type,
 coalesce((json_type(p, '$.directly_affected') NOT IN ('ARRAY', 'NULL'))::INT, 0) + coalesce((json_type(p, '$.indirectly_affected') NOT IN ('ARRAY', 'NULL'))::INT, 0) AS n_no_list,
 len(list_filter(ds || ins, lambda e: NOT coalesce(list_contains(known, e->>'$.ticker'), false))) AS n_ticker, len(list_filter(ds || ins, lambda e: NOT coalesce(e->>'$.direction' IN {_DIRECTIONS}, false))) AS n_direction,
 len(list_filter(ds || ins, lambda e: NOT coalesce(e->>'$.impact_type' IN {_IMPACTS}, false))) AS n_impact_type,
 len(list_filter(ds || ins, lambda e: NOT coalesce(json_type(e, '$.confidence') IN ('BOOLEAN', 'DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') AND TRY_CAST(replace(replace(e->>'$.confidence', 'true', '1'), 'false', '0') AS DOUBLE) BETWEEN 0 AND 1, false))) AS n_confidence,
 (len(list_intersect(list_transform(ds, lambda e: coalesce(e->>'$.ticker', '<null>')), list_transform(ins, lambda e: coalesce(e->>'$.ticker', '<null>')))) > 0)::INT AS n_both FROM b)"""
_ENTITIES = f"""{_OBJECTS}, ent AS (SELECT e.extraction_id, k AS "group", pos, p->>'$.data_quality.article_date' AS article_date, e->>'$.ticker' AS ticker, e->>'$.direction' AS direction FROM e JOIN o USING (extraction_id) WHERE e IS NOT NULL AND json_type(e) <> 'NULL')"""
_PRINTED = r"""printed AS (SELECT upper(regexp_replace("Stock Code", '^\s+|\s+$', '', 'g')) AS ticker, regexp_replace("Date", '^\s+|\s+$', '', 'g') AS d, lower(regexp_replace(replace("Day's Final Price", ',', ''), '^\s+|\s+$', '', 'g')) AS t, price_id FROM prices),
 days AS (SELECT ticker, try_strptime(d, '%Y-%m-%d')::DATE AS day, TRY_CAST(t AS DOUBLE) AS price, price_id FROM printed WHERE ticker <> '' AND regexp_full_match(d, '\d{4}-\d{1,2}-\d{1,2}') AND regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(nan|inf(inity)?)')),
 ps AS (SELECT ticker, day, price FROM days WHERE day IS NOT NULL AND price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY price_id DESC) = 1)"""


SQL: dict[str, str] = {
    **{f"p1_{k}": _flat(k) for k in ("directly_affected", "indirectly_affected", *_FIELDS)},
    "p1_found": f"""WITH {_OBJECTS} SELECT extraction_id, k AS child_kind, pos::BIGINT AS pos, coalesce(e->>'$.ticker', '') AS child_key FROM e WHERE e IS NOT NULL AND json_type(e) <> 'NULL'
 UNION ALL SELECT extraction_id, child_kind, pos::BIGINT AS pos, child_key FROM ({_P1_FIELDS})""",
    "daily_prices": f"SELECT ticker, day, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, volume FROM ({_PRICES})",
    "price_change_forward_asof": f"WITH {_MOVED} SELECT id, ticker, t0_day, round(price_t0, 6) AS price_t0, tn_day, round(price_tn, 6) AS price_tn, round(pct_change, 6) AS pct_change FROM moved",
    "labeled_predictions": f"WITH {_MOVED} SELECT id, predicted_direction, price_label, correct FROM l",
    "accuracy_overall": f"WITH {_MOVED} SELECT count(*) AS total_predictions, round(avg(correct::INT), 4) AS overall_accuracy FROM l",
    "accuracy_by_confidence": f"""WITH {_MOVED} SELECT band, coalesce(round(avg(correct::INT), 4), 0.0) AS accuracy, count(id) AS n FROM (VALUES ('low (<0.50)'), ('medium (0.50-0.70)'), ('high (>0.70)')) v(band)
 LEFT JOIN l ON band = CASE WHEN predicted_confidence < 0.5 THEN 'low (<0.50)' WHEN predicted_confidence <= 0.7 THEN 'medium (0.50-0.70)' ELSE 'high (>0.70)' END GROUP BY band""",
    "accuracy_by_impact": _group("impact_type"),
    "accuracy_by_ticker_top15": _group("ticker", 'ORDER BY n DESC, "group" LIMIT 15'),
    "direction_distribution": f"WITH {_ENTITIES} SELECT class, count(direction) AS n FROM {_CLASSES} LEFT JOIN ent ON direction = class GROUP BY class",
    "entity_labels": f"""WITH {_ENTITIES}, {_PRINTED}, x AS (SELECT *, CASE WHEN regexp_full_match(left(article_date, 10), '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime(left(article_date, 10), '%Y-%m-%d')::DATE END AS article_day FROM ent),
 a AS (SELECT x.ticker, article_day, min(day) AS t0_day, min_by(price, day) AS p0 FROM (SELECT DISTINCT ticker, article_day FROM x) x JOIN ps ON ps.ticker = x.ticker AND day BETWEEN article_day AND article_day + 5 GROUP BY 1, 2),
 b AS (SELECT a.ticker, article_day, any_value(t0_day) AS t0_day, any_value(p0) AS p0, min(day) AS tn_day, min_by(price, day) AS pn FROM a LEFT JOIN ps ON ps.ticker = a.ticker AND day BETWEEN t0_day + 3 AND t0_day + 8 GROUP BY 1, 2),
 m AS (SELECT x.*, t0_day, tn_day, CASE WHEN p0 <> 0 THEN (pn - p0) / p0 * 100 END AS pct_change FROM x LEFT JOIN b ON x.ticker = b.ticker AND x.article_day = b.article_day),
 lab AS (SELECT *, CASE WHEN isnan(pct_change) THEN 'NEUTRAL' WHEN pct_change >= 1.5 THEN 'UP' WHEN pct_change <= -1.5 THEN 'DOWN' ELSE 'NEUTRAL' END AS price_label FROM m)
 SELECT extraction_id, "group", pos::INTEGER AS pos, ticker, article_day, t0_day, tn_day, round(pct_change, 6) AS pct_change, price_label, coalesce(direction IN {_DIRECTIONS} AND direction = price_label, false) AS correct FROM lab""",
    "confusion_per_class": f"WITH {_MOVED}, {_CONFUSION} SELECT * FROM conf",
    "precision_recall_f1": f"""WITH {_MOVED}, {_CONFUSION}, pr AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, tp + fn AS support FROM conf)
 SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, support FROM pr""",
    "returns_1_5_20": f"WITH {_SERIES} SELECT ticker, time, round(close / lag(close) OVER w - 1, 6) AS ret_1d, round(close / lag(close, 5) OVER w - 1, 6) AS ret_5d, round(close / lag(close, 20) OVER w - 1, 6) AS ret_20d FROM series {_W}",
    "volume_change": f"WITH {_SERIES} SELECT ticker, time, round(volume / lag(volume) OVER w - 1, 6) AS vol_change FROM series {_W}",
    "sma_20": f"WITH {_SERIES} SELECT ticker, time, CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY time ROWS 19 PRECEDING) = 20 THEN round(avg(close) OVER (PARTITION BY ticker ORDER BY time ROWS 19 PRECEDING), 6) END AS sma_20 FROM series",
    "rsi_14": f"WITH {_SERIES}, near AS (SELECT * FROM series), {_RSI} SELECT ticker, time, round(rsi_14, 6) AS rsi_14 FROM rsi",
    "next_day_target": f"WITH {_SERIES} SELECT ticker, time, coalesce((lead(close) OVER w > close)::INT, 0) AS target FROM series {_W}",
    "sentiment_daily": f"WITH {_SENTIMENT} SELECT ticker, created_at::DATE AS time, round(avg(sentiment_score), 6) AS score FROM sentiment GROUP BY 1, 2",
    "feature_frame": f"WITH {_FRAME} SELECT ticker, time, volume, target, {_ROUNDED} FROM frame",
    "latest_features": f"WITH {_FRAME} SELECT ticker, time, volume, target, {_ROUNDED} FROM frame QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY time DESC) = 1",
    "chronological_split_counts": f"WITH {_SERIES} SELECT ticker, ceil(count(*) * 0.2::DOUBLE)::BIGINT AS n_test, count(*) - ceil(count(*) * 0.2::DOUBLE)::BIGINT AS n_train FROM series GROUP BY ticker",
    "trainable_tickers": f"WITH {_SERIES} SELECT ticker, count(*) AS n FROM series GROUP BY ticker HAVING count(*) >= 50",
    "sector_peers": "SELECT a.ticker, b.ticker AS peer FROM companies a JOIN companies b ON a.sector = b.sector AND a.ticker <> b.ticker",
    "competitor_pairs": "SELECT * FROM (SELECT ticker_1 AS ticker, ticker_2 AS competitor FROM relationships UNION SELECT ticker_2, ticker_1 FROM relationships) WHERE ticker IN (SELECT ticker FROM companies) AND competitor IN (SELECT ticker FROM companies)",
    "news_dedup_hash": "SELECT min(id) AS id, md5(title || coalesce(content, 'None')) AS content_hash FROM news_articles WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> '' GROUP BY 2",
    "news_dedup_stored_hash": """WITH h AS (SELECT id, md5(title || coalesce(content, 'None')) AS content_hash, batch_no FROM news_articles WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> '')
 SELECT min(id) AS id, content_hash FROM h WHERE batch_no > 0 AND content_hash NOT IN (SELECT content_hash FROM h WHERE batch_no = 0) GROUP BY content_hash""",
    "news_dedup_first_url": "SELECT min(id) AS id, url FROM news_articles WHERE coalesce(url, '') <> '' AND batch_no > 0 AND url NOT IN (SELECT url FROM news_articles WHERE batch_no = 0 AND url IS NOT NULL) GROUP BY url",
    "news_union_sources": "SELECT id, source_rank FROM (SELECT id, coalesce(url, '') AS url, (batch_no % 2)::INT AS source_rank FROM news_articles WHERE batch_no % 2 = 0 OR coalesce(url, '') <> '') QUALIFY row_number() OVER (PARTITION BY url ORDER BY source_rank, id) = 1",
    "price_upsert": r"""WITH r AS (SELECT regexp_replace("Stock Code", '^\s+|\s+$', '', 'g') AS code, "Date" AS date, "Day's Final Price" AS price, price_id FROM prices WHERE "Stock Code" IS NOT NULL AND "Date" IS NOT NULL)
 SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY price_id % 2 DESC, price_id DESC) = 1""",
    "ticker_text_match": f"WITH c AS (SELECT ticker, lower({_SHORT}) AS n FROM companies) SELECT id, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM c WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(content, '')), n)), 'MULTIPLE') AS matched FROM news_articles",
    "short_text_filter": "SELECT id FROM news_articles WHERE length(coalesce(content, '') || coalesce(description, '') || coalesce(title, '')) >= 50",
    "truncated_text": "SELECT id, md5(t) AS text_md5, length(t) AS n FROM (SELECT id, left(coalesce(nullif(content, ''), nullif(description, ''), nullif(title, ''), ''), 2000) AS t FROM news_articles)",
    "query_strings": f"SELECT chunk, '(' || string_agg('\"' || n || '\"', ' OR ' ORDER BY r) || ')' AS query FROM (SELECT r, n, (r - 1) // 15 AS chunk FROM (SELECT {_SHORT} AS n, row_number() OVER (ORDER BY ticker) AS r FROM companies)) GROUP BY chunk",
    "price_validity": f"SELECT ticker, day, close >= 0 AND high >= 0 AND low >= 0 AND volume >= 0 AND low <= high AS ok FROM ({_PRICES})",
    "prediction_validity_errors": f"WITH {_ERRORS} SELECT * FROM errs",
    "valid_invalid_split": f"WITH {_ERRORS}, s AS (SELECT n_no_object + n_no_list + n_event_type + n_ticker + n_direction + n_impact_type + n_confidence + n_both AS n FROM errs) SELECT count(*) FILTER (WHERE n = 0) AS n_valid, count(*) FILTER (WHERE n > 0) AS n_invalid FROM s",
    "name_normalise": rf"SELECT ticker, trim(regexp_replace(name || ' Ord 1_00', '\s+[Oo]rd[\s._].*$', '')) AS bare, {_SHORT} AS short, regexp_replace(name || ' Ord 1_00', '[^\p{{L}}\p{{N}} _-]', '_', 'g') AS file_name FROM companies",
    "date_normalise": r"""WITH s AS (SELECT price_id, regexp_replace("Date", '^\s+|\s+$', '', 'g') AS t FROM prices)
 SELECT price_id, day FROM (SELECT price_id, CASE WHEN regexp_full_match(t, '\d{1,2}-[A-Za-z]+-\d{4}') THEN try_strptime(t, '%d-%B-%Y') WHEN regexp_full_match(t, '\d{4}-\d{1,2}-\d{1,2}') THEN try_strptime(t, '%Y-%m-%d')
 WHEN regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(t, '%d/%m/%Y') WHEN regexp_full_match(t, '\d{1,2}-\d{1,2}-\d{4}') THEN try_strptime(t, '%d-%m-%Y') END::DATE AS day FROM s) WHERE day IS NOT NULL""",
    "price_numbers": r"""WITH s AS (SELECT price_id, lower(regexp_replace(replace("Day's Final Price", ',', ''), '^\s+|\s+$', '', 'g')) AS t FROM prices)
 SELECT price_id, round(t::DOUBLE, 6) AS price FROM s WHERE regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?')""",
    "ticker_lookup": r"""WITH n AS (SELECT upper(name) || '  Ord 5.00' AS security FROM companies UNION SELECT ticker_2 FROM relationships)
 SELECT security, ticker FROM n LEFT JOIN companies ON lower(trim(regexp_replace(security, '\s+[Oo]rd[\s._].*$', ''))) = lower(trim(regexp_replace(name, '\s+[Oo]rd[\s._].*$', '')))""",
    "ticker_ilike_match": r"""WITH s AS (SELECT row_number() OVER (ORDER BY ticker) AS id, ticker FROM companies), r AS (SELECT price_id, regexp_replace("Stock Code", '^\s+|\s+$', '', 'g') AS t FROM prices),
 p AS (SELECT t, min(id) AS symbol_id FROM (SELECT DISTINCT t FROM r WHERE t <> '') JOIN s ON ticker ILIKE '%' || t || '%' GROUP BY t) SELECT price_id, symbol_id FROM r LEFT JOIN p USING (t)""",
    "reply_json": r"""WITH b AS (SELECT extraction_id, trim(regexp_replace(regexp_replace(trim(raw_reply, E' \n\r\t'), '^```(json)?\s*', ''), '\s*```$', ''), E' \n\r\t') AS t FROM extractions WHERE raw_reply IS NOT NULL),
 c AS (SELECT extraction_id, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '\{.*\}', 0, 's') END AS j FROM b) SELECT extraction_id, CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END AS is_object FROM c""",
    "published_calendar": r"""WITH b AS (SELECT id, regexp_replace(published_at, '(Z|[+-]\d{2}:\d{2})$', '') AS t FROM news_articles)
 SELECT id, strftime(coalesce(CASE length(t) WHEN 19 THEN coalesce(try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d %H:%M:%S')) WHEN 10 THEN try_strptime(t, '%Y-%m-%d') END, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS published FROM b""",
    "unmatched_names": "SELECT DISTINCT ticker_2 AS name FROM relationships WHERE ticker_2 NOT IN (SELECT ticker FROM companies)",
    "latest_100_alerts": """SELECT o_orderkey, c_name || ' ' || printf('%.1f', p * 100) || '% ' || CASE WHEN p > 0.5 THEN 'BUY/UP' ELSE 'SELL/DOWN' END AS message
 FROM (SELECT *, (o_orderkey * 37 % 101) / 100.0::DOUBLE AS p FROM orders ORDER BY o_orderkey DESC LIMIT 100) JOIN customer ON o_custkey = c_custkey WHERE p >= 0.7""",
    "event_props_json": "SELECT event_id, coalesce((props::JSON ->> '$.k')::DOUBLE, 0.0) AS k FROM events",
    "json_lines_roundtrip": f"WITH {_MOVED} SELECT id, predicted_direction, price_label, correct FROM l",
    "price_csv_roundtrip": f"SELECT ticker, day, floor(close * 100)::DOUBLE AS price FROM ({_PRICES})",
    "date_spine_missing": "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), g AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d) SELECT day, strftime(day, '%d-%B-%Y') || '.xls' AS file_name FROM g WHERE day NOT IN (SELECT day FROM d)",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_daily_window": "SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_chained_alerts": "SELECT event_id, round(value / 100, 6) AS score FROM events WHERE value / 100 >= 0.7",
    "api_articles": "SELECT coalesce(title, '') AS title, coalesce(description, '') AS description, coalesce(content, '') AS content, coalesce(url, '') AS url, coalesce(published_at, '') AS published_at, coalesce(source_name, '') AS source_name FROM news_articles WHERE id % 7 <> 0",
    "graph_companies": "SELECT ticker, name, sector FROM companies WHERE NOT ticker < 'M'",
    "file_name_tickers": r"SELECT regexp_replace(name, '[^\p{L}\p{N} _-]', '_', 'g') || ' Ord 5_00' AS file_stem, ticker FROM companies UNION ALL SELECT 'No such firm Ord 1_00', NULL",
    "generated_prices": "SELECT ticker, DATE '2024-01-02' AS day, true AS fine, true AS high_ok FROM companies",
    "labeled_rows_with_key": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'UP' END AS direction FROM events WHERE event_id % 3 <> 0",
    "security_cells": "SELECT trim(name || ' Ord 5.00 ') AS security, trim(name) AS bare, 'v0-' || ticker AS shares, 'v4-' || ticker AS low FROM companies WHERE length(name) % 3 <> 0",
    "unwrapped_predictions": "SELECT prediction.event_type AS event_type, prediction.article_summary AS article_summary FROM extractions WHERE prediction IS NOT NULL",
}
