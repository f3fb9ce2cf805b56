"""SQL for the queries of this subpackage that SQL can express over whole tables."""

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_ARTICLE = _WORDS.format("coalesce(title, '') || ' ' || coalesce(content, '')")

SQL: dict[str, str] = {
    "p6_found": f"""WITH w AS (SELECT id, list_distinct({_ARTICLE}) AS s FROM news_articles)
 SELECT a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.id < b.id AND len(a.s) >= 0.7 * len(b.s) AND len(b.s) >= 0.7 * len(a.s)
 WHERE len(list_intersect(a.s, b.s)) >= 0.7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))""",
    "p8_found": f"""WITH d AS (SELECT doc_id AS k, {_WORDS.format("text")} AS s FROM documents), i AS (SELECT item_id AS k, {_WORDS.format("text")} AS s FROM eval_items),
 dg AS (SELECT k, array_to_string(s[p:p + 12], ' ') AS g FROM d, unnest(range(1, len(s) - 11)) r(p)), ig AS (SELECT k, array_to_string(s[p:p + 12], ' ') AS g FROM i, unnest(range(1, len(s) - 11)) r(p))
 SELECT DISTINCT dg.k AS doc_id, ig.k AS item_id FROM dg JOIN ig USING (g)""",
    "p8_proximity": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS s FROM documents), p AS (SELECT doc_id, unnest(s) AS w, unnest(range(len(s))) AS p FROM d),
 i AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS w FROM eval_items), f AS (SELECT w, count(*) AS df FROM p WHERE w IN (SELECT w FROM i) GROUP BY w),
 r AS (SELECT item_id, w FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY df, encode(w)) AS k FROM i JOIN f USING (w)) WHERE k <= 8),
 h AS (SELECT item_id, doc_id, w, p FROM r JOIN p USING (w)),
 n AS (SELECT a.item_id, a.doc_id, a.p, count(DISTINCT b.w) AS n FROM h a JOIN h b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 59 GROUP BY a.item_id, a.doc_id, a.p)
 SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS n_terms FROM n WHERE n >= 6 GROUP BY doc_id, item_id""",
}
