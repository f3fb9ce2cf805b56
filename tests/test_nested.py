"""Interval-labelled nodes: reading replies, labels, containment and child rows."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.nested import child_rows, flat_table, label_nodes, link_tables, node_table, read_object, walk

ENTRY = "struct<ticker:string,company:string,impact_type:string,direction:string,confidence:double,reasoning:string>"
PREDICTION = (
    f"struct<article_summary:string,event_type:string,primary_sector:string,directly_affected:array<{ENTRY}>,indirectly_affected:array<{ENTRY}>,not_nse_listed:array<string>,"
    "macro_flags:struct<currency_risk:boolean,interest_rate_sensitive:boolean,commodity_price_sensitive:boolean,regulatory_change:boolean>,"
    "data_quality:struct<article_date:string,source_credibility:string,ambiguity_notes:string>>"
)


def entry(ticker):
    return (ticker, None, None, None, 0.5, None)


def rows(spark, data):
    return spark.createDataFrame(data, f"extraction_id long, prediction {PREDICTION}, raw_reply string, id string")


def test_read_object():
    inner = json.dumps({"a": 1})
    assert read_object(inner) == {"a": 1}
    assert read_object(json.dumps(inner)) == {"a": 1}
    assert read_object(f"```json\n{inner}\n```") == {"a": 1}
    assert read_object(f"Use {{braces}}: {inner} done") == {"a": 1}
    assert read_object(f"Reply: {json.dumps(inner)}") == {"a": 1}
    for broken in (None, "", "null", "[]", "no", '{"a": [{"b": 1}, {"c"', "[" * 100_000):
        assert read_object(broken) is None


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=12))
def test_labels_are_nested_intervals(value):
    nodes = walk({"x": value})
    for a in nodes:
        for b in nodes:
            inside, prefix = a[4] < b[4] and b[5] < a[5], b[0].startswith(a[0]) and b[3] > a[3]
            assert not (a[4] < b[4] < a[5] < b[5])  # intervals never cross
            if inside:
                assert prefix


def test_child_rows(spark):
    struct = (None, "legal", None, [entry("AB"), None, entry(None), entry("AB")], None, None, (True, None, False, None), ("2024", None, ""))
    raw = json.dumps({"prediction": {"directly_affected": {"ticker": "ZZ"}, "indirectly_affected": [], "macro_flags": None, "data_quality": {"other": 1, "ambiguity_notes": "n"}}})
    data = [(1, struct, None, "clash"), (2, None, f"Sure.\n{raw}", None), (3, None, '{"directly_affected": [{"ticker": "A"}', None), (4, None, None, None), (5, None, '{"prediction": null}', None)]
    got = sorted(tuple(r) for r in child_rows(rows(spark, data)).collect())
    assert got == sorted(
        [(1, "directly_affected", 0, "AB"), (1, "directly_affected", 2, ""), (1, "directly_affected", 3, "AB"), (1, "macro_flags", 0, "currency_risk"), (1, "macro_flags", 0, "commodity_price_sensitive")]
        + [(1, "data_quality", 0, "article_date"), (1, "data_quality", 0, "ambiguity_notes"), (2, "directly_affected", 0, "ZZ"), (2, "data_quality", 0, "ambiguity_notes")]
    )
    assert child_rows(rows(spark, [])).count() == 0


def test_tables_link_by_containment(spark):
    struct = (None, None, None, [entry("AB"), entry("CD")], [entry("EF")], None, None, None)
    nodes = label_nodes(rows(spark, [(1, struct, None, None), (2, struct, None, None)]))
    entries, tickers = node_table(nodes, "directly_affected[]"), node_table(nodes, "directly_affected[].ticker")
    linked = link_tables(entries, tickers, {"pos": "entry_pos"})
    assert sorted((r["id"], r["entry_pos"], r["value"]) for r in linked.collect()) == [(1, 0, "AB"), (1, 1, "CD"), (2, 0, "AB"), (2, 1, "CD")]


def test_flat_tables(spark):
    struct = (None, None, None, [("AB", "Abc", None, "UP", 0.5, None), None, (None,) * 6], None, None, (True, None, None, False), None)
    raw = json.dumps({"directly_affected": {"ticker": "ZZ", "confidence": "high", "reasoning": ["a"]}, "data_quality": {"article_date": 5}})
    nodes = label_nodes(rows(spark, [(1, struct, None, None), (2, None, raw, None), (3, None, None, None)]))
    assert sorted(map(tuple, flat_table(nodes, "directly_affected").collect())) == [(1, 0, "AB", "Abc", None, "UP", "0.5", None), (1, 2, None, None, None, None, None, None), (2, 0, "ZZ", None, None, None, "high", None)]
    assert sorted(map(tuple, flat_table(nodes, "macro_flags").collect())) == [(1, "true", None, None, "false")]
    assert sorted(map(tuple, flat_table(nodes, "data_quality").collect())) == [(2, "5", None, None)]
    assert flat_table(nodes, "indirectly_affected").count() == 0
