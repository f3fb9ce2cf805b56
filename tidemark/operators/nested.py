"""Deeply nested records as related flat tables, linked by interval labels.

A depth-first walk gives every node of a record a pre-order and a post-order number from one running counter. A node
lies below another exactly when its interval lies inside the other's, so any parent-child (or ancestor) link between the
emitted tables is a containment test and no key columns have to be threaded through the levels.

``label_nodes`` walks each record once, in Arrow batches, and emits its nodes; ``node_table`` takes the nodes of one type
with the interval of the container they belong to; ``link_tables`` links any two such tables later.

Defined results: a null record, an unreadable text and an empty object have no child nodes. Null entries of a list keep
their place but make no node. A lone object where a list is expected is a list of one. Repeated entries stay repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LISTS = ("directly_affected", "indirectly_affected")
# The named fields of the two structs and of the entries of the two lists.
STRUCTS = {
    "macro_flags": ("currency_risk", "interest_rate_sensitive", "commodity_price_sensitive", "regulatory_change"),
    "data_quality": ("article_date", "source_credibility", "ambiguity_notes"),
}
ENTRY = ("ticker", "company", "impact_type", "direction", "confidence", "reasoning")
_DECODER = json.JSONDecoder()


def read_object(text: str | None, depth: int = 4) -> dict | None:
    """The one whole JSON object that can be read from ``text``, or None.

    The text may be the object, a JSON string that quotes it, or other text that holds it. An object that breaks off
    holds none, whatever whole objects lie inside it. Up to ``depth`` quotings are opened.
    """
    if not text or depth == 0:
        return None
    text = text.strip()
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = _DECODER.raw_decode(text, at)
                return value if isinstance(value, dict) else None
            except RecursionError:
                return None
            except ValueError:
                if text[at + 1 :].lstrip()[:1] in ('"', "}", "", "\\"):
                    quoted = text.rfind('"', 0, at)
                    return _quoted(text, quoted, depth)
                at = text.find("{", at + 1)
        return None
    if isinstance(value, str):
        return read_object(value, depth - 1)
    return value if isinstance(value, dict) else None


def _quoted(text: str, at: int, depth: int) -> dict | None:
    """An object quoted as a JSON string inside other text, its quote mark at ``at``."""
    if at < 0:
        return None
    try:
        value, _ = _DECODER.raw_decode(text, at)
    except ValueError:
        return None
    return read_object(value, depth - 1) if isinstance(value, str) else None


def reply_record(text: str | None) -> object:
    """The record that a reply holds: its object, or what stands under that object's key ``prediction``."""
    value = read_object(text)
    if value is not None and "prediction" in value:
        value = value["prediction"]
        value = read_object(value) if isinstance(value, str) else value
    return value


def walk(record: dict, root: str = "prediction") -> list[tuple[str, str, int, int, int, int, bool, str | None]]:
    """Nodes (type, name, pos, depth, pre, post, is_leaf, value) of one record in depth-first order.

    ``type`` is the path without list places, ``pos`` the place in the enclosing list (0 elsewhere), ``value`` the text
    of a leaf. Null values take a place in a list but get no node. The walk keeps its own stack, so depth is no limit.
    """
    out: list[list] = []
    counter = 0
    stack: list[tuple] = [(root, root, 0, 0, record, None)]
    while stack:
        kind, name, pos, depth, value, opened = stack.pop()
        counter += 1
        if opened is not None:
            out[opened][5] = counter
            continue
        leaf = not isinstance(value, dict | list)
        text = (value if isinstance(value, str) else json.dumps(value)) if leaf else None
        out.append([kind, name, pos, depth, counter, 0, leaf, text])
        stack.append((kind, name, pos, depth, None, len(out) - 1))
        if isinstance(value, dict):
            children = [(f"{kind}.{k}", k, 0, depth + 1, v, None) for k, v in value.items() if v is not None]
        elif isinstance(value, list):
            children = [(f"{kind}[]", name, i, depth + 1, v, None) for i, v in enumerate(value) if v is not None]
        else:
            children = []
        stack.extend(reversed(children))
    return [tuple(x) for x in out]


def _as_lists(record: dict) -> dict:
    """The lists of the record with a lone object made a list of one."""
    return {k: [v] if k in LISTS and isinstance(v, dict) else v for k, v in record.items()}


def label_nodes(df: DataFrame, id_col: str = "extraction_id", record: str = "prediction", raw: str = "raw_reply") -> DataFrame:
    """Nodes of every record: (id, node_type, name, pos, depth, pre, post, is_leaf, value), id repeated for each node.

    The record is the struct, or where that is null the object its raw text holds; an object with the key ``prediction``
    stands for that key's value.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"), F.when(F.col(record).isNull(), F.col(raw)).alias("raw"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, out = [], []
            for key, record_text, raw_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if record_text is not None:
                    value = json.loads(record_text)
                else:
                    value = reply_record(raw_text)
                if not isinstance(value, dict):
                    continue
                nodes = walk(_as_lists(value))
                ids.extend([key] * len(nodes))
                out.extend(nodes)
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "node_type", "name", "pos", "depth", "pre", "post", "is_leaf", "value"])

    return rows.mapInArrow(batches, "id long, node_type string, name string, pos long, depth int, pre long, post long, is_leaf boolean, value string")


def record_json(df: DataFrame, id_col: str = "extraction_id", record: str = "prediction", raw: str = "raw_reply") -> DataFrame:
    """(id_col, record): each row's record as JSON text: the struct, or the object its raw text holds; null if it holds none."""
    rows = df.select(id_col, F.to_json(record).alias("record"), F.when(F.col(record).isNull(), F.col(raw)).alias("raw"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text in batch.column("raw").to_pylist():
                value = reply_record(text)
                out.append(json.dumps(value) if isinstance(value, dict) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "record"])

    typed = rows.where("record is not null").select(id_col, "record")
    return typed.unionByName(rows.where("record is null").select(id_col, "raw").mapInArrow(batches, f"`{id_col}` {dict(df.dtypes)[id_col]}, record string"))


def node_table(nodes: DataFrame, node_type: str, root: str = "prediction") -> DataFrame:
    """The flat table of one node type, e.g. ``directly_affected[]`` or ``macro_flags.currency_risk``."""
    return nodes.where(F.col("node_type") == f"{root}.{node_type}").drop("node_type")


def link_tables(parents: DataFrame, children: DataFrame, parent_cols: dict[str, str]) -> DataFrame:
    """``children`` with columns of the node of ``parents`` whose interval holds theirs, in the same record.

    ``parent_cols`` maps a parent column to the name it gets. An equi-join on the record id; containment is its residual
    condition, so a record's own nodes are all that is ever compared.
    """
    p = parents.select(F.col("id").alias("__id"), F.col("pre").alias("__pre"), F.col("post").alias("__post"), *[F.col(a).alias(b) for a, b in parent_cols.items()])
    holds = (F.col("id") == F.col("__id")) & (F.col("__pre") < F.col("pre")) & (F.col("post") < F.col("__post"))
    return children.join(p, holds, "inner").drop("__id", "__pre", "__post")


def flat_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of ``directly_affected`` or ``indirectly_affected`` (id, pos, a column a field of ``ENTRY``), or of
    ``macro_flags`` or ``data_quality`` (id, a column a named field): a row for each entry or struct, also one without
    fields. Values are text as stored; a field that is no single value is null. A row's fields are the leaves whose
    interval lies in its own."""
    listed = kind in LISTS
    fields = ENTRY if listed else STRUCTS[kind]
    own = f"{kind}[]" if listed else kind
    parents = node_table(nodes, own)
    leaves = nodes.where(F.col("node_type").isin([f"prediction.{own}.{f}" for f in fields]) & F.col("is_leaf"))
    linked = link_tables(parents, leaves, {"pre": "row"}).select("id", "row", "name", "value")
    values = linked.groupBy("id", "row").agg(*[F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in fields])
    rows = parents.select("id", F.col("pre").alias("row"), *(["pos"] if listed else [])).join(values, ["id", "row"], "left")
    return rows.select(F.col("id").alias("extraction_id"), *(["pos"] if listed else []), *fields)


def child_rows(df: DataFrame) -> DataFrame:
    """(extraction_id, child_kind, pos, child_key) of every child of every extraction, see ``label_nodes``.

    Entries of the two lists take their ticker from the leaf that lies inside their interval; fields of the two structs
    are the nodes named in ``STRUCTS``. In pre-order an entry's ticker is the next node kept, so one sweep over each
    record's nodes, sorted by their label, links them; the containment test says whether that leaf is the entry's own.
    """
    entry = [f"prediction.{k}[]" for k in LISTS]
    ticker = [f"{x}.ticker" for x in entry]
    fields = [f"prediction.{k}.{f}" for k, names in STRUCTS.items() for f in names]
    kept = label_nodes(df).where(F.col("node_type").isin(entry + ticker + fields)).select("id", "node_type", "name", "pos", "pre", "post", F.when(F.col("node_type").isin(ticker), F.col("value")).alias("value"))
    sweep = Window.partitionBy("id").orderBy("pre")
    nxt = F.lead(F.struct("node_type", "post", "value")).over(sweep)
    linked = kept.withColumn("leaf", nxt).where(~F.col("node_type").isin(ticker))
    own = F.col("leaf.node_type").isin(ticker) & (F.col("leaf.post") < F.col("post"))
    is_entry = F.col("node_type").isin(entry)
    return linked.select(
        F.col("id").alias("extraction_id"),
        F.when(is_entry, F.col("name")).otherwise(F.split("node_type", r"\.")[1]).alias("child_kind"),
        F.when(is_entry, F.col("pos")).otherwise(F.lit(0)).cast("long").alias("pos"),
        F.when(~is_entry, F.col("name")).when(own, F.coalesce("leaf.value", F.lit(""))).otherwise(F.lit("")).alias("child_key"),
    )
