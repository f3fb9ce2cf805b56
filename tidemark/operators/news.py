"""News articles: deduplication against stored ones, union of sources, and attribution to companies.

Defined results: null urls and texts count as empty; of repeated rows the first by the given order stays; ties of the order
are broken by the whole row, so results are stable. Names come from a dimension and are taken in blocks of at most
``NAMES_AT_ONCE``: each block is one automaton that a pass over the texts runs through, whatever the number of names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import content_hash, or_query, strip_legal_forms

NAMES_AT_ONCE = 100_000
CHUNK = 15


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def insert_new(target: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of ``incoming`` that an insert-or-ignore would add: the first of each key, if the target lacks the key."""
    first = incoming.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
    return first.join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The target after a merge: incoming rows replace those of their key, the last of a key by ``order`` wins."""
    last = incoming.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last)


def first_by_hash(articles: DataFrame, order: list[Column], title: str = "title", content: str = "content") -> DataFrame:
    """``articles`` with a title and url, one a content hash: the first by ``order``."""
    usable = articles.where((_text(title) != "") & (_text("url") != "")).withColumn("content_hash", content_hash(F.col(title), F.col(content)))
    return usable.withColumn("__r", F.row_number().over(Window.partitionBy("content_hash").orderBy(*order))).where("__r = 1").drop("__r")


def union_sources(api: DataFrame, scraped: DataFrame, order: list[str]) -> DataFrame:
    """Both sources, one row a url, API rows first. Of the API one row with an empty url stays, of the scraped none."""
    a, s = api.withColumn("source_rank", F.lit(0)), scraped.where(_text("url") != "").withColumn("source_rank", F.lit(1))
    both = a.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(_text("url")).orderBy("source_rank", *order)
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _blocks(names: DataFrame, size: int = NAMES_AT_ONCE) -> Iterator[list[Row]]:
    """The rows of a dimension in blocks, in order."""
    block: list[Row] = []
    for row in names.orderBy(*names.columns).toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _hits(texts: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(id, text, hits): ``hits`` with the tickers whose name occurs in the text; one automaton finds all names in one pass."""

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tickers: dict[str, list[str]] = {}
        for ticker, name in names:
            tickers.setdefault(name, []).append(ticker)
        automaton = ahocorasick.Automaton()
        for name, own in tickers.items():
            automaton.add_word(name, own)
        automaton.make_automaton()
        for part in it:
            texts = part.column("__text").to_pylist()
            found = [sorted({t for _, own in automaton.iter(x) for t in own}) if x else [] for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("__at"), part.column("__text"), pa.array([a + b for a, b in zip(part.column("__hits").to_pylist(), found, strict=True)], pa.list_(pa.string()))], names=["__at", "__text", "__hits"])

    return texts.mapInArrow(find, texts.schema)


def match_companies(articles: DataFrame, companies: DataFrame, key: str = "id", out: str = "matched") -> DataFrame:
    """(key, out): the comma list of tickers whose bare name occurs in title, description or content, in any case;
    ``MULTIPLE`` where none does. Tickers come in their order in the alphabet."""
    text = F.lower(F.concat_ws(" ", _text("title"), _text("description"), _text("content")))
    found = articles.select(F.col(key).alias("__at"), text.alias("__text"), F.array().cast("array<string>").alias("__hits"))
    for block in _blocks(companies.select("ticker", F.lower(strip_legal_forms(F.col("name"))).alias("n")).where("n <> ''")):
        found = _hits(found, [(r["ticker"], r["n"]) for r in block])
    hits = F.array_sort(F.array_distinct("__hits"))
    return found.select(F.col("__at").alias(key), F.when(F.size(hits) > 0, F.array_join(hits, ",")).otherwise("MULTIPLE").alias(out))


def match_symbols(rows: DataFrame, symbols: DataFrame, pattern: str = "ticker", out: str = "symbol_id") -> DataFrame:
    """``rows`` plus the lowest id of the symbols that contain the pattern in any case; null for an empty pattern or none.
    ``%`` and ``_`` in the pattern are wildcards. Only distinct patterns are matched, against blocks of the symbols."""
    matched = rows.select(F.col(pattern).alias("__p")).where(F.col("__p") != "").distinct().withColumn(out, F.lit(None).cast("long"))
    for block in _blocks(symbols.select("id", "symbol").where("symbol is not null"), 1000):
        table = F.array(*[F.struct(F.lit(r["id"]).cast("long").alias("id"), F.lit(r["symbol"]).alias("s")) for r in block])
        hit = F.filter(table, lambda x: F.ilike(x["s"], F.concat(F.lit("%"), F.col("__p"), F.lit("%"))))
        matched = matched.withColumn(out, F.least(out, F.array_min(F.transform(hit, lambda x: x["id"]))))
    return rows.join(matched, F.col(pattern) == F.col("__p"), "left").drop("__p")


def new_by_hash(stored: DataFrame, articles: DataFrame, order: list[Column], title: str = "title", content: str = "content") -> DataFrame:
    """The first article of each content hash that ``stored`` (content_hash) lacks."""
    return first_by_hash(articles, order, title, content).join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def query_strings(companies: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, query): search expressions for ``size`` company names each, in the order of the tickers.

    The ranks of a dimension table come from one window; it is small by nature.
    """
    ranked = companies.select("ticker", strip_legal_forms(F.col("name")).alias("n")).withColumn("r", F.row_number().over(Window.orderBy("ticker")))
    chunks = ranked.groupBy(F.floor((F.col("r") - 1) / F.lit(size)).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("x"))
    return chunks.select("chunk", or_query(F.transform("x", lambda s: s["n"])).alias("query"))


def sector_peers(companies: DataFrame) -> DataFrame:
    """(ticker, peer): other companies of the same sector, by an equi-join on it."""
    a, b = companies.select("ticker", "sector"), companies.select(F.col("ticker").alias("peer"), "sector")
    return a.join(b, "sector").where(F.col("ticker") != F.col("peer")).select("ticker", "peer")


def competitor_pairs(relationships: DataFrame, companies: DataFrame) -> DataFrame:
    """(ticker, competitor): both directions of every edge between listed companies, each once."""
    edges = relationships.select(F.col("ticker_1").alias("ticker"), F.col("ticker_2").alias("competitor"))
    both = edges.unionByName(edges.select(F.col("competitor").alias("ticker"), F.col("ticker").alias("competitor"))).distinct()
    listed = companies.select("ticker").distinct()
    return both.join(listed, "ticker", "left_semi").join(listed.withColumnRenamed("ticker", "competitor"), "competitor", "left_semi").select("ticker", "competitor")
