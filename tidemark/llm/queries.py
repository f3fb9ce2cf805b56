"""Queries of this subpackage over a data directory, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chosen_path, encoding_repair, hash_forest, leakage, nearest_time, packing, truncation
from tidemark.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directly affected ticker with the price row nearest in time to its article date."""
    t = lambda name: table(spark, sf_dir, name)
    return nearest_time.match_extractions(t("extractions"), t("prices"), t("companies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content or description that was cut inside a word or sentence."""
    return truncation.truncated_values(table(spark, sf_dir, "news_articles"))


def p2_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut values of every source."""
    articles = table(spark, sf_dir, "news_articles")
    return truncation.truncation_by_source(articles, truncation.truncated_values(articles))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article that repeats one accepted before it, batch by batch."""
    return hash_forest.deduplicate(table(spark, sf_dir, "news_articles").select("id", "title", "url", "batch_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of articles whose title and content overlap by 0.70."""
    return chosen_path.similar_pairs(chosen_path.article_texts(table(spark, sf_dir, "news_articles")), 0.70)


def _pack(pack_name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        capacity = table(spark, sf_dir, "pack_sizes").where(F.col("pack_name") == pack_name).select("capacity_tokens").first()[0]
        return packing.pack(table(spark, sf_dir, "documents"), int(capacity))

    query.__doc__ = f"All texts in containers of the capacity {pack_name!r}."
    return query


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and evaluation item that share at least 13 consecutive words; the index is made anew and stored."""
    index = leakage.stored_index(spark, table(spark, sf_dir, "documents"), sf_dir, anew=True)
    return leakage.phrase_matches(index, table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of an item's rarest words close together; the stored index is read if there is one."""
    index = leakage.stored_index(spark, table(spark, sf_dir, "documents"), sf_dir)
    return leakage.proximity_matches(index, table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of which at least a part was decoded wrongly."""
    return encoding_repair.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their text restored as far as it can be."""
    return encoding_repair.garbled_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"p9_found": p9_found, "p9_restored": p9_restored, "p7_pack_main": _pack("main"), "p7_pack_small": _pack("small"), "p7_pack_large": _pack("large"), "p8_found": p8_found, "p8_proximity": p8_proximity, "p2_found": p2_found, "p2_share_by_source": p2_share_by_source, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found}
