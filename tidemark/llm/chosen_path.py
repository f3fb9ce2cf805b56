"""Near-duplicate records by a chosen-path set similarity join over their distinct words.

Every record keeps the least word under each of ``FUNCTIONS`` hash functions. A tree starts with all records in one node
and branches each by its own least words under functions the node picks, ``1 / branch`` of them on average. A branch ends
once its expected size, from the corpus frequencies of the words on its path, is at most ``small``; records that meet in
such a node are compared exhaustively, first by a sketch and then exactly. ``trees`` independent trees raise recall.

Records with the same words form a class and only its smallest id takes part, so a group of copies costs no pairs before
the final expansion. A word that is frequent never ends a branch by itself, so no node grows with a hot word; what a node
of near-copies still holds is a sort-merge join's run, which adaptive execution splits. Nothing is capped or dropped.

Defined results: null texts count as empty, records without words resemble nothing. Ids must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import distinct_words, minhash, mixed, multipliers, word_sets
from tidemark.scratch import materialize, new_path, remove

FUNCTIONS = 64
TREES = 7
SMALL = 100.0  # expected records of a node that is compared exhaustively
FREQUENT = 0.001  # share of records from which a word's frequency is kept; at most (words a record) / FREQUENT words
HELD = 2_000_000  # counts a worker holds before it passes them on; only saves rows
MAX_DEPTH = 16
SKETCH_SLACK = 3.0  # standard deviations below the expected sketch agreement that still pass to the exact check
BROADCAST_ROWS = 1_000_000  # ids below this many are broadcast to the text scan (8 MB), above they are joined by shuffle


def fingerprints(texts: DataFrame) -> DataFrame:
    """One pass over (id, text): rows of kind 0 hold id, word-set hash, word count and least words; rows of kind 1 hold
    a word and its count in a part of the records; every word is counted, wherever batches begin."""
    functions = multipliers(FUNCTIONS, 11)

    def summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate(words), return_inverse=True)
        return found, np.bincount(where, np.concatenate(counts)).astype(np.int32)

    def counted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        m = len(words)
        none = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.array(words), none, none, pa.array(counts), pa.nulls(m, pa.binary())], names=["kind", "id", "h1", "h2", "n", "least"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for batch in it:
            ids = np.asarray(batch.column(0))
            hashes, sizes = word_sets(batch.column(1).to_pylist())
            full = sizes > 0
            if not full.any():
                continue
            ids, sizes = ids[full], sizes[full]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            h1 = np.add.reduceat(mixed(hashes), starts)
            h2 = np.bitwise_xor.reduceat(mixed(hashes + np.uint64(0x9E3779B97F4A7C15)), starts)
            least = (minhash(hashes, sizes, functions) >> np.uint64(32)).astype(np.uint32)
            n = len(ids)
            width = FUNCTIONS * 4
            blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(least))])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(ids), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sizes.astype(np.int32)), blob], names=["kind", "id", "h1", "h2", "n", "least"])
            for part, own in zip(held, np.unique((hashes >> np.uint64(32)).astype(np.int64), return_counts=True), strict=True):
                part.append(own)
            if sum(map(len, held[0])) > HELD:
                words, counts = summed(*held)
                held = ([words], [counts])
                if len(words) > HELD // 2:
                    yield counted(words, counts)
                    held = ([], [])
        if held[0]:
            yield counted(*summed(*held))

    return texts.mapInArrow(batches, "kind byte, id long, h1 long, h2 long, n int, least binary")


def frequent_words(prints: DataFrame, records: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit word hashes and the log of their share of records, for words in at least ``FREQUENT`` of them."""
    rows = prints.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(FREQUENT * records)).orderBy("id").collect()
    return np.array([r[0] for r in rows], np.uint32), np.log(np.minimum(1.0, np.array([r[1] for r in rows], float) / max(records, 1)))


def paths(least: np.ndarray, words: np.ndarray, shares: np.ndarray, records: int, threshold: float, trees: int, small: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) for every small node a record reaches; ``least`` holds a row of 32-bit least words a record."""
    second = np.uint64(min(2.0**64 - 2049, (1 / (threshold - 0.03) - 1) * 2.0**64)) if threshold > 0.53 else np.uint64(2**64 - 1)
    rare = math.log(FREQUENT)
    limit = math.log(small)
    found_rows, found_nodes = [], []
    k = np.uint64(least.shape[1])
    for tree in range(trees):
        rows = np.arange(len(least))
        node = np.full(len(rows), mixed(np.array([tree + 1], np.uint64))[0])
        size = np.full(len(rows), math.log(max(records, 2)))
        seen = np.zeros((len(rows), 0), np.uint32)
        for _ in range(MAX_DEPTH):
            one = mixed(node ^ np.uint64(0xA5A5A5A5))
            first = one % k
            more = mixed(node ^ np.uint64(0x5C5C5C5C)) < second
            other = (first + np.uint64(1) + mixed(one) % (k - np.uint64(1))) % k
            pick = np.concatenate((np.arange(len(rows)), np.flatnonzero(more)))
            which = np.concatenate((first, other[more])).astype(np.int64)
            rows, node, size, seen = rows[pick], node[pick], size[pick], seen[pick]
            token = least[rows, which]
            node = mixed(node * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64))
            share = np.full(len(rows), rare)
            if len(words):
                at = np.minimum(np.searchsorted(words, token), len(words) - 1)
                share = np.where(words[at] == token, shares[at], rare)
            again = (seen == token[:, None]).any(axis=1)
            size = size + np.where(again, 0.0, share)
            done = size <= limit
            found_rows.append(rows[done])
            found_nodes.append(node[done])
            left = ~done
            rows, node, size, seen = rows[left], node[left], size[left], np.column_stack((seen[left], token[left]))
            if not len(rows):
                break
        found_rows.append(rows)
        found_nodes.append(node)
    return np.concatenate(found_rows), np.concatenate(found_nodes)


def sketches(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words with two bits of each of the 64 least words."""
    two = (least & np.uint32(3)).astype(np.uint64)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return (two[:, :32] << shifts).sum(axis=1, dtype=np.uint64), (two[:, 32:] << shifts).sum(axis=1, dtype=np.uint64)


def nodes_of(reps: DataFrame, words: np.ndarray, shares: np.ndarray, records: int, threshold: float, trees: int, small: float) -> DataFrame:
    """(node, id, s1, s2): the small nodes of every record of (id, least), with its sketch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            least = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), -1)
            s1, s2 = sketches(least)
            rows, node = paths(least, words, shares, records, threshold, trees, small)
            order = np.argsort(rows, kind="stable")  # a record's rows lie together, so its id and sketch compress in the shuffle
            rows, node = rows[order], node[order]
            columns = [node.view(np.int64), ids[rows], s1[rows].view(np.int64), s2[rows].view(np.int64)]
            for at in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["node", "id", "s1", "s2"])

    return reps.select("id", "least").mapInArrow(batches, "node long, id long, s1 long, s2 long")


def node_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, that meet in a node and agree in enough of their sketch."""
    agree = threshold + (1 - threshold) / 4
    least_equal = FUNCTIONS * agree - SKETCH_SLACK * math.sqrt(FUNCTIONS * agree * (1 - agree))
    most_unequal = FUNCTIONS - math.floor(least_equal)
    a = nodes.select("node", F.col("id").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    b = nodes.select(F.col("node").alias("node_b"), F.col("id").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))

    def unequal(x: str, y: str) -> Column:
        differ = F.col(x).bitwiseXOR(F.col(y))
        return F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    fits = unequal("a1", "b1") + unequal("a2", "b2") <= most_unequal
    return a.join(b.hint("merge"), (F.col("node") == F.col("node_b")) & (F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlap) of the pairs whose words overlap by the threshold; each text is split once, in the JVM."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if pairs.count() <= BROADCAST_ROWS // 2:
        ids = F.broadcast(ids)
    words = texts.join(ids, "id", "left_semi").select("id", distinct_words(F.col("text")).alias("w"))
    x, y = words.select(F.col("id").alias("a"), F.col("w").alias("wa")), words.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("wa") + F.size("wb")).alias("total"))
    return joined.select("a", "b", (F.col("both") / (F.col("total") - F.col("both"))).alias("overlap")).where(F.col("overlap") >= threshold)


def similar_classes(texts: DataFrame, threshold: float, trees: int = TREES, small: float = SMALL) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, rep) of every record with words, and ``links`` (a, b, overlap) between class representatives.

    ``texts`` has columns id, text. Copies are not expanded into pairs: the two results are linear in the classes.
    """
    spark, path = texts.sparkSession, new_path(texts.sparkSession, "prints")
    fingerprints(texts).write.parquet(path)
    prints = spark.read.parquet(path)
    docs = materialize(prints.where("kind = 0").select("id", "h1", "h2"), "docs")
    records = docs.count()
    words, shares = frequent_words(prints, records)
    groups = docs.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    shared = groups.where("copies > 1").select("h1", "h2", "rep")
    # written first, so that its size is known before the least words are joined to it
    copies = materialize(docs.select("id", "h1", "h2").join(shared, ["h1", "h2"]).where("id <> rep").select("id", "rep"), "copies")
    reps = prints.where("kind = 0").select("id", "least").join(copies.select("id"), "id", "left_anti")
    pairs = materialize(node_pairs(nodes_of(reps, words, shares, records, threshold, trees, small), threshold), "pairs")
    remove(spark, path)  # the least words have done their part
    links = verified(pairs, texts, threshold)
    members = docs.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return members, links


def similar_pairs(texts: DataFrame, threshold: float, trees: int = TREES, small: float = SMALL) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records whose words overlap by the threshold, copies included."""
    members, links = similar_classes(texts, threshold, trees, small)
    links = materialize(links.select("a", "b"), "links")
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copied = members.where("id <> rep").select("rep").distinct()
    within = members.join(copied, "rep", "left_semi")
    same = within.alias("p").join(within.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b"))
    return across.unionByName(same)


def article_texts(articles: DataFrame) -> DataFrame:
    """(id, text): title, a blank and content, null as empty."""
    return articles.select(F.col("id").cast("long").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))).alias("text"))
