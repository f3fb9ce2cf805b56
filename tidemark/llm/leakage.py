"""Evaluation passages in training texts, found with a distributed positional inverted index.

The corpus is indexed once: each part of about ``SEGMENT_TOKENS`` words becomes a segment, a row with the postings of all
its terms: the places, counted through the segment, at which each term stands, and where its documents start. A query
reads the stored index and never the texts. Nothing is shuffled but what is found: an item's terms are looked up in each
segment where it lies, so a hot term costs what its postings in the segment cost.

A phrase search first counts the item terms in all segments. For every window of ``WORDS`` words of an item its rarest term
proposes where in the segment the item would start; the list of the window's second rarest term, shifted by the distance
between the two, is intersected with that; what is left is intersected with the lists of all the item's other terms, and
runs of at least ``WORDS`` consecutive words in one document are the matches. A proximity search takes each item's
rarest terms and looks for most of them within a span.

Items come as a stated query table and are taken in blocks of at most ``ITEM_TERMS`` words, so what a task holds of them is
bounded; each further block reads the index once more.

Defined results: null and empty texts and items match nothing; items below ``WORDS`` words have no phrase match; repeated
documents match each under their id; each (document, item) comes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import WORD, hash_words
from tidemark.scratch import materialize

WORDS = 13
SEGMENT_TOKENS = 250_000
ITEM_TERMS = 2_000_000  # words of the items of a block (16 MB)
INDEX = "segment long, ids array<long>, starts array<int>, terms array<long>, offsets array<int>, places array<int>"
_INDEXES: dict[tuple[str, str], DataFrame] = {}


def build_index(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the documents (``INDEX``): ``ids`` and first places of the documents, the last start being the end;
    ``terms`` sorted; term k stands at ``places[offsets[k]:offsets[k + 1]]``, in order."""

    def flush(number: int, words: list[str], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        hashes = hash_words(words)
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        terms, firsts = np.unique(hashes[order], return_index=True)
        columns = [[number], [ids], [np.concatenate(([0], np.cumsum(sizes)))], [terms.view(np.int64)], [np.append(firsts, len(order))], [order]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["segment", "ids", "starts", "terms", "offsets", "places"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, sizes = [], [], []
        number = TaskContext.get().partitionId() << 32
        for part in it:
            for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not t or not (found := WORD.findall(t.lower())):
                    continue
                words += found
                ids.append(key)
                sizes.append(len(found))
                if len(words) >= SEGMENT_TOKENS:
                    yield flush(number, words, ids, sizes)
                    number += 1
                    words, ids, sizes = [], [], []
        if ids:
            yield flush(number, words, ids, sizes)

    return documents.select(F.col(id_col).cast("long"), text).mapInArrow(segments, INDEX)


def stored_index(spark: SparkSession, documents: DataFrame, name: str, anew: bool = False) -> DataFrame:
    """The index of the documents, built when first asked for under ``name`` in this application, or ``anew`` as the
    documents may have changed, and then read."""
    key = spark.sparkContext.applicationId, name
    if anew or key not in _INDEXES:
        _INDEXES[key] = materialize(build_index(documents), "index")
    return _INDEXES[key]


class Items(NamedTuple):
    """A block of items: their ids, words, the hash of each distinct word, and each item's words as numbers of those."""

    ids: list[int]
    words: list[str]
    terms: np.ndarray
    texts: list[np.ndarray]


def item_blocks(items: DataFrame, id_col: str = "item_id", text: str = "text", size: int = ITEM_TERMS) -> Iterator[Items]:
    """The query table in blocks of at most ``size`` words, or one item."""
    ids, texts, held = [], [], 0

    def block() -> Items:
        words = sorted({w for t in texts for w in t})
        number = {w: k for k, w in enumerate(words)}
        return Items(ids, words, hash_words(words), [np.array([number[w] for w in t], np.int64) for t in texts])

    for key, t in items.select(F.col(id_col).cast("long"), text).toLocalIterator():
        words = WORD.findall(t.lower()) if t else []
        if ids and held + len(words) > size:
            yield block()
            ids, texts, held = [], [], 0
        if words:
            ids.append(key)
            texts.append(words)
            held += len(words)
    if ids:
        yield block()


class Segment:
    """A row of the index, with the lists of a block's terms."""

    def __init__(self, row: dict[str, np.ndarray], items: Items):
        self.ids, self.starts, self.places = row["ids"], row["starts"].astype(np.int64), row["places"].astype(np.int64)
        terms, offsets = row["terms"].view(np.uint64), row["offsets"].astype(np.int64)
        at = np.minimum(np.searchsorted(terms, items.terms), len(terms) - 1)
        there = terms[at] == items.terms
        self.first = np.where(there, offsets[at], 0)
        self.size = np.where(there, offsets[at + 1] - offsets[at], 0)

    def spread(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, place) of all places of each of the terms."""
        sizes = self.size[terms]
        which = np.repeat(np.arange(len(terms)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.places[self.first[terms][which] + inside]

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term stands at its place: a binary search of its list."""
        low, high = self.first[terms], self.first[terms] + self.size[terms]
        end = high
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            below = open_ & (self.places[np.minimum(middle, len(self.places) - 1)] < places)
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return (low < end) & (self.places[np.minimum(low, len(self.places) - 1)] == places)

    def document(self, places: np.ndarray) -> np.ndarray:
        """The number of the document each place lies in."""
        return np.searchsorted(self.starts, places, side="right") - 1


def over_segments(index: DataFrame, items: Items, search: Callable[[Segment], list[tuple[np.ndarray, pa.DataType]]], schema: str) -> DataFrame:
    """The columns that ``search`` makes of each segment."""
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            for k in range(part.num_rows):
                row = {name: np.asarray(part.column(name)[k].values) for name in ("ids", "starts", "terms", "offsets", "places")}
                found = search(Segment(row, items))
                if len(found[0][0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in found], names=names)

    return index.mapInArrow(scan, schema)


def frequencies(index: DataFrame, items: Items) -> np.ndarray:
    """How often each term of the block stands in the corpus; no more rows than the block has terms come to the driver."""

    def counts(s: Segment) -> list[tuple[np.ndarray, pa.DataType]]:
        there = np.flatnonzero(s.size)
        return [(there, pa.int64()), (s.size[there], pa.int64())]

    out = np.zeros(len(items.terms), np.int64)
    for r in over_segments(index, items, counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def window_anchors(texts: list[np.ndarray], df: np.ndarray, words: int) -> np.ndarray:
    """Rows (item, place of the rarest term, place of the second rarest) of the windows of ``words`` words, each once. A
    term that the corpus lacks rules its windows out; of equally rare terms the earlier comes first."""
    out = set()
    for k, text in enumerate(texts):
        if len(text) < words:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(df[text], words)
        rank = np.argsort(windows, axis=1, kind="stable")[:, : min(2, words)]
        full = windows.min(axis=1) > 0
        start = np.flatnonzero(full)
        out.update(zip([k] * len(start), (start + rank[full, 0]).tolist(), (start + rank[full, -1]).tolist(), strict=True))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def phrase_matches(index: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_words): documents and items sharing at least ``words`` consecutive words, and the longest run."""
    schema = "doc_id long, item_id long, n_words long"
    found = [_phrases(index, block, words, schema) for block in item_blocks(items)]
    return reduce(DataFrame.unionByName, found) if found else items.sparkSession.createDataFrame([], schema)


def _phrases(index: DataFrame, items: Items, words: int, schema: str) -> DataFrame:
    anchors = window_anchors(items.texts, frequencies(index, items), words)
    sizes = np.array([len(t) for t in items.texts], np.int64)
    flat, begins, keys = np.concatenate(items.texts), np.cumsum(sizes) - sizes, np.array(items.ids, np.int64)
    term = lambda item, at: flat[begins[item] + at]

    def search(s: Segment) -> list[tuple[np.ndarray, pa.DataType]]:
        item, one, two = anchors.T
        which, place = s.spread(term(item, one))
        base = place - one[which]
        both = s.holds(term(item, two)[which], base + two[which])
        doc = s.document(place)
        # where item and document would begin: each once, whichever windows proposed it
        proposed = np.unique(np.column_stack((item[which], base, doc))[both], axis=0)
        item, base, doc = proposed.T
        row = np.repeat(np.arange(len(item)), sizes[item])
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes[item]) - sizes[item], sizes[item])
        place = base[row] + at
        hit = (place >= s.starts[doc[row]]) & (place < s.starts[doc[row] + 1])
        hit[hit] = s.holds(term(item[row[hit]], at[hit]), place[hit])
        row, at = row[hit], at[hit]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        length = np.diff(np.append(heads, len(row)))
        long = length >= words
        owner = row[heads[long]]
        pairs, back = np.unique(np.column_stack((doc[owner], item[owner])), axis=0, return_inverse=True)
        best = np.zeros(len(pairs), np.int64)
        np.maximum.at(best, back.reshape(-1), length[long])
        return [(s.ids[pairs[:, 0]], pa.int64()), (keys[pairs[:, 1]], pa.int64()), (best, pa.int64())]

    return over_segments(index, items, search, schema)


def proximity_matches(index: DataFrame, items: DataFrame, rarest: int = 8, least: int = 6, span: int = 60) -> DataFrame:
    """(doc_id, item_id, n_terms): documents where at least ``least`` of an item's ``rarest`` rarest terms lie within
    ``span`` words, whatever their order, and the most of them that do. Of equally rare terms the first by the alphabet count."""
    schema = "doc_id long, item_id long, n_terms int"
    found = [_proximity(index, block, rarest, least, span, schema) for block in item_blocks(items)]
    return reduce(DataFrame.unionByName, found) if found else items.sparkSession.createDataFrame([], schema)


def _proximity(index: DataFrame, items: Items, rarest: int, least: int, span: int, schema: str) -> DataFrame:
    df = frequencies(index, items)
    chosen = []
    for text in items.texts:
        own = np.unique(text)  # numbers follow the alphabet
        own = own[df[own] > 0]
        chosen.append(own[np.argsort(df[own], kind="stable")][:rarest])
    keys = np.array(items.ids, np.int64)

    def search(s: Segment) -> list[tuple[np.ndarray, pa.DataType]]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, terms in enumerate(chosen):
            if (s.size[terms] > 0).sum() < least:
                continue
            lists = [s.places[s.first[t] : s.first[t] + s.size[t]] for t in terms if s.size[t]]
            place = np.concatenate(lists)
            doc = s.document(place)
            end = np.minimum(place + span, s.starts[doc + 1])  # a window begins at a term and ends with its document
            n = sum((np.searchsorted(x, end) > np.searchsorted(x, place)).astype(np.int32) for x in lists)
            if (enough := n >= least).any():
                docs, back = np.unique(doc[enough], return_inverse=True)
                best = np.zeros(len(docs), np.int32)
                np.maximum.at(best, back, n[enough])
                out.append((s.ids[docs], np.full(len(docs), keys[k]), best))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return [(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)]

    return over_segments(index, items, search, schema)
