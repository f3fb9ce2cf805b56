"""Texts cut off by field limits or broken transfers.

A value that does not end with a finished sentence is *open*. Open values are judged twice:

1. Near-copies are found by min-hash banding and verified: at least 0.8 of the open value's five-word shingles lie in the
   copy, as a cut copy is a part of the whole one and no equal of it. The bands are of the last ``WINDOW`` shingles before
   the open value's last word, which may be broken; a text is banded at every place where it has the same five words as
   the open value before its last one, and these are a part of the band. The open value's last words are then aligned with the copy: if the copy goes on
   inside the same sentence, the value was cut; if the copy's sentence ends there, it was not. Identical texts form a
   class, and an open class is compared with every class it shares a band with: first with three of each band, then,
   unless one of them proves the cut, with all the others.
2. Values without such a copy are scored by closing-word terminality: how often, over all texts, a sentence or text ends
   after these closing words rather than going on. The most telling closing context with enough support decides. Rare
   words, names and numbers count as classes, so a word broken in two falls to a class that never ends; coarse contexts
   keep only the most common words. A last word known by its class only may be a part of one; where open values of this
   very length pile up, at a field limit, that is taken for granted.

Marks of a cut (a count of missing characters, a broken entity, tag or character) decide at once.

All texts are read twice: one pass counts words and finds the open values, the other counts closing contexts and finds
bands. Which contexts and bands are asked for is told to it by bit tables that grow with their keys, so that the share
that is counted or banded unasked stays small; nothing is missed.

Defined results: null and blank values are never cut. Repeated rows are judged alike. Values in scripts without the stops
``. ! ?`` are judged by terminality alone. A value of whose closing contexts none has support is no cut. Statistics cover
all rows and do not depend on how rows fall into batches. Values of fewer than ``LEAST`` shingles are judged by terminality.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import hash_words, mixed, multipliers
from tidemark.scratch import materialize

SHINGLE, SIMILARITY = 5, 0.8
WINDOW = 32  # shingles before the last word that are banded
LEAST = 16  # shingles an open value has at least; fewer may be a common phrase and tell no copy
BANDS, BAND_ROWS = 12, 4
BROADCAST_IDS = 1_000_000  # candidate ids below this many (8 MB) are broadcast to the texts, above they are joined by shuffle
FREQUENT = 0.0005  # share of values from which a word counts by itself, at most (words a value) / FREQUENT words
COMMON = 0.15  # share from which a word stays itself in the coarse contexts too
SUPPORT = 8
LEXICON_WORDS = 1_000_000  # tokens a worker keeps the kind of; only saves time
HELD = 500_000  # counts a worker holds before it passes them on; only saves rows
FINE, COARSE = (4, 3, 2, 1), (6, 4)  # words of the closing contexts
LEVELS = (("fine", 4), ("coarse", 6), ("fine", 3), ("coarse", 4), ("fine", 2), ("fine", 1))  # the most telling first
REACH = 12  # closing tokens kept of an open value; more than any context's
TERMINAL = 0.4  # least share of ends among a closing context's occurrences in a finished value
TABLE_BITS = 24  # bit tables of what is asked for have 2 ** TABLE_BITS bits (2 MB) at least
SPREAD, BAND_SPREAD = 32, 8  # bits a key that they have at least; bands are only looked up at an anchor

FIELDS = ("content", "description")
TOKEN = re.compile(r"\d+(?:[.,]\d+)*%?|\w+(?:[’'\-]\w+)*|[^\w\s]")
MARK = re.compile(r"\[\+\d+ chars?\]$")
BROKEN = re.compile(r"(?:&#?\w{0,8}|</?\w{0,8}|\\u?[0-9a-fA-F]{0,4}|%[0-9A-Fa-f]?|�)$")
DUBIOUS = re.compile(r"(?:\d|\b(?:Co|Ltd|Inc|Corp|Mr|Mrs|Ms|Dr|St|No|Jr|Sr|vs|[A-Z]))\.$")  # a stop that may belong to a number or an abbreviation
_PERCENT = re.compile(r"\d%$")
_CLOSERS, _STOPS, _RULES = "\"'”’»)]", ".!?。", "*#_=~-–—•·"
# Words for days and months, which stand for one another.
CALENDAR = frozenset("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())
CLASSES = frozenset(("0", "0%", "D", "I", "A", "N", "x"))  # what words stand for that do not count by themselves
_START, _STOP = np.uint64(0x51), frozenset(".!?")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FUNCTIONS = multipliers(BANDS * BAND_ROWS, 37)


def _finished(text: str) -> bool:
    bare = text.rstrip(_CLOSERS)
    return bare != "" and bare[-1] in _STOPS


def _signed_off(text: str) -> bool:
    """Whether the text ends with a rule of marks or an aside in brackets, set off from what comes before."""
    bare = text.rstrip(_RULES)
    if len(text) - len(bare) >= 2 and (not bare or bare[-1] in ".!?”’)" or bare[-1].isspace()):
        return True
    if text[-1] != ")" or (at := text.rfind("(", 0, -1)) < 0 or ")" in text[at:-1]:
        return False
    before = text[:at].rstrip()
    return not before or before[-1] in ".!?”’\""


def open_end(value: str | None) -> tuple[str, str] | None:
    """None for a finished or blank value; else (``cut``, "") for a marked cut or (``open``, the text to judge)."""
    if value is None or not (text := value.strip()):
        return None
    near = text[-24:]  # the bounded patterns below reach no further back
    if _finished(text) and not DUBIOUS.search(near) and text[-2:] != "..":
        return None if text[-1] != "]" or not MARK.search(text, text.rfind("[")) else ("cut", "")
    if (text[-1] == "]" and "[" in text and MARK.search(text, text.rfind("["))) or (BROKEN.search(near) and not _PERCENT.search(near)):
        return "cut", ""
    if _signed_off(text):
        return None
    bare = text[:-1] if text[-1] == "…" else text.rstrip(".") if text.endswith("..") else text
    if bare != text:
        bare = bare.rstrip()
        return ("open", bare) if bare and not _finished(bare) else None
    if _finished(text):
        return "open", text[:-1]
    if text[-1] in ",;:-–—(“‘«/&":
        return "cut", ""
    return "open", text


def class_of(w: str, known: dict[str, float]) -> tuple[str, str]:
    """The fine and the coarse class of a token. A known (frequent) word is its own fine class, a common one its own
    coarse class too; numbers, names, capitals, single letters and rare words have a class each."""
    c = w[0]
    if c.isdigit():
        return ("0%", "0%") if w[-1] == "%" else ("0", "0")
    if w in CALENDAR:
        return "D", "D"
    if c.isupper():
        if w in known and (w.isupper() or w.lower() in known):
            return w, w if known[w] >= COMMON else "N"
        kind = "I" if len(w) == 1 else "A" if w.isupper() else "N"
        return kind, kind
    if c.isalpha():
        return (w, w if known[w] >= COMMON else "w") if w in known else ("x", "x")
    return w, w


class Lexicon(dict):
    """Token to its number. ``tables`` tells of each number what the counting needs to know: the hashes of its fine and
    coarse class, whether it is a stop, a dot, no lower-case letter, a whole word, and the hash of the word, 0 for marks."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes, self.kind_of = array("Q"), array("i")
        self.kinds: dict[tuple, int] = {}
        self.rare: dict[str, int] = {}  # the kinds of words that don't count by themselves, by what the word looks like
        self.made: tuple[int, tuple[np.ndarray, ...]] = (0, ())

    def __missing__(self, w: str) -> int:
        c, look = w[0], ""
        if w not in self.known and w not in CALENDAR:
            if c.islower():
                look = "x" if c.isalpha() else ""
            elif c.isupper():
                look = "I" if len(w) == 1 else "A" if w.isupper() else "N"
            elif c.isdigit():
                look = "0%" if w[-1] == "%" else "0"
        kind = self.rare.get(look)
        if kind is None:
            fine, coarse = class_of(w, self.known)
            key = (fine, coarse, w in _STOP, w == ".", not c.islower(), fine not in ("x", "I"))
            kind = self.kinds.setdefault(key, len(self.kinds))
            if look:
                self.rare[look] = kind
        number = self[w] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(w.lower()) | 1 if c.isalnum() else 0)
        self.kind_of.append(kind)
        return number

    def tables(self) -> tuple[np.ndarray, ...]:
        if self.made[0] != len(self.kinds):
            fine, coarse, *flags = zip(*self.kinds, strict=True)
            self.made = len(self.kinds), (hash_words(list(fine)), hash_words(list(coarse)), *(np.array(f) for f in flags))
        kinds = np.frombuffer(self.kind_of, np.int32)
        return (*(t[kinds] for t in self.made[1]), np.frombuffer(self.hashes, np.uint64))


def contexts(fine: np.ndarray, coarse: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """For each of ``LEVELS``, in their order, the hash of the closing context at each position; ``first`` marks starts of
    sentences."""
    n = len(fine)
    place = np.arange(n, dtype=np.int32)
    place = place - np.maximum.accumulate(np.where(first, place, 0))
    out = {}
    for name, ids, sizes in (("fine", fine, FINE), ("coarse", coarse, COARSE)):
        h = ids + np.uint64(len(name))
        for k in range(1, max(sizes) + 1):
            if k in sizes:
                out[name, k] = h * _FACTOR + np.uint64(k)
            if k < max(sizes):
                earlier = np.full(n, _START)
                earlier[k:] = np.where(place[k:] >= k, ids[: max(n - k, 0)], _START)
                h = h * _FACTOR + earlier
    return (out[level] for level in LEVELS)


class Positions:
    """Over all tokens of some texts: hashes of the fine and coarse classes, starts of sentences, ends of sentences or
    texts, and hashes of the words. A text that stops on a rare word or a single letter is no evidence that these end."""

    def __init__(self, texts: list[list[str]], lexicon: Lexicon):
        if len(lexicon) >= LEXICON_WORDS:
            lexicon.forget()
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        numbers = array("i")
        for tokens in texts:
            numbers.extend(map(lexicon.__getitem__, tokens))
        self.n = n = len(numbers)
        if not n:
            self.fine = self.coarse = self.words = np.zeros(0, np.uint64)
            self.first = self.ends = np.zeros(0, bool)
            return
        numbers = np.frombuffer(numbers, np.int32)
        self.fine, self.coarse, stop, dots, upper, whole, self.words = (table[numbers] for table in lexicon.tables())
        text_start = np.zeros(n + 1, bool)
        text_start[np.concatenate(([0], np.cumsum(self.sizes)))] = True
        stop = stop & ~(dots & (np.append(dots[1:], False) | np.concatenate(([False], dots[:-1]))))  # the dots of an ellipsis end nothing
        boundary = stop & (np.append(upper[1:], True) | text_start[1:])
        self.first = text_start[:n].copy()
        self.first[1:] |= boundary[:-1]
        self.ends = np.append(boundary[1:], False) | (text_start[1:] & whole)


class Counts:
    """Totals and ends by key, summed up over batches."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, total: np.ndarray | None, ends: np.ndarray) -> None:
        where, found = pd.factorize(keys)
        counts = lambda w: np.bincount(where, weights=w, minlength=len(found)).astype(np.int64)
        self.parts.append((found, counts(total), counts(ends)))

    def take(self, above: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The sums, if there are more than ``above`` keys; they are then forgotten."""
        if sum(len(p[0]) for p in self.parts) <= above:
            return None
        parts, self.parts = self.parts, []
        self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        if len(self.parts[0][0]) <= above:
            return None
        out, self.parts = self.parts[0], []
        return out


def word_counts_and_ends(values: DataFrame) -> DataFrame:
    """One pass over (id, field, text). Rows with ``w``: a word, or "\\0" and the last words of a value without a stop, and
    ``c``, the values that have it in a part of the rows; ``w`` of "" counts values, ``cut`` says whether so many of the
    part's values have it that it would count by itself. Rows with ``field``: an open value, ``cut`` where a mark decides,
    with its last tokens and its last words."""
    names = ["w", "c", "id", "field", "text", "cut", "closing"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]

    def batch(columns: list[list]) -> pa.RecordBatch:
        n = max(map(len, columns))
        return pa.RecordBatch.from_arrays([pa.array(c, t) if c else pa.nulls(n, t) for c, t in zip(columns, types, strict=True)], names=names)

    def counted(seen: Counter[str]) -> pa.RecordBatch:
        least = FREQUENT * seen[""] * (1 - 1e-9)
        rows = [(w, c, c >= least) for w, c in seen.items() if not w or w[0].isalpha() or w[0] == "\0"]
        words, counts, often = map(list, zip(*rows, strict=True))
        return batch([words, counts, [], [], [], often, []])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        find = TOKEN.findall
        for part in it:
            rows = []
            for key, field, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                tokens = find(text)
                seen[""] += 1
                state = open_end(text) if field in FIELDS else None
                if state is not None:
                    bare = state[1].strip()
                    own = tokens if bare == text.strip() else find(bare)
                    if own or state[0] == "cut":
                        rows.append((key, field, text, state[0] == "cut", own[-REACH:]))
                if tokens and tokens[-1][0].isalnum():
                    tail = tokens[-4:]
                    after = max((i + 1 for i, w in enumerate(tail) if w in _STOP), default=0)
                    seen["\0" + " ".join(tail[after:])] += 1
                    tokens.pop()
                seen.update(set(tokens))
            if rows:
                yield batch([[], [], *map(list, zip(*rows, strict=True))])
            if len(seen) > HELD:
                yield counted(seen)
                seen.clear()
        if seen:
            yield counted(seen)

    return values.select("id", "field", "text").mapInArrow(scan, "w string, c long, id long, field string, text string, cut boolean, closing array<string>")


def frequent_words(scanned: DataFrame) -> dict[str, float]:
    """Words in at least ``FREQUENT`` of the values, with their share. The last word of a value without a stop doesn't
    count, it may be broken, unless the same last four words recur. A word that reaches a share of all values reaches it in
    one of the parts, so only the counts of words that do so are summed."""
    parts = scanned.where("w is not null").select("w", "c", F.col("cut").alias("often"))
    counts = parts.join(F.broadcast(parts.where("often").select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.sum("c").alias("c"))
    sums = counts.where(F.col("w").rlike(r"^(?:$|\p{L}|\x00)")).collect()
    rows = next((r[1] for r in sums if r[0] == ""), 0)
    found = [r for r in sums if r[0] != "" and r[1] >= FREQUENT * rows]
    known = {r[0]: r[1] / rows for r in found if r[0][0] != "\0"}
    for r in found:
        if r[0][0] == "\0" and r[1] >= 5:
            known.setdefault(r[0][1:].rpartition(" ")[2], r[1] / rows)
    return known


_NONE = np.zeros(0, np.uint64)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """The hash of the five words from each word on; the last four have none."""
    n = max(len(words) - SHINGLE + 1, 0)
    out = words[:n]
    for k in range(1, SHINGLE):
        out = out * _FACTOR + words[k : n + k]
    return mixed(out)


def text_words(text: str) -> np.ndarray:
    """Hashes of a text's words: its tokens but for marks, lower-cased."""
    return np.array([xxhash.xxh3_64_intdigest(w.lower()) | 1 for w in TOKEN.findall(text) if w[0].isalnum()], np.uint64)


def window_bands(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each window of shingles, at least one long, its min-hash bands, a row a window. The last shingle, the anchor, is
    part of each band: texts are compared only where they have the same anchor."""
    sizes = stops - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    chosen, heads = shingles[at], np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(starts), BANDS), np.uint64)
    anchors = shingles[stops - 1]
    for b in range(BANDS):
        h = anchors + np.uint64(b + 1)
        for k in range(BAND_ROWS):
            h = mixed(h * _FACTOR + np.minimum.reduceat(chosen * _FUNCTIONS[b * BAND_ROWS + k], heads))
        out[:, b] = h
    return out


def end_contexts(scanned: DataFrame, known: dict[str, float]) -> DataFrame:
    """(id, field, class, text, cut, whole, c, anchor, bands) of every open value; ``cut`` is true where a mark decides,
    ``whole`` where the last word is a known one, ``c`` holds the closing contexts by level, ``anchor`` the shingle before
    the last word and ``bands`` those of the window it ends."""

    def ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(known)
        for part in it:
            if not part.num_rows:
                continue
            cut, closing = np.asarray(part.column(4).to_pylist(), bool), part.column(5).to_pylist()
            p = Positions([[] if c else t for c, t in zip(cut, closing, strict=True)], lexicon)
            last = np.cumsum(p.sizes)[p.sizes > 0] - 1
            own = iter(np.column_stack([c[last] for c in contexts(p.fine, p.coarse, p.first)]).view(np.int64).tolist() if p.n else [])
            c = [next(own) if n else None for n in p.sizes]
            shingles = [shingles_of(text_words(open_end(t)[1])[:-1]) if not marked else shingles_of(_NONE) for marked, t in zip(cut, part.column(3).to_pylist(), strict=True)]
            sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
            stops, full = np.cumsum(sizes), sizes >= LEAST
            banded = iter(window_bands(np.concatenate(shingles), np.maximum(stops - sizes, stops - WINDOW)[full], stops[full]).view(np.int64).tolist() if full.any() else [])
            anchors = [x[-1].view(np.int64) if f else None for x, f in zip(shingles, full, strict=True)]
            bands = [next(banded) if f else None for f in full]
            longs = pa.list_(pa.int64())
            whole = [bool(t) and class_of(t[-1], known)[0] not in CLASSES for t in closing]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(whole), pa.array(c, longs), pa.array(anchors, pa.int64()), pa.array(bands, longs)], names=["id", "field", "class", "text", "cut", "whole", "c", "anchor", "bands"])

    rows = scanned.where("field is not null").select("id", "field", F.xxhash64("text").alias("class"), "text", "cut", "closing")
    return rows.mapInArrow(ends, "id long, field string, class long, text string, cut boolean, whole boolean, c array<long>, anchor long, bands array<long>")


def bit_table(keys: DataFrame, spread: int = SPREAD) -> np.ndarray:
    """One bit for each group of the keys (column k) by their leading bits: whether one of them is asked for. There are
    ``spread`` groups a key at least. Made in the JVM; 4 KB come to the driver for each 32,768 groups."""
    n = keys.agg(F.approx_count_distinct("k")).first()[0]
    bits = max(TABLE_BITS, (n * spread - 1).bit_length())
    group = F.shiftrightunsigned("k", 64 - bits) + 1  # the bitmap functions count from 1
    rows = keys.select(group.alias("g")).groupBy(F.bitmap_bucket_number("g").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("g")).alias("bits")).collect()
    table = np.zeros((1 << bits >> 15, 4096), np.uint8)
    for r in rows:
        table[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table.reshape(-1)


def _asked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set in a table of ``bit_table``."""
    group = (keys >> np.uint64(65 - (len(table) * 8).bit_length())).view(np.int64)
    return (table[group >> 3] >> (group & 7).astype(np.uint8) & 1).view(bool)


def read_all(values: DataFrame, known: dict[str, float], contexts_asked: np.ndarray, anchors: np.ndarray, bands: np.ndarray) -> DataFrame:
    """The second pass over (id, field, class, text). Rows with ``total``: how often a closing context ``k`` occurs in a
    part of the rows and how often a sentence ``ends`` after it. Other rows: a value with a band ``k`` that is asked for."""
    names = ["k", "total", "ends", "id", "field", "class", "size"]
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, sums = Lexicon(known), Counts()

        def counted(found: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            if found is not None:
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1]), pa.array(found[2]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names)

        for part in it:
            p = Positions(list(map(TOKEN.findall, part.column(3).to_pylist())), lexicon)
            if not p.n:
                continue
            keys, final = [], []
            for c in contexts(p.fine, p.coarse, p.first):
                hit = np.flatnonzero(_asked(contexts_asked, c))
                keys.append(c[hit])
                final.append(p.ends[hit])
            sums.add(np.concatenate(keys), None, np.concatenate(final))
            yield from counted(sums.take(HELD))
            # words, shingles of one text each, and the windows that end on an anchor
            word = np.flatnonzero(p.words)
            text_of = np.repeat(np.arange(len(p.sizes)), p.sizes)[word]
            shingles = shingles_of(p.words[word])
            at = np.flatnonzero(_asked(anchors, shingles))
            at = at[text_of[at] == text_of[at + SHINGLE - 1]]
            if not len(at):
                continue
            heads = np.searchsorted(text_of, text_of[at])
            found = window_bands(shingles, np.maximum(heads, at + 1 - WINDOW), at + 1)
            row, b = np.nonzero(_asked(bands, found))
            owner = pa.array(text_of[at][row])
            m = len(row)
            if m:
                take = lambda k: part.column(k).take(owner)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, b].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), take(0), take(1), take(2), take(4)], names=names)
        yield from counted(sums.take())

    rows = values.select("id", "field", "class", "text", F.length("text").alias("size"))
    return rows.mapInArrow(scan, "k long, total long, ends long, id long, field string, class long, size int")


def contained(part: np.ndarray, whole: np.ndarray) -> float:
    """The share of the distinct shingles of ``part`` that ``whole`` has."""
    mine = np.unique(part)
    return np.isin(mine, whole).mean() if len(mine) else 0.0


def judge(short: str, copy: str) -> int | None:
    """Alignment of an open text with a copy: 1 if the copy goes on inside the sentence, 0 if its sentence ends there,
    None if the copy does not hold it or the last words are not found in the copy."""
    state = open_end(short)
    if state is None or state[0] == "cut":
        return None
    bare = state[1]
    verdict = aligned(bare, copy)
    if verdict is None:
        return None
    return verdict if contained(_own_shingles(bare), shingles_of(text_words(copy))) >= SIMILARITY else None


@lru_cache(1024)
def _own_shingles(bare: str) -> np.ndarray:
    """The shingles before an open text's last word, which may be broken."""
    return shingles_of(text_words(bare)[:-1])


@lru_cache(1024)
def _tails(bare: str) -> list[re.Pattern]:
    """Patterns of an open text's last words, the longest first; each is a part of those before it."""
    words = TOKEN.findall(bare)
    return [re.compile(r"\W*".join(re.escape(w) for w in words[-size:])) for size in (8, 6, 4) if len(words) > size]


def aligned(bare: str, copy: str) -> int | None:
    """As ``judge``, of any copy that has the open text's last words once."""
    tails = _tails(bare)
    if not tails or not tails[-1].search(copy):  # where the shortest is not, none is
        return None
    for tail in tails:
        hits = list(tail.finditer(copy))
        if len(hits) != 1:
            continue
        rest = copy[hits[0].end() :]
        if not rest.strip():
            return None
        return 0 if re.match(r"[\"'”’»)\]]*[.!?…]", rest) or re.match(r"\s*\n", rest) else 1
    return None


def pairs_judged(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(field, a, verdict): the highest verdict of each open value over its copies, of those that tell."""

    def verdicts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            rows = [(f, a, v) for f, a, t, c in zip(*(x.to_pylist() for x in part.columns), strict=True) if (v := judge(t, c)) is not None]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["field", "a", "verdict"])

    ids = pairs.select("field", F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = F.broadcast(ids) if pairs.count() <= BROADCAST_IDS else ids
    texts = materialize(values.select("id", "field", "text").join(ids, ["id", "field"], "left_semi"), "texts")
    mine, other = texts.select("field", F.col("id").alias("a"), "text"), texts.select("field", F.col("id").alias("b"), F.col("text").alias("copy"))
    joined = pairs.join(mine, ["field", "a"]).join(other, ["field", "b"]).select("field", "a", "text", "copy")
    return joined.mapInArrow(verdicts, "field string, a long, verdict int").groupBy("field", "a").agg(F.max("verdict").alias("verdict"))


def copies_judged(ends: DataFrame, found: DataFrame, values: DataFrame) -> DataFrame:
    """(id, field, verdict) of open values with a verified near-copy that tells. ``found`` has the values (k, id, field,
    class, size) with a band that is asked for."""
    mine = ends.where(~F.col("cut") & F.col("anchor").isNotNull())
    reps = mine.groupBy("field", "class").agg(F.min("id").alias("a"), F.min_by("bands", "id").alias("bands"))
    asked = reps.select("field", "class", "a", F.explode("bands").alias("k"))
    copies = found.groupBy("k", "field", "class").agg(F.min("id").alias("b"), F.first("size").alias("size"))
    copies = materialize(copies.join(asked.select("k", "field").distinct(), ["k", "field"], "left_semi"), "copies")
    some = copies.groupBy("k", "field").agg(F.min_by("class", "b").alias("lo"), F.max_by("class", "b").alias("hi"), F.max_by("class", "size").alias("longest"), F.count("*").alias("n")).where("n > 1")
    some = materialize(asked.join(some, ["k", "field"]), "asked")
    named = copies.select("field", F.col("class").alias("other"), "b").distinct()
    first = some.select("field", "class", "a", F.explode(F.array("lo", "hi", "longest")).alias("other")).where("class <> other").distinct()
    first = materialize(first.join(named, ["field", "other"]).select("field", "class", "a", "b").distinct(), "pairs")
    told = materialize(pairs_judged(first, values), "told")
    # no copy can outweigh a proven cut; the others are compared with every class of their bands
    left = some.where("n > 3").join(told.where("verdict = 1"), ["field", "a"], "left_anti")
    rest = left.select("field", "class", "a", "k").join(copies.select("k", "field", F.col("class").alias("other"), "b"), ["k", "field"]).where("class <> other")
    rest = materialize(rest.select("field", "class", "a", "b").distinct().join(first, ["field", "a", "b"], "left_anti"), "rest")
    verdict = told if rest.isEmpty() else told.unionByName(pairs_judged(rest, values)).groupBy("field", "a").agg(F.max("verdict").alias("verdict"))
    return mine.select("id", "field", "class").join(reps.select("field", "class", "a").join(verdict, ["field", "a"]), ["field", "class"]).select("id", "field", "verdict")


def field_values(articles: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, text) of the values that are not null."""
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return articles.select(F.col("id").cast("long").alias("id"), F.inline(both)).where("text is not null")


def field_limits(ends: DataFrame) -> DataFrame:
    """(field, size, at_limit): lengths at which open values pile up against the lengths around them. One row a length."""
    counts = ends.groupBy("field", F.length("text").alias("size")).agg(F.count("*").alias("c"))
    around = Window.partitionBy("field").orderBy("size").rangeBetween(-10, 10)
    return counts.withColumn("near", (F.sum("c").over(around) - F.col("c")) / 20).where(F.col("c") >= 6 * F.col("near") + 6).select("field", "size", F.lit(True).alias("at_limit"))


def both_passes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The open values, see ``end_contexts``, and what was counted and found for them, see ``read_all``, in all texts of
    ``values`` (id, field, text)."""
    values = values.withColumn("class", F.xxhash64("text"))
    scanned = materialize(word_counts_and_ends(values), "scanned")
    known = frequent_words(scanned)
    ends = materialize(end_contexts(scanned, known), "ends")
    asked = [F.explode("c").alias("k")], [F.col("anchor").alias("k")], [F.explode("bands").alias("k")]
    tables = [bit_table(ends.select(*k).where("k is not null"), n) for k, n in zip(asked, (SPREAD, SPREAD, BAND_SPREAD), strict=True)]
    return ends, materialize(read_all(values, known, *tables), "found")


def judged_values(articles: DataFrame) -> DataFrame:
    """Every open value with what was found out about it: (id, field, cut, whole, stopped, at_limit, share, verdict)."""
    values = field_values(articles, (*FIELDS, "title"))
    ends, found = both_passes(values)
    levels = ends.select("id", "field", F.posexplode("c").alias("level", "k"))
    counts = found.where("total is not null").groupBy("k").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends")).where(F.col("total") >= SUPPORT)
    best = levels.join(counts, "k").groupBy("id", "field").agg(F.min_by(F.col("ends") / F.col("total"), "level").alias("share"))
    judged = copies_judged(ends, found.where("total is null").select("k", "id", "field", "class", "size"), values)
    stopped = F.rtrim("text").rlike(r"(?<!\.)\.$")
    rows = ends.select("id", "field", "cut", "whole", F.length("text").alias("size"), stopped.alias("stopped"))
    return rows.join(field_limits(ends), ["field", "size"], "left").join(best, ["id", "field"], "left").join(judged, ["id", "field"], "left")


def truncated_values(articles: DataFrame) -> DataFrame:
    """(id, field_name) of every value that was cut inside a word or sentence."""
    broken = F.coalesce("at_limit", F.lit(False)) & ~F.col("stopped") & ~F.col("whole")
    is_cut = F.col("cut") | F.coalesce(F.col("verdict") == 1, (F.col("share") < TERMINAL) | broken, broken)
    return judged_values(articles).where(is_cut).select("id", F.col("field").alias("field_name"))


def truncation_by_source(articles: DataFrame, cut: DataFrame) -> DataFrame:
    """(source_name, values, cut, share): how often each source's values are cut."""
    values = field_values(articles).join(articles.select("id", "source_name"), "id").select("id", F.col("field").alias("field_name"), "source_name")
    marked = values.join(cut.withColumn("c", F.lit(1)), ["id", "field_name"], "left")
    return marked.groupBy("source_name").agg(F.count("*").alias("n_values"), F.count("c").alias("n_cut"), (F.count("c") / F.count("*")).alias("share_cut"))
