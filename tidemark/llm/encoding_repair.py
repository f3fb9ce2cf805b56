"""Texts decoded with a wrong character encoding, found and restored by minimum description length.

A text is judged by segments (lines and sentences), as often only a part is garbled. For each segment every chain of wrong
decodings that could have led to it is undone, word by word; each candidate is compressed, whole, with a zstandard
dictionary of every language that it can be written in, and the candidate with the shortest description, chain cost
included, wins. A tie leaves the segment as it is. Escapes (``&#233;``) are undone first and are no wrong decoding by
themselves. A replacement character marks a loss that cannot be undone: such a text is found but stays.

A chain has up to ``MAX_STEPS`` steps: wrong readings of UTF-8, and at most one swap of two one-byte encodings before,
between or after them. What the chains make of a word is worked out once for each distinct word a worker meets. A chain
is no candidate if it leaves a letter run in two scripts, a capital after a small letter, or the words it changes in
characters that no single language uses; for rightly decoded segments that leaves nothing to compress in most cases.

The dictionaries and alphabets are fitted on all labelled rows, twice: the second time without the rows that the first
fit finds garbled. Characters, words and phrases are counted in full, and the most common ones fill a dictionary of
``DICT_BYTES``. Everything is then applied to all rows and whole texts.

Defined results: null and empty texts are never garbled and come back as they are; repeated rows are judged alike; with no
labelled rows to fit on, only replacement characters are found.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialize

DICT_BYTES = 32_768
FIRST_SHARE = 0.04  # share of a language's texts from which a character is taken for its own in the first fit
LEAST_SHARE = 0.002  # the same in the second fit, and, on the mean over languages, for what an undone reading may use
LEVEL = 19  # the optimal parse; a faster one misses matches and makes rightly decoded words look longer than they are
COMMON_WORDS = 2000  # words and phrases of a kind that a dictionary is filled from
HELD = 500_000  # counts a worker holds before it passes them on; only saves rows
MAX_STEPS = 3
UTF8_COST, SWAP_COST = 0.5, 2  # bytes of chain description a step
Step = tuple[str, str]  # read as, truly
Chain = tuple[Step, ...]
READ_AS = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2")
TRULY = ("cp1252", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp437", "cp850", "mac_roman")

LOST = "�"
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+")
_WORDS = re.compile(r"[ \t\r\n]+")
_TOKENS = re.compile(r"([ \t\r\n]+)")
_SPACE = re.compile(r"(?<![^\x00-\x7f])\xa0+(?![^\x00-\x7f\xa0])")  # no-break spaces between plain characters are rightly there
_SUSPECT = r"[^\x00-\x7F]|&"  # for the JVM: what any garbled text has
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_ESCAPE = re.compile(r"&(?:#\d{2,6}|#x[0-9A-Fa-f]{2,5}|[A-Za-z]{2,8});")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"[^\x00-\x7f]+")
WORDS_KEPT = 200_000  # words whose chains a worker keeps; only saves time


def _table(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; bytes it leaves undefined stand for the control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
        if b < 160:
            out.setdefault(chr(b), b)
    return out


_BYTES = {c: _table(c) for c in READ_AS}


def undo(word: str, read_as: str, truly: str) -> str | None:
    """The word with one wrong decoding undone: its bytes under ``read_as``, decoded as ``truly``; None if impossible."""
    table, raw = _BYTES[read_as], bytearray()
    for ch in word:
        if ch < "\x80":
            raw.append(ord(ch))
        elif (b := table.get(ch)) is not None:
            raw.append(b)
        else:
            return None
    try:
        out = raw.decode(truly)
    except UnicodeDecodeError:
        return None
    return None if out == word else out


class _Swap(dict):
    """Foreign characters by code point to what undoing a swap makes of them; of others, a replacement character."""

    def __missing__(self, code: int) -> str:
        return chr(code) if code < 128 else LOST


def _swap_tables() -> dict[Step, _Swap]:
    out = {}
    for read_as in READ_AS:
        for truly in TRULY:
            if read_as != truly:
                table = out[read_as, truly] = _Swap()
                for ch, b in _BYTES[read_as].items():
                    table[ord(ch)] = bytes([b]).decode(truly, "replace")
    return out


_UTF8: list[Step] = [(c, "utf-8") for c in READ_AS]
_SWAPS = _swap_tables()
_SWAP_STEPS = list(_SWAPS)


def undone(word: str, step: Step) -> str | None:
    """The word with a step undone; None where it can't be or changes nothing."""
    if step[1] == "utf-8":
        return undo(word, *step)
    out = word.translate(_SWAPS[step])
    return None if out == word or LOST in out else out


def chain_cost(chain: Chain) -> float:
    return sum(UTF8_COST if truly == "utf-8" else SWAP_COST for _, truly in chain)


class _Bits:
    """For each character, a bit a step or pair of steps: whether its byte can lead a UTF-8 sequence or go on with one
    (``lead``, ``more``), after each swap and reading (``lead2``, ``more2``), and which swaps map it and change it."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs = [(s, u) for s in _SWAP_STEPS for u in _UTF8 if u[0] != s[1]]

    def of(self, ch: str) -> tuple[int, ...]:
        if (found := self.known.get(ch)) is None:
            bytes_of = [_BYTES[u[0]].get(ch, 0) for u in _UTF8]
            swapped = [_SWAPS[s][ord(ch)] for s in _SWAP_STEPS]
            twice = [_BYTES[u[0]].get(_SWAPS[s][ord(ch)], 0) for s, u in self.pairs]
            bits = lambda flags: sum(1 << k for k, f in enumerate(flags) if f)
            leads, goes_on = (lambda b: 0xC2 <= b <= 0xF4), (lambda b: 0x80 <= b <= 0xBF)
            found = self.known[ch] = (
                bits(map(leads, bytes_of)), bits(map(goes_on, bytes_of)), bits(map(leads, twice)), bits(map(goes_on, twice)),
                bits(x != LOST for x in swapped), bits(x != ch for x in swapped),
            )
        return found


_BITS = _Bits()


def _utf8_steps(word: str, both: bool) -> tuple[int, int]:
    """Bits of the readings, and of swap and reading in pairs, whose bytes may be UTF-8 in every foreign run of the word."""
    one, two = -1, -1 if both else 0
    for run in _RUNS.findall(word):
        if len(run) < 2:
            return 0, 0
        first, second, last = _BITS.of(run[0]), _BITS.of(run[1]), _BITS.of(run[-1])
        one &= first[0] & second[1] & last[1]
        two &= first[2] & second[3] & last[3]
        if not one and not two:
            break
    return one, two


def _set_bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def word_chains(word: str, steps: int = MAX_STEPS, swap: bool = True) -> Iterator[tuple[Chain, str]]:
    """What every chain that changes the word in each of its steps makes of it."""
    if word.isascii() or not steps:
        return
    one, two = _utf8_steps(word, swap and steps > 1)
    for k in _set_bits(one & (1 << len(_UTF8)) - 1):
        if (new := undo(word, *_UTF8[k])) is not None:
            yield (_UTF8[k],), new
            for chain, last in word_chains(new, steps - 1, swap):
                yield (_UTF8[k], *chain), last
    if not swap:
        return
    for k in _set_bits(two & (1 << len(_BITS.pairs)) - 1):
        first, second = _BITS.pairs[k]
        if (mid := undone(word, first)) is not None and (new := undo(mid, *second)) is not None:
            yield (first, second), new
            for chain, last in word_chains(new, steps - 2, False):
                yield (first, second, *chain), last
    maps, moves = -1, 0
    for ch in word:
        if ch > "\x7f":
            _, _, _, _, mapped, moved = _BITS.of(ch)
            maps &= mapped
            moves |= moved
    for k in _set_bits(maps & moves):
        yield (_SWAP_STEPS[k],), word.translate(_SWAPS[_SWAP_STEPS[k]])


def applied(words: list[str], chain: Chain) -> list[str]:
    """Every word with the chain undone where it can be, else unchanged."""
    out = []
    for w in words:
        for step in chain:
            if w.isascii():
                break
            w = undone(w, step) or w
        out.append(w)
    return out


_SCRIPTS: dict[str, str] = {}


def well_formed(word: str) -> bool:
    """Whether every run of letters is in one script and no capital follows a small letter where one of them is foreign."""
    for run in _LETTERS.findall(word):
        if run.isascii():
            continue
        before, script = "", ""
        for ch in run:
            if (kind := _SCRIPTS.get(ch)) is None:
                kind = _SCRIPTS[ch] = unicodedata.name(ch, "?").partition(" ")[0]
            if kind != script and script and "FEMININE" not in (kind, script) and "MASCULINE" not in (kind, script):
                return False
            if before and ch.isupper() and before.islower() and not (ch.isascii() and before.isascii()):
                return False
            before, script = ch, kind
    return True


class Describer:
    """Description lengths by one zstandard dictionary a language, and the candidates for a segment."""

    def __init__(self, dictionaries: dict[str, bytes], alphabets: dict[str, str]):
        self.compressors, self.masks = [], {}
        for k, (name, raw) in enumerate(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            for ch in alphabets[name]:
                self.masks[ch] = self.masks.get(ch, 0) | 1 << k
        self.all = (1 << len(self.compressors)) - 1
        self.words: dict[str, tuple[dict[Chain, int], set[Chain]]] = {}

    def mask(self, word: str) -> int:
        """The languages, a bit each, whose alphabet has all foreign characters of a word; 0 too if it is not well formed."""
        mask = self.all
        for ch in word:
            if ch > "\x7f":
                mask &= self.masks.get(ch, 0)
        return mask if mask and well_formed(word) else 0

    def options(self, word: str) -> tuple[dict[Chain, int], set[Chain]]:
        """Chains that make a plausible word of this one, with its languages, and chains that don't."""
        if (known := self.words.get(word)) is None:
            fine, bad = {}, set()
            for chain, new in word_chains(word):
                if mask := self.mask(new):
                    fine[chain] = mask
                else:
                    bad.add(chain)
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            known = self.words[word] = fine, bad
        return known

    def length(self, text: str, mask: int) -> int:
        """Bytes of the text compressed with the best dictionary of the languages in ``mask``."""
        raw = text.encode("utf-8", "surrogatepass")
        return min((len(c.compress(raw)) for k, c in enumerate(self.compressors) if mask >> k & 1), default=len(raw))

    def best_chain(self, segment: str) -> Chain:
        """The winning chain of a segment, empty if it is best left alone."""
        if _ESCAPE.search(segment):
            segment = html.unescape(segment)
        segment = _SPACE.sub(" ", segment)
        words = {w for w in _WORDS.split(segment) if not w.isascii()}
        alive, dead, own = {}, set(), self.all
        for w in words:
            fine, bad = self.options(w)
            own &= self.mask(w)
            for chain, mask in fine.items():
                alive[chain] = alive.get(chain, self.all) & mask
            dead |= bad
        tried = sorted((chain_cost(c), c) for c, mask in alive.items() if mask and c not in dead)
        if not tried:
            return ()
        tokens = _TOKENS.split(segment)
        seen = {segment}
        best, chain = self.length(segment, own or self.all), ()
        others = self.all & ~own if own else 0  # languages the segment as it is remains to be described in
        for cost, steps in tried:
            new = applied(tokens, steps)
            mask = alive[steps]
            if len(steps) > 1:  # some steps may change words that the whole chain does not
                for old, now in zip(tokens, new, strict=True):
                    if old != now:
                        mask &= self.mask(now)
            text = "".join(new)
            if not mask or text in seen:
                continue
            seen.add(text)
            size = self.length(text, mask) + cost
            if size < best and others:
                best, others = min(best, self.length(segment, others)), 0
            if size < best:
                best, chain = size, steps
        return chain


def segments(text: str) -> list[str]:
    """Lines and sentences of a text, with what separates them; joined they give the text."""
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        out += [text[at : m.start()], m.group()]
        at = m.end()
    return [*out, text[at:]]


def repair(text: str | None, describer: Describer) -> tuple[bool, bool, str | None]:
    """(garbled, lost, restored text)."""
    if not text or not (_FOREIGN.search(text) or "&" in text):
        return False, False, text
    garbled, out = False, []
    for part in segments(text):
        chain = describer.best_chain(part) if _FOREIGN.search(part) or _ESCAPE.search(part) else ()
        if chain:
            garbled = True
            base = html.unescape(part) if _ESCAPE.search(part) else part
            out.append("".join(applied(_TOKENS.split(base), chain)))
        else:
            out.append(part)
    restored = "".join(out)
    lost = LOST in restored or LOST in html.unescape(text)
    return garbled or lost, lost, restored


def _restorable(text: str, alphabet: set[str]) -> bool:
    """Whether a wrong reading of UTF-8 can be undone in some word and gives letters that labelled texts use."""
    for w in set(_WORDS.split(html.unescape(text))):
        if not w.isascii():
            for k in _set_bits(_utf8_steps(w, False)[0] & (1 << len(_UTF8)) - 1):
                if (out := undo(w, *_UTF8[k])) and all(ch < "\x80" or ch in alphabet for ch in out):
                    return True
    return False


def _telling_words(segment: str) -> list[str]:
    """The words with foreign characters and their neighbours, in order."""
    words = _WORDS.split(segment)
    near = {j for i, w in enumerate(words) if not w.isascii() for j in (i - 1, i, i + 1)}
    return [w for i, w in enumerate(words) if i in near]


TEXTS, CHARS, PHRASES = range(3)  # kinds of counts
Counted = Callable[[str], Iterator[tuple[int, str]]]


def _counts(rows: DataFrame, counted: Callable[[], Counted]) -> DataFrame:
    """(lang, kind, what, n) over all rows (lang, text): what ``counted`` gives for each text, summed up in each task first."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = counted(), Counter()

        def passed_on() -> pa.RecordBatch:
            keys = list(zip(*seen, strict=True)) or [[]] * 3
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*keys, list(seen.values())), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "what", "n"])
            seen.clear()
            return out

        for part in it:
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                seen.update((lang, *x) for x in of(text))
            if len(seen) > HELD:
                yield passed_on()
        yield passed_on()

    counts = rows.select("lang", "text").mapInArrow(batches, "lang string, kind int, what string, n long")
    return counts.groupBy("lang", "kind", "what").agg(F.sum("n").alias("n"))


def _foreign(text: str) -> Iterator[tuple[int, str]]:
    """The foreign characters of a text."""
    return ((CHARS, ch) for ch in set(text) if ch > "\x7f")


def _evidence(text: str) -> Iterator[tuple[int, str]]:
    """What a rightly decoded text tells: itself, its foreign characters, and the telling words of each segment."""
    yield TEXTS, ""
    yield from _foreign(text)
    for s in segments(text):
        if not s.isascii():
            yield PHRASES, " ".join(_telling_words(s))


def _most_common(counts: DataFrame) -> dict[str, list[str]]:
    """The ``COMMON_WORDS`` most common of each language of (lang, w, n), the most common first."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    rows = counts.groupBy("lang", "w").agg(F.sum("n").alias("n")).withColumn("r", rank).where(F.col("r") <= COMMON_WORDS).orderBy("lang", "r").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["w"])
    return out


def _describe(evidence: DataFrame, plain: dict[str, int], plain_words: dict[str, list[str]], share: float) -> tuple[dict[str, bytes], dict[str, str]]:
    """Dictionaries, and alphabets of the foreign characters in at least ``share`` of a language's texts and in two.
    ``plain`` has the texts of each language without such characters."""
    texts, chars = Counter(plain), []
    for r in evidence.where(F.col("kind") != PHRASES).collect():
        if r["kind"] == TEXTS:
            texts[r["lang"]] += r["n"]
        else:
            chars.append(r)
    core: dict[str, set[str]] = {name: set() for name, n in sorted(texts.items()) if n >= 8}
    for r in chars:
        if r["lang"] in core and r["n"] >= max(2, share * texts[r["lang"]]):
            core[r["lang"]].add(r["what"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            seen: Counter[tuple[str, str]] = Counter()
            for lang, phrase, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                own = core.get(lang)
                if own is not None and all(ch < "\x80" or ch in own for ch in phrase):
                    seen[lang, phrase] += n
                    for w in phrase.split(" "):
                        if not w.isascii():
                            seen[lang, w] += n
            keys = list(zip(*seen, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "w", "n"])

    telling = _most_common(evidence.where(F.col("kind") == PHRASES).select("lang", "what", "n").mapInArrow(batches, "lang string, w string, n long"))
    dictionaries = {}
    for name in core:
        # the words that tell encodings apart come last, where a dictionary is cheapest to refer to
        own = [" ".join(reversed(words.get(name, []))).encode() for words in (plain_words, telling)]
        dictionaries[name] = (own[0][-DICT_BYTES // 2 :] + b" " + own[1])[-DICT_BYTES:] or b" "
    return dictionaries, {name: "".join(sorted(own)) for name, own in core.items()}


def fit(documents: DataFrame) -> tuple[dict[str, bytes], dict[str, str]]:
    """Dictionaries and alphabets from all labelled rows. The driver sees counts of characters and the most common words."""
    lang = F.lower(F.trim("lang"))
    labelled = documents.select(lang.alias("lang"), "text").where(lang.rlike("^[a-z]{2,3}$") & (lang != "und") & (F.length("text") > 40))
    suspect = F.col("text").rlike(_SUSPECT)
    rows, foreign = labelled.where(suspect), F.col("text").rlike(r"[^\x00-\x7F]")
    sizes = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~suspect).alias("plain")).collect()}
    plain = {name: r["plain"] for name, r in sizes.items()}
    # plain words are right in garbled texts too
    words = labelled.select("lang", F.explode(F.split("text", r"[ \t\r\n]+")).alias("w")).where(F.col("w").rlike(r"^[\x21-\x7E&&[^0-9]]{2,}$"))
    plain_words = _most_common(words.groupBy("lang", "w").agg(F.count("*").alias("n")))
    used, shares = Counter(), Counter()
    for r in _counts(labelled.where(foreign), lambda: _foreign).collect():
        used[r["what"]] += r["n"]
        shares[r["what"]] += r["n"] / sizes[r["lang"]]["n"]
    alphabet = {ch for ch, n in used.items() if n >= 2 and shares[ch] >= LEAST_SHARE * len(sizes)}

    def right(model: tuple[dict[str, bytes], dict[str, str]] | None) -> Callable[[], Counted]:
        """Evidence of the texts that no reading of UTF-8 can have led to and that the model, if any, leaves alone."""

        def counted() -> Counted:
            describer = Describer(*model) if model else None

            def of(text: str) -> Iterator[tuple[int, str]]:
                if LOST not in text and not _restorable(text, alphabet):
                    text = html.unescape(text)
                    if describer is None or not repair(text, describer)[0]:
                        yield from _evidence(text)

            return of

        return counted

    first = _describe(materialize(_counts(rows, right(None)), "evidence"), plain, plain_words, FIRST_SHARE)
    return _describe(materialize(_counts(rows, right(first)), "evidence"), plain, plain_words, LEAST_SHARE)


def judge_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, garbled, lost, restored) of every document with a foreign character or an escape; no other can be garbled."""
    model = fit(documents)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(*model)
        for part in it:
            found = [repair(t, describer) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x[0] for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.string())],
                names=["doc_id", "garbled", "lost", "restored"],
            )

    suspect = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(_SUSPECT))
    return suspect.mapInArrow(batches, "doc_id long, garbled boolean, lost boolean, restored string")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, lost, restored) of the documents of which at least a part was decoded wrongly."""
    return judge_documents(documents).where("garbled").select("doc_id", "lost", "restored")
