"""Filling containers of fixed capacity with whole texts by shortest-pack-first histogram packing.

Sizes are tokens of the byte-level tokenizer: one a UTF-8 byte and one end token. Only the histogram of sizes is packed:
sizes are placed longest first, each into the packs that are shortest so far and still have room, and what is counted are
packing patterns, not packs. Texts are then joined to the patterns by their rank among texts of their size, so the work on
the driver is bounded by the capacity and never by the number of texts.

A text above the capacity is cut into full pieces and a rest; every other text stays whole. Ranks within a size come from
salted ranks and the offsets of the salts, as many as a size has texts for, so a size with a third of all texts is no
single task.

Defined results: an empty text is its end token. A null text is no text and is not placed. Repeated texts are placed
each. A capacity below 1 raises ValueError.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_ROWS = 100_000  # texts of one size that are ranked in a task, about
BROADCAST_SLOTS = 500_000  # slot rows below this many (20 MB) are broadcast to the items, above they are joined by shuffle


def byte_tokens(text: Column) -> Column:
    """Tokens of a text: its UTF-8 bytes and an end token."""
    return (F.octet_length(text) + 1).cast("long")


def pack_histogram(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of packs, [(size, how often)]) for a histogram [(size, count)] of sizes up to the capacity."""
    open_packs: dict[int, list[list]] = {}  # room left: [packs, pattern as a linked list]
    rooms: list[int] = []

    def put(room: int, packs: int, pattern: tuple) -> None:
        if room not in open_packs:
            open_packs[room] = []
            heapq.heappush(rooms, -room)
        open_packs[room].append([packs, pattern])

    for size, left in sorted(histogram, reverse=True):
        if size > capacity:
            raise ValueError(f"size {size} exceeds the capacity {capacity}")
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                open_packs.pop(-heapq.heappop(rooms), None)
            room = -rooms[0] if rooms else -1
            if room < size:
                fit = capacity // size
                whole, rest = divmod(left, fit)
                pattern: tuple | None = None
                for _ in range(rest):
                    pattern = (size, pattern)
                if rest:
                    put(capacity - rest * size, 1, pattern)
                for _ in range(fit - rest):
                    pattern = (size, pattern)
                if whole:
                    put(capacity - fit * size, whole, pattern)
                left = 0
                continue
            bucket = open_packs[room]
            packs, pattern = bucket.pop()
            used = min(packs, left)
            if used < packs:
                bucket.append([packs - used, pattern])
            put(room - size, used, (size, pattern))
            left -= used
    out = []
    for bucket in open_packs.values():
        for packs, pattern in bucket:
            counts: dict[int, int] = {}
            while pattern is not None:
                counts[pattern[0]] = counts.get(pattern[0], 0) + 1
                pattern = pattern[1]
            out.append((packs, sorted(counts.items(), reverse=True)))
    return out


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, items a pack, first container) for every size of every pattern."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for packs, content in patterns:
        for size, times in content:
            lo = taken.get(size, 0)
            taken[size] = lo + times * packs
            out.append((size, lo, taken[size], times, base))
        base += packs
    return out


def pieces(documents: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, first_token, n_tokens): every text as one item, or cut at the capacity where it exceeds it."""
    sized = documents.where(F.col(text).isNotNull()).select(F.col(id_col), byte_tokens(F.col(text)).alias("tokens"))
    cut = sized.select(id_col, "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.lit(capacity)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select(id_col, "piece", start.alias("first_token"), F.least(F.col("tokens") - start, F.lit(capacity).cast("long")).alias("n_tokens"))


def pack(documents: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(container, id, piece, first_token, n_tokens): the arrangement of all texts in containers of ``capacity``."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    spark = documents.sparkSession
    items = pieces(documents, capacity, id_col, text)
    histogram = [(r[0], r[1]) for r in items.groupBy("n_tokens").agg(F.count("*")).collect()]  # at most ``capacity`` rows
    salts = spark.createDataFrame([(size, 1 + c // SALT_ROWS) for size, c in histogram], "n_tokens long, salts long")
    items = items.join(F.broadcast(salts), "n_tokens").withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), "salts")).drop("salts")
    counts = items.groupBy("n_tokens", "salt").agg(F.count("*").alias("c"))
    slots = slots_of(pack_histogram(histogram, capacity))
    table = spark.createDataFrame(slots, "size long, lo long, hi long, times long, base long")
    table = F.broadcast(table) if len(slots) <= BROADCAST_SLOTS else table
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(id_col, "piece"))
    ranked = items.withColumn("r", within).join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("r") - 1 + F.col("offset"))
    placed = ranked.join(table, (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("times")).cast("long")
    return placed.select(container.alias("container"), id_col, "piece", "first_token", "n_tokens")
