"""Nearest-time matching, the chosen-path join and the hash forest against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chosen_path, hash_forest, nearest_time
from tidemark.llm.words import WORD

NAMES = [f"w{i}" for i in range(4000)]


def overlap(a, b):
    x, y = set(WORD.findall((a or "").lower())), set(WORD.findall((b or "").lower()))
    return len(x & y) / len(x | y) if x or y else 0.0


def texts(seed=1, groups=25, others=60, common=12, size=40):
    """Stories and edited copies of them, with common words in all, empty and repeated texts."""
    rng = random.Random(seed)
    frequent = [f"the{i}" for i in range(common)]
    out = []
    for _ in range(groups):
        base = frequent + rng.sample(NAMES, size)
        for k in range(4):
            copy = list(base)
            for _ in range(k * 3):
                copy[rng.randrange(len(copy))] = rng.choice(NAMES)
            rng.shuffle(copy)
            out.append(" ".join(copy))
    out += [" ".join(frequent + rng.sample(NAMES, size)) for _ in range(others)]
    return out + [out[0], out[0].upper(), "", None, "short", "short"]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_equal_brute_force(spark, seed):
    data = texts(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(data)], "id long, text string, rep string, node int").select("id", "text")
    got = {tuple(r) for r in chosen_path.similar_pairs(df, 0.7).collect()}
    true = {(i, j) for i, j in itertools.combinations(range(len(data)), 2) if overlap(data[i], data[j]) >= 0.7}
    assert got <= true
    assert len(got) >= 0.98 * len(true)
    copies = {(i, j) for i, j in true if overlap(data[i], data[j]) == 1}
    assert copies <= got


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert chosen_path.similar_pairs(df, 0.7).count() == 0
    assert chosen_path.similar_pairs(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), 0.7).count() == 0


def test_classes_hold_a_hot_group(spark):
    df = spark.createDataFrame([(i, "one hot story told again and again") for i in range(300)] + [(300, "another")], "id long, text string")
    members, links = chosen_path.similar_classes(df, 0.7)
    assert {r["rep"] for r in members.collect()} == {0, 300} and links.count() == 0


def articles(seed=3):
    rng = random.Random(seed)
    frequent = ["strike", "idle", "pact", "with", "after"]
    rows, titles = [], []
    for i in range(240):
        if titles and rng.random() < 0.45:
            title = rng.choice(titles).split()
            for _ in range(rng.randrange(4)):
                title[rng.randrange(len(title))] = rng.choice(NAMES)
            title = " ".join(title)
        else:
            title = " ".join(frequent + rng.sample(NAMES, 9))
        titles.append(title)
        page = rng.randrange(160)
        url = rng.choice([f"https://www.a.example/p{page}/", f"http://M.A.example/p{page}?utm_x=1#top", f"https://a.example/p{page}?id={page}", None, ""])
        rows.append((i, title if rng.random() > 0.05 else None, url, i // 40))
    return rows


def greedy(rows, threshold=0.65):
    out, accepted = set(), []

    def page(u):
        if not u:
            return None
        u = u.lower().split("://")[1].split("#")[0]
        front, _, query = u.partition("?")
        front = front.removeprefix("www.").removeprefix("m.").rstrip("/")
        return front + (query if query.startswith("id=") else "")

    for i, t, u, _ in rows:
        hits = [j for j, s, v in accepted if overlap(t, s) >= threshold or (page(u) and page(u) == page(v))]
        if hits:
            out.add((min(hits), i))
        else:
            accepted.append((i, t, u))
    return out


@pytest.mark.parametrize("options, batches", [({"bucket_rows": 64}, 6), ({"solve_rows_at_once": 0}, 2)])
def test_forest_equals_greedy(spark, options, batches):
    rows = [r for r in articles() if r[3] < batches]
    df = spark.createDataFrame(rows, "id long, title string, url string, batch_no int")
    got = {tuple(r) for r in hash_forest.deduplicate(df, **options).collect()}
    assert got == greedy(rows)


def test_forest_goes_on_from_its_state(spark):
    rows = [r for r in articles(7) if r[3] < 4]
    df = spark.createDataFrame(rows, "id long, title string, url string, batch_no int")
    forest = hash_forest.HashForest(spark, bucket_rows=640)
    got = [forest.add_batch(df.where(F.col("batch_no") == k)) for k in range(2)]
    again = hash_forest.HashForest.resume(spark, forest.save(), bucket_rows=640)
    assert [r[:4] for r in again.runs] == [r[:4] for r in forest.runs] and again.titles == forest.titles == 80
    got += [again.add_batch(df.where(F.col("batch_no") == k)) for k in (2, 3)]
    assert {tuple(r) for g in got for r in g.collect()} == greedy(rows)
    assert sum(r.rows for r in again.runs) == len(rows) - len(greedy(rows)) and len(again.runs) < 5


def test_lookup_reads_few_files(spark):
    """A small batch reads the files of its own leaves, titles and pages, not the history."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(NAMES, 9)), f"https://a.example/p{i}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, title string, url string, batch_no int")
    forest = hash_forest.HashForest(spark, bucket_rows=1000)
    forest.add_batch(df)

    def files(kind, buckets):
        found = forest.stored(kind, buckets)
        scan = found._jdf.queryExecution().executedPlan().toString()
        filters = scan.partition("PartitionFilters: [")[2].partition("]")[0]
        return found.select(F.input_file_name()).distinct().count(), "p#" in filters

    for kind, least in ((hash_forest.TITLE, 4), (hash_forest.LEAF, 33), (hash_forest.PAGE, 4)):
        assert files(kind, None)[0] >= least
        few, pruned = files(kind, [0, 1, 2000])
        assert few <= 3 and pruned


def test_titles_of_frequent_words_are_widened():
    rng = random.Random(2)
    common = np.full(1 << hash_forest.BITS, 500_000)
    rule = hash_forest.Rule(1_000_000, common)
    tokens = np.array([[[rng.randrange(1 << hash_forest.BITS) for _ in range(hash_forest.DEPTH)] for _ in range(hash_forest.TREES)]])
    assert (rule.depths(tokens) == hash_forest.DEPTH).all()
    title, node = hash_forest.leaves(tokens, rule, hash_forest.THRESHOLD)
    cut = {sum(1 for k in range(hash_forest.DEPTH) if int(n) >> (hash_forest.BITS * k) & ((1 << hash_forest.BITS) - 1)) for n in node}
    assert min(cut) < hash_forest.DEPTH and hash_forest.recall_of(np.full((1, hash_forest.TREES), min(cut)), hash_forest.THRESHOLD)[0] >= hash_forest.RECALL


def test_null_batches_come_last(spark):
    rows = [(1, "one two three four", None, None), (2, "one two three four", None, 3), (3, None, "http://a.example/x", None), (4, "five six", "https://www.a.example/x/", 1)]
    df = spark.createDataFrame(rows, "id long, title string, url string, batch_no int")
    assert {tuple(r) for r in hash_forest.deduplicate(df).collect()} == {(2, 1), (4, 3)}


def test_hot_group_of_variants(spark):
    """A third of all rows are variants of one title: they meet its accepted member, not one another."""
    rng = random.Random(6)
    base = rng.sample(NAMES, 12)
    rows = []
    for i in range(600):
        words = list(base) if i % 3 == 0 else rng.sample(NAMES, 12)
        words[rng.randrange(12)] = f"x{i}"
        rows.append((i, " ".join(words), None, 0))
    df = spark.createDataFrame(rows, "id long, title string, url string, batch_no int")
    assert {tuple(r) for r in hash_forest.deduplicate(df, piece=40).collect()} == greedy(rows)


def test_forest_of_nothing(spark):
    df = spark.createDataFrame([], "id long, title string, url string, batch_no int")
    assert hash_forest.deduplicate(df).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0), (2, "", "", 0), (3, None, "", 1)], "id long, title string, url string, batch_no int")
    assert hash_forest.deduplicate(blank).count() == 0


def test_address(spark):
    same = ["https://www.x.example/a/B", "http://m.www.X.example/a/B/", "https://amp.x.example:443/a/B?utm_source=f#top", "x.example/a/B?ref=1"]
    other = ["https://x.example/a/b", "https://x.example/a/B?id=3", None, ""]
    df = spark.createDataFrame([(u,) for u in same + other], "u string")
    got = [r[0] for r in df.select(hash_forest.address(F.col("u"))).collect()]
    assert len(set(got[:4])) == 1 and got[4] != got[0] and got[5] == "x.example/a/B?id=3" and got[6:] == [None, None]


@pytest.mark.parametrize("tolerance", [0, 7, 7200])
def test_nearest_equals_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    span = 40 * max(tolerance, 3)
    right = [(rng.choice(["A", "A", "A", "B", None]), rng.choice([rng.randrange(span), None]), i, "x") for i in range(300)] + [("A", 50, 900, "x"), ("A", 50, 901, "x")]
    left = [(i, rng.choice(["A", "B", "C", None]), rng.choice([rng.randrange(span), None]), "y") for i in range(200)] * 2
    got = nearest_time.nearest_join(
        spark.createDataFrame(left, "lid long, key string, t long, lo string").drop("lo"), spark.createDataFrame(right, "key string, t long, id long, cell string"), tolerance
    )
    expected = []
    for lid, key, t, _ in left:
        near = [(abs(rt - t), rt, rid) for rk, rt, rid, _ in right if None not in (rk, rt, t) and rk == key and abs(rt - t) <= tolerance]
        if near:
            expected.append((lid, min(near)[2]))
    assert sorted((r["lid"], r["id"]) for r in got.collect()) == sorted(expected)


def test_extractions_match_prices_and_blank_tickers_do_not(spark):
    prediction = "struct<directly_affected:array<struct<ticker:string>>, data_quality:struct<article_date:string>>"
    t = lambda *names: [(n,) for n in names]
    when = ("2024-03-01T09:00:00Z",)
    rows = [(1, (t(" abc ", "ABC", "", None, "  "), when)), (2, (t("zzz"), when)), (3, (None, when)), (4, (t("ABC"), ("no date",))), (5, (t("ABC"), (None,))), (6, None)]
    prices = [(10, "abc", "2024-03-01T10:00:00Z"), (11, "ABC ", "2024-03-01T08:00:00Z"), (12, "", when[0]), (13, None, when[0]), (14, "  ", when[0]), (15, "ABC", "2024-03-02T10:00:00Z"), (16, "abc", None)]
    got = nearest_time.match_extractions(
        spark.createDataFrame(rows, f"extraction_id long, prediction {prediction}"),
        spark.createDataFrame(prices, "price_id long, `Stock Code` string, Date string"),
        spark.createDataFrame([("ABC", "Abc Plc", "UTC")], "ticker string, name string, listing_tz string"),
    )
    assert [tuple(r) for r in got.collect()] == [(1, 11)]


def test_large_batch_looks_through_the_history_once(spark, monkeypatch):
    """A batch of several pieces reads the history's leaves once, adds one run, and rejects what a greedy search does; what
    is too large to be broadcast is sifted."""
    monkeypatch.setattr(hash_forest, "BROADCAST_ROWS", 0)
    rows = articles(11)
    df = spark.createDataFrame(rows, "id long, title string, url string, batch_no int")
    forest = hash_forest.HashForest(spark, piece=10)
    stored, asked = forest.stored, []
    monkeypatch.setattr(forest, "stored", lambda kind, buckets: (asked.append(kind), stored(kind, buckets))[1])
    got = [forest.add_batch(df.where("id < 150"))]
    assert asked == [] and len(forest.runs) == 1
    got.append(forest.add_batch(df.where("id >= 150")))
    assert asked.count(hash_forest.LEAF) == 1
    assert {tuple(r) for g in got for r in g.collect()} == greedy(rows)


def test_sieve_lets_through_all_that_is_asked_for_and_little_else(spark):
    forest = hash_forest.HashForest(spark)
    rows = spark.range(0, 40_000).select((F.col("id") * 97 - 1_000_000).alias("key"))
    keys = rows.where("key % 50 = 0")
    found = forest.sifted(rows, keys)
    assert keys.join(found, "key", "left_anti").isEmpty() and keys.count() <= found.count() < 8000
    assert forest.sifted(rows, keys.limit(0)).isEmpty()
