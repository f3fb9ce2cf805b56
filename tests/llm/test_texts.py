"""Truncation, packing, leakage and encoding repair on small texts."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import encoding_repair, leakage, packing, truncation
from tidemark.llm.words import WORD

NOUNS = ["fund", "plant", "bank", "mill", "port", "road", "farm", "shop"]
VERBS = ["sold", "bought", "raised", "closed", "opened", "leased"]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} its {rng.choice(NOUNS)} for {rng.randrange(9000)} crowns in {rng.choice(['May', 'June', 'July'])}."


def test_truncated_values(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        body = " ".join(sentence(rng) for _ in range(6))
        rows.append([i, "A title of the story", f"About {i}.", body, "s"])
    cut = {}
    for i in range(0, 40):
        rows[i][3] = rows[i][3][: 120 + 3 * i]
        cut[i] = rows[i][3]
    for i in range(40, 60):
        rows[i][3] = rows[i][3][:150] + "… [+90 chars]"
    for i in range(60, 80):
        rows[i][3] = rows[i][3].removesuffix(".")
    for i in range(80, 100):
        rows[i][3] += "\n© Morning Post"
    rows[100][3], rows[101][3], rows[102][2] = None, "", "  "
    df = spark.createDataFrame([tuple(r) for r in rows], "id long, title string, description string, content string, source_name string")
    found = truncation.truncated_values(df)
    got = {r["id"] for r in found.collect() if r["field_name"] == "content"}
    inside = {i for i, t in cut.items() if not t.rstrip().endswith((".", "May", "June", "July"))}
    assert len(got & inside) >= 0.95 * len(inside)
    assert set(range(40, 60)) <= got
    assert len(got & set(range(60, 400))) <= 2
    report = truncation.truncation_by_source(df, found).first()
    assert report["n_values"] == 799 and report["n_cut"] == found.count()
    assert truncation.truncated_values(df.limit(0)).count() == 0


def copies_judged(values):
    ends, found = truncation.both_passes(values)
    return truncation.copies_judged(ends, found.where("total is null"), values).collect()


def test_every_copy_of_a_hot_group_is_compared(spark):
    rng = random.Random(8)
    whole = " ".join(sentence(rng) for _ in range(40))
    bare = whole[: whole.rindex(" crowns in ")]  # cut inside the last sentence
    finished = "Nothing more was said. " + whole[: whole.rindex(". ")] + "."
    texts = [bare] * 20 + [whole] + [finished] * 20 + [bare] * 20
    values = spark.createDataFrame([(i, "content", t) for i, t in enumerate(texts)], "id long, field string, text string")
    got = {r["id"]: r["verdict"] for r in copies_judged(values)}
    assert got == {i: 1 for i, t in enumerate(texts) if t == bare}


def test_copy_in_the_middle_proves_the_cut(spark):
    """Neither the least nor the greatest id of a band, nor its longest text, tells; one between them does."""
    rng = random.Random(10)
    lines = [sentence(rng) for _ in range(200)]
    whole = " ".join(lines)
    bare = whole[: whole.rindex(" crowns in ")]
    mute = [" ".join(bare.split()[:-2]) + " " + "long" * 20 + str(k) for k in range(12)]  # without the open value's last words
    texts = [*mute[:6], bare, whole, *mute[6:]]
    values = spark.createDataFrame([(i, "content", t) for i, t in enumerate(texts)], "id long, field string, text string")
    assert (6, 1) in [(r["id"], r["verdict"]) for r in copies_judged(values)]


def test_bit_tables_grow_with_their_keys(spark, monkeypatch):
    """Few keys are taken for asked ones that are not, however many are asked for."""
    monkeypatch.setattr(truncation, "TABLE_BITS", 15)
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 60_000)
    table = truncation.bit_table(spark.createDataFrame(pd.DataFrame({"k": keys[:30_000]})))
    asked = truncation._asked(table, keys.view(np.uint64))
    assert asked[:30_000].all() and asked[30_000:].mean() < 1 / 16


def test_texts_are_compared_at_the_same_anchor_only():
    """Windows a word apart are alike but have no band in common; equal ones have all."""
    shingles = truncation.shingles_of(np.random.default_rng(2).integers(1, 2**63, 60).astype(np.uint64))
    one, other, same = truncation.window_bands(np.concatenate([shingles, shingles[:50]]), np.array([10, 11, 10 + len(shingles)]), np.array([42, 43, 42 + len(shingles)]))
    assert not set(one) & set(other) and (one == same).all()


def test_statistics_do_not_depend_on_batches(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        body = " ".join(sentence(rng) for _ in range(5))
        rows.append((i, "A title of the story", f"About {i} in the", body[: 90 + i] if i % 7 == 0 else body.removesuffix(".") if i % 5 == 0 else body))
    df = spark.createDataFrame(rows, "id long, title string, description string, content string")
    seen = []
    for size in (7, 100, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        seen.append(sorted(tuple(r) for r in truncation.judged_values(df).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 300


@pytest.mark.parametrize(
    "text, state",
    [
        (None, None), ("  ", None), ("It closed.", None), ("It closed", ("open", "It closed")), ("It cl…", ("open", "It cl")), ("It closed...", ("open", "It closed")), ("It closed. …", None),
        ("It closed [+90 chars]", ("cut", "")), ("It closed &am", ("cut", "")), ("It closed,", ("cut", "")), ("It closed. (By " + "a hand " * 60 + ")", None), ("It closed (by " + "a hand " * 60 + ")", ("open", "It closed (by " + "a hand " * 60 + ")")),
        ("It closed.\n***", None), ("It closed.\n" + "-" * 300, None), ("It rose by 3.", ("open", "It rose by 3")), ("It rose 3%", ("open", "It rose 3%")),
    ],
)
def test_open_end(text, state):
    assert truncation.open_end(text) == state


def test_alignment_decides():
    whole = " ".join(sentence(random.Random(k)) for k in range(10))
    assert truncation.judge(whole[len(whole) // 2 : -20], whole) == 1  # a part of the copy
    assert truncation.judge(whole[:-20], whole) == 1
    assert truncation.judge(whole.rpartition(". ")[0], whole) == 0
    assert truncation.judge("nothing alike in these few words", whole) is None


@pytest.mark.parametrize("capacity", [1, 7, 64, 300])
def test_packing_places_everything_once(spark, capacity):
    rng = random.Random(capacity)
    texts = ["x" * rng.choice([0, 1, 2, 30, 30, 30, rng.randrange(400)]) for _ in range(300)] + ["é" * 20, None, None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, container string").select("doc_id", "text")
    rows = packing.pack(df, capacity).collect()
    load, by_doc = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(load.values()) <= capacity
    for i, t in enumerate(texts):
        if t is None:
            assert i not in by_doc
            continue
        tokens, at = len(t.encode()) + 1, 0
        for _, first, n in sorted(by_doc[i]):
            assert first == at
            at += n
        assert at == tokens and len(by_doc[i]) == -(-tokens // capacity)
    total = sum(load.values())
    assert len(load) <= 1.25 * -(-total // capacity) + 2
    assert sorted(load) == list(range(len(load)))
    assert packing.pack(df.limit(0), capacity).count() == 0


def test_packing_rejects_no_capacity(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 0)


def test_leakage_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(50)] + ["the"] * 30
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 30])))) for k in range(30)] + [(90, None), (91, ""), (92, "the " * 20)]
    docs = []
    for i in range(200):
        body = [rng.choice(vocabulary) for _ in range(60)]
        if i % 3 == 0:
            words = rng.choice(items[:30])[1].split()
            at = rng.randrange(max(1, len(words) - 12))
            body[20:20] = words[at : at + rng.choice([12, 13, 20])]
        docs.append((i, " ".join(body).upper().replace(" ", ", ")))
    docs += [(500, None), (501, ""), (502, "the " * 40), (503, docs[0][1])]
    grams = {}
    for k, t in items:
        w = WORD.findall((t or "").lower())
        for a in range(len(w) - 12):
            grams.setdefault(tuple(w[a : a + 13]), set()).add(k)
    true = set()
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        for a in range(len(w) - 12):
            true |= {(i, k) for k in grams.get(tuple(w[a : a + 13]), ())}
    index = leakage.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = leakage.phrase_matches(index, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == true
    none = leakage.phrase_matches(leakage.build_index(spark.createDataFrame([], "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert none.count() == 0


def test_leakage_in_blocks_and_small_segments(spark, monkeypatch):
    """Blocks of items and many segments give what one of each gives."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["the"] * 20
    items = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(12)], "item_id long, text string")
    texts = [r["text"] for r in items.collect()]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(30)) + " " + " ".join(texts[i % 12].split()[i % 9 : i % 9 + 15])) for i in range(60)], "doc_id long, text string")
    index = leakage.build_index(docs)
    one = sorted(map(tuple, leakage.phrase_matches(index, items).collect())), sorted(map(tuple, leakage.proximity_matches(index, items).collect()))
    monkeypatch.setattr(leakage, "SEGMENT_TOKENS", 100)
    small = leakage.build_index(docs)
    assert small.count() > index.count()
    blocks = list(leakage.item_blocks(items, size=70))
    assert len(blocks) == 6 and sum(len(b.ids) for b in blocks) == 12
    schema = "doc_id long, item_id long, n long"
    assert sorted(tuple(r) for b in blocks for r in leakage._phrases(small, b, 13, schema).collect()) == one[0] and len(one[0]) >= 60
    assert sorted(tuple(r) for b in blocks for r in leakage._proximity(small, b, 8, 6, 60, schema.replace("n long", "n int")).collect()) == one[1]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta x eta y theta z iota kappa lambda"), (2, "zeta " + "pad " * 200 + "eta theta " + "pad " * 200 + "iota kappa lambda")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "lambda kappa iota theta eta zeta")], "item_id long, text string")
    got = leakage.proximity_matches(leakage.build_index(docs), items, rarest=6, least=6, span=20).collect()
    assert [(r["doc_id"], r["item_id"], r["n_terms"]) for r in got] == [(1, 7, 6)]


FRENCH = ["La société a relevé son bénéfice grâce à l’activité récente.", "Le régulateur a été saisi d’une plainte déposée hier.", "Côté prêts, l’encours a progressé malgré la hausse du coût."]
RUSSIAN = ["Выручка в регионе выросла до рекорда.", "Склад закрыт из-за забастовки рабочих.", "Совет директоров рассмотрит выплату дивидендов."]


def garble(text, truly, read_as):
    return text.encode(truly).decode(read_as)


def test_encoding_repair(spark):
    rows = [(i, f"{FRENCH[i % 3]} Note {i}. {FRENCH[(i + 1) % 3]}", "fr") for i in range(60)] + [(100 + i, f"{RUSSIAN[i % 3]} {RUSSIAN[(i + 1) % 3]} {i}", "ru") for i in range(60)]
    bad = [
        (300, FRENCH[0] + " " + FRENCH[1].encode().decode("latin-1"), "fr"), (301, garble(FRENCH[2], "utf-8", "cp437"), "fr"), (302, garble(garble(FRENCH[1], "utf-8", "mac_roman"), "utf-8", "mac_roman"), "fr"),
        (303, garble(RUSSIAN[0], "cp1251", "latin-1"), "ru"), (304, garble(RUSSIAN[1], "koi8_r", "cp1251"), "ru"), (305, "Le r�gulateur a �t� saisi.", "fr"),
    ]
    fine = [(400, "Le march&#233; est calme.", "fr"), (401, None, "fr"), (402, "", None), (403, "plain ASCII & more", "en"), (404, "in\xa0the\xa0worked case", "en"), (405, "AVALIAÇÃO: a posição de hoje.", None)]
    df = spark.createDataFrame(rows + bad + fine, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in encoding_repair.garbled_documents(df).collect()}
    assert set(got) == {b[0] for b in bad}
    assert got[300]["restored"] == FRENCH[0] + " " + FRENCH[1] and got[301]["restored"] == FRENCH[2] and got[302]["restored"] == FRENCH[1]
    assert got[303]["restored"] == RUSSIAN[0] and got[304]["restored"] == RUSSIAN[1] and got[305]["lost"]
    assert encoding_repair.garbled_documents(df.limit(0)).count() == 0


def test_garbled_words_of_known_letter_runs_are_tried(spark):
    """Letters around the wrong characters that also occur elsewhere in the sample, in another case and language, excuse nothing."""
    rows = [(i, f"“Nobody sold the print-run” today, said the auditor of plant {i}.", "en") for i in range(60)]
    rows += [(100 + i, f"{FRENCH[i % 3]} Les ôner sont en nö ici. {i}", "fr") for i in range(60)]
    bad = [(300, "ôNobody sold the print-runö today.", "en")]
    df = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["restored"] for r in encoding_repair.garbled_documents(df).collect()}
    assert got == {300: "“Nobody sold the print-run” today."}


def test_the_models_are_fitted_on_all_labelled_rows(spark):
    """Letters in three of 900 texts each are all in the alphabet, wherever the texts that have them stand."""
    rare = "āēīūģķļņŗōĝĥ"
    rows = [(i, f"{FRENCH[i % 3]} Note {i} {f'de la{rare[i // 3]}me' if i < 3 * len(rare) else 'du jour'}. {FRENCH[(i + 1) % 3]}", "fr") for i in range(900)]
    dictionaries, alphabets = encoding_repair.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(rare) <= set(alphabets["fr"]) and len(dictionaries["fr"]) <= encoding_repair.DICT_BYTES
    assert all(f"la{ch}me" in dictionaries["fr"].decode(errors="ignore") for ch in rare)


def test_words_are_counted_in_full_over_all_parts(spark):
    """Numbers and marks are not passed on, and of the words only those frequent in one of the parts are summed, in full."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 12)) + f" {i}, 7% done." for i in range(20_000)]
    values = spark.createDataFrame([(i, "content", t) for i, t in enumerate(texts)], "id long, field string, text string").repartition(2)
    scanned = truncation.word_counts_and_ends(values).persist()
    words = [r for r in scanned.where("w is not null").collect()]
    assert all(not r["w"] or r["w"][0].isalpha() or r["w"][0] == "\0" for r in words)
    assert sum(r["cut"] for r in words) < len(words) / 2
    counts = Counter(w for t in texts for w in set(truncation.TOKEN.findall(t)) if w[0].isalpha())
    least = truncation.FREQUENT * len(texts)
    assert truncation.frequent_words(scanned) == {w: c / len(texts) for w, c in counts.items() if c >= least}
    scanned.unpersist()


def test_rare_words_have_the_kinds_of_their_classes():
    known = {"the": 0.5, "of": 0.01, "The": 0.2, "Bank": 0.01, "bank": 0.02}
    words = "the of The Bank Zub ZUB Z zub z 12 12% 3.5 ² ²% Ⅷ ⅷ ⅷa ª Éa éa _a May . , … Ⓐ 東京 the's Of I".split()
    lexicon = truncation.Lexicon(known)
    numbers = [lexicon[w] for w in words + words]
    fine, coarse, stop, dots, upper, whole, hashes = (t[numbers] for t in lexicon.tables())
    classes = [truncation.class_of(w, known) for w in words + words]
    assert (fine == truncation.hash_words([c[0] for c in classes])).all() and (coarse == truncation.hash_words([c[1] for c in classes])).all()
    assert [bool(u) for u in upper] == [not w[0].islower() for w in words + words]
    assert [bool(h) for h in hashes] == [w[0].isalnum() for w in words + words]
    assert [bool(x) for x in whole] == [c[0] not in ("x", "I") for c in classes]
