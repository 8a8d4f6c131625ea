"""The operators of the llm subpackage: brute force on small fixtures, round trips, held-out accuracy, edge cases."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.llm import abuse, boosting, language, mixing, packing, pii, spans, splitting
from archivolt.llm.tokens import clean_source, token_count

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, n_tokens string, piece string, shard string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], DOCS)


# ---- tokens --------------------------------------------------------------------------------------------------------


def test_token_count(spark):
    texts = ["", " \t\n 　", "ab1 c-d", "é中文 x", "😀😀 a", "a b", None, "..", "x" * 5000]
    want = [0 if t is None else len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\t\n\r  　]", t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == want
    src = spark.createDataFrame([("  A-b \n",), (" ",), (None,)], "s string")
    assert [r[0] for r in src.select(clean_source(F.col("s"))).collect()] == ["a-b", None, None]


# ---- 1: personal information ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail ann.b+x@host.example, please", [("email", "ann.b+x@host.example")]),
        ("write to ann [at] host [dot] example now", [("email", "ann [at] host [dot] example")]),
        ("reach me at ann dot b at mail dot host dot example after six", [("email", "ann dot b at mail dot host dot example")]),
        ("ｔｏｓａ＠ｈｏｓｔ．ｅｘａｍｐｌｅ！", [("email", "ｔｏｓａ＠ｈｏｓｔ．ｅｘａｍｐｌｅ")]),
        ("v​b​@host.test", [("email", "v​b​@host.test")]),
        ("Write the at sign as @ on the label.", []),
        ("Tel. +44 (0)20 7946-0785 ring", [("phone", "+44 (0)20 7946-0785")]),
        ("My number is (568) 555 0188 ext. 69", [("phone", "(568) 555 0188")]),
        ("my number is five five five oh one oh five, ring", [("phone", "five five five oh one oh five")]),
        ("我的电话是13900049354，请打来", [("phone", "13900049354")]),
        ("The card reads QQ 43 27 50 C, lost", [("id_number", "QQ 43 27 50 C")]),
        ("Passport or insurance no. 945-18-7923", [("id_number", "945-18-7923")]),
        ("身份证号码为992794195611246010。", [("id_number", "992794195611246010")]),
        ("Order 2019-06-16 came in 6 boxes of 832.", []),
        ("Ticket 8418-190 was closed at 10:45. reel 78017/8, side B [24833/94]", []),
        ("lives at 107B Copper Mill Lane, York", [("address", "107B Copper Mill Lane")]),
        ("moved to one hundred and six old ferry lane in york", [("address", "one hundred and six old ferry lane")]),
        ("Larkspur Row was closed for the parade.", []),
        ("habite 17 ter rue des Tisserands-Bleus", [("address", "17 ter rue des Tisserands-Bleus")]),
        ("wohnt hier: Alte Fährgasse 157.", [("address", "Alte Fährgasse 157")]),
        ("包裹寄到云栖市望塔区白鹭巷60号。", [("address", "云栖市望塔区白鹭巷60号")]),
        ("Signed by Dr. Wenda R. Orrowby with care", [("name", "Wenda R. Orrowby")]),
        ("According to Montorvel, Saskira, the reel", [("name", "Montorvel, Saskira")]),
        ("Regards, Paula Winterfeld", [("name", "Paula Winterfeld")]),
        ("The Quillmere Trust and the Harrow Lantern Archive share one vault.", []),
        ("据虞锦漪说，磁带是空的。", [("name", "虞锦漪")]),
    ],
)
def test_pii(text, want):
    found = pii.default_finder().find(text)
    assert [(s.kind, text[s.start : s.end].strip()) for s in found] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("then she said five five five oh one oh five and hung up", [("phone", "five five five oh one oh five")]),
        ("she said five five five oh one oh five, in box 1", [("phone", "five five five oh one oh five")]),
        ("dann sagte sie null drei null vier vier sechs eins und ging", [("phone", "null drei null vier vier sechs eins")]),
        ("她说一三九零零零四九三五四。", [("phone", "一三九零零零四九三五四")]),
        ("they found QQ123456C in the drawer", [("id_number", "QQ123456C")]),
        ("they found RSSMRA85T10A562S in the drawer", [("id_number", "RSSMRA85T10A562S")]),
        ("one or two came, then three or four, and five of the six left at seven", []),
        ("shelf mark d17433", []),
    ],
)
def test_pii_without_cue(text, want):
    found = pii.default_finder().find(text)
    assert [(s.kind, text[s.start : s.end]) for s in found] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("then Mr John Miller came in", ["John Miller"]),
        ("gestern war Frau Dr. Anna von Altenberg da", ["Anna von Altenberg"]),
        ("it was Mrs. J. R. Hathaway who wrote", ["J. R. Hathaway"]),
        ("hier, Mme Claire Dupont a écrit", ["Claire Dupont"]),
        ("they met at Dr John Miller Street", []),
        ("the Mr John Miller Trust gave it", []),
        ("Mr Speaker, the house is full", []),
    ],
)
def test_pii_titled_names_outside_the_gazetteer(text, want):
    assert [text[s.start : s.end] for s in pii.default_finder().find(text) if s.kind == "name"] == want


def test_pii_gazetteer_name_that_is_a_digit_word():
    finder = pii.Finder(pii.Names(frozenset(["anna"]), frozenset(["acht"]), frozenset()))
    assert [s.kind for s in finder.find("Anna Acht said five five five oh one oh five")] == ["name", "phone"]


def test_pii_table(spark):
    rows = [("atom", "a", "x@y.example " * 500, 1), ("atom", "a", None, 2), ("atom", None, "", 3), ("segment", "s", "Tel. 020 7946 0446", 4), ("segment", "s", "Tel. 020 7946 0446", 4)]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, text string, span_start int")
    got = pii.find_all(df)
    assert got.where("pii_type = 'email'").count() == 500 and got.where("pii_type = 'phone'").count() == 2
    clean = {r.item_id: (r.text, r.n_found) for r in pii.redact_all(df).collect() if r.text}
    assert clean["s"] == ("Tel. [PHONE]", 1) and clean["a"] == ("[EMAIL] " * 500, 500)
    assert pii.find_all(df.where("false")).count() == 0


def test_learned_names(spark):
    """Names in no list are learned from where they are announced and then found in running text, in any letter case."""
    rng = random.Random(12)
    syllables = ["ka", "lo", "mi", "ren", "tos", "vel", "dra", "nu", "shi", "por", "gal", "wen"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).capitalize()
    given, family = [word(2) for _ in range(25)], [f"{rng.choice(['', '', 'van '])}{word(3)}" for _ in range(25)]
    assert not {g.lower() for g in given} & pii.COMMON.given
    cues = ["Regards, {n}", "the letter was signed by {n} today", "according to {n}, it was blank", "Dr. {n} kept it", "Cordialement, {n}", "wir sprachen mit {n} darüber", "you can reach {n} by post"]
    things = ["according to The Quillmere Trust it was", "we spoke with Harrow Lantern Archive", "said Larkspur Row", "reach Copper Mill Lane", "and Harbour Light, according to Harbour Light"]
    texts = [rng.choice(cues).format(n=f"{rng.choice(given)} {rng.choice(family)}") for _ in range(600)] + things * 20 + [None, ""]
    names = pii.learn_names(spark.createDataFrame([(t, "x") for t in texts], "text string, item_id string"))
    assert not {"quillmere", "harrow", "lantern", "larkspur", "harbour"} & (names.given | names.family)
    finder, hit, held = pii.Finder(names), 0, 400
    for i in range(held):
        name = f"{rng.choice(given)} {rng.choice(family)}"
        text = f"then {name.lower() if i % 3 == 0 else name.upper() if i % 3 == 1 else name} read the pages aloud"
        hit += [(s.kind, s.start, s.end) for s in finder.find(text)] == [("name", 5, 5 + len(name))]
    assert hit / held >= 0.9, hit
    assert pii.default_finder().find("then kalo vanmirento read the pages") == []
    assert pii.learn_names(spark.createDataFrame([], "text string")) == pii.COMMON


def test_long_spoken_address():
    local = " dot ".join(["ann", "bea", "cleo", "dora", "edith", "flora", "greta", "hanna", "ida", "jana"])
    text = f"reach me at {local} at mail dot host dot example after six"
    assert [(s.kind, text[s.start : s.end]) for s in pii.default_finder().find(text)] == [("email", f"{local} at mail dot host dot example")]


def test_cue_behind_a_number():
    text = "We note X0966123 as the identity number. We note X0966123 as the shelf."
    assert [(s.kind, s.start) for s in pii.default_finder().find(text)] == [("id_number", 8)]


# ---- 2: abuse ------------------------------------------------------------------------------------------------------

def labelled(d):
    """(text, is_abusive, category) of the review sample of a data folder, by item."""
    import pyarrow.parquet as pq

    read = lambda t: pq.read_table(f"{d}/{t}.parquet").to_pylist()
    texts = {("document", str(r["doc_id"])): r["text"] for r in read("documents")} | {("atom", r["atom_id"]): r["text"] for r in read("atoms")}
    rows = sorted(read("moderation_labels"), key=lambda r: (r["item_kind"], r["item_id"]))
    return [(texts[k], r["is_abusive"], r["category"]) for r in rows if (k := (r["item_kind"], r["item_id"])) in texts and texts[k]]


@pytest.fixture(scope="module")
def sample():
    return labelled("/root/testdata/sf0.1")


def test_abuse_held_out(sample):
    """Precision and recall on labels that the fit has not seen. Some labels are wrong, so neither can be 1, and these are
    few: with 4,000 both are above 0.9 (README)."""
    good = wrong = missed = 0
    for part in range(3):
        model = abuse.fit([r for i, r in enumerate(sample) if i % 3 != part])
        held = [r for i, r in enumerate(sample) if i % 3 == part]
        found = (model.scores([t for t, _, _ in held], model.matcher()) >= abuse.THRESHOLD).any(axis=1)
        good += sum(bool(f) and bool(b) for f, (_, b, _) in zip(found, held, strict=True))
        wrong += sum(bool(f) and not b for f, (_, b, _) in zip(found, held, strict=True))
        missed += sum(not f and bool(b) for f, (_, b, _) in zip(found, held, strict=True))
    assert good / (good + wrong) >= 0.9 and good / (good + missed) >= 0.75, (good, wrong, missed)


def test_abuse_trees_decide(sample):
    """Without the trees there is no score, and labels turned round turn the scores round: nothing is set by hand."""
    texts = ["You are a worthless asshole and everyone knows it.", "The archivist kept the recipe cards in a single afternoon."]
    model = abuse.fit(sample)
    plain = model.scores(texts, model.matcher())[:, 0]
    assert plain[0] > 0.5 > plain[1]
    bare = abuse.fit([])
    assert len(set(bare.scores(texts, bare.matcher())[:, 0])) == 1
    turned = abuse.fit([(t, 1 - b, None if b else "harassment") for t, b, _ in sample])
    assert turned.scores(texts, turned.matcher())[0, 0] < 0.5
    used = {abuse.FEATURES[j] for t in model.trees for j in t.used()}
    assert any("vocabulary" in f for f in used) and any("near" in f for f in used) and "insult" in used


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("a s.a.l.a.u.d and more", "a salaud and more"),
        ("looooowlife", "lowlife"),
        ("a dumb4$$ here", "a dumbass here"),
        ("what an @sshole", "what an asshole"),
        ("$alaud", "salaud"),
        ("5hithead", "shithead"),
        ("a cr*tin like", "a cretin like"),
        ("a dumbаss", "a dumbass"),
        ("ba\u200bstard", "bastard"),
        ("those m i g r a n t s", "those migrants"),
        ("shelf mark a553 and 65317cac", "shelf mark a553 and 65317cac"),
        ("1st of may, no. 3b!", "1st of may, no. 3b!"),
    ],
)
def test_undisguise(text, plain):
    matcher = abuse.Matcher(abuse.LEXICONS)
    assert abuse.undisguise(text, matcher)[0] == plain
    x = abuse.read([text], matcher).x
    assert (x[:, abuse.FEATURES.index("obfuscation")].max() > 0) == (text != plain)


def test_abuse_sentences():
    """Vectors by sentence do not depend on the other texts of a run; every text has a sentence; full width is plain."""
    matcher = abuse.Matcher(abuse.LEXICONS)
    texts = ["", "One. Two! You idiot", "\n\n", "Ｙｏｕ ｉｄｉｏｔ", "你是白痴。好", "x" * 50_000]
    together = abuse.read(texts, matcher)
    assert len(together.first) == len(texts) + 1 and (np.diff(together.first) >= 1).all()
    for i, t in enumerate(texts):
        assert np.allclose(abuse.read([t], matcher).x, together.x[together.first[i] : together.first[i + 1]])
    mild, near = abuse.FEATURES.index("mild"), abuse.FEATURES.index("insult+mild near second")
    assert together.x[together.first[1] : together.first[2], mild].max() > 0 and together.x[together.first[3], near] > 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.boost(x[:600], y[:600])
    held = model.margin(x[600:])
    assert ((held > 0) == y[600:]).mean() > 0.9
    assert np.allclose(model._sum(boosting.binned(x[600:], model.edges)), held)
    steps = boosting.isotonic(held, y[600:])
    p = boosting.calibrate(np.sort(held), steps)
    assert (np.diff(p) >= -1e-12).all() and 0 <= p.min() and p.max() <= 1
    assert boosting.boost(x[:3], np.ones(3)).leaf == []
    twice = boosting.boost(np.concatenate((x[:300], x[:300])), np.concatenate((y[:300], y[:300])))
    weighted = boosting.boost(x[:300], y[:300], np.full(300, 2.0))
    assert np.allclose(twice.margin(x), weighted.margin(x))


def test_abuse_table(spark):
    rng = random.Random(1)
    fine = "The archivist kept the notes about the orchard."
    rows = [(f"{fine} " * rng.randint(1, 5) + f"You are a worthless {rng.choice(["moron", "cretin"])}.", 1, "harassment") for _ in range(60)] + [(f"{fine} " * rng.randint(1, 5), 0, None) for _ in range(60)]
    model = abuse.fit(rows)
    texts = [("document", "1", "A", "You are a worthless cretin."), ("document", "2", " a", fine), ("document", "3", None, None), ("atom", "4", None, ""), ("atom", "5", None, fine * 3000)]
    df = spark.createDataFrame(texts, "item_kind string, item_id string, source string, text string")
    scores = abuse.score(df, model)
    assert [(r.item_id, r.category) for r in abuse.found_categories(scores).collect()] == [("1", "harassment")]
    rates = {r.source: (r.n_docs, r.harassment_rate) for r in abuse.source_rates(scores).collect()}
    assert rates == {"a": (2, 0.5), "unknown": (1, 0.0)}
    labels = spark.createDataFrame([("document", "1", 1, "harassment"), ("document", "2", 0, None), ("document", "9", 1, "hate"), (None, None, None, None)], "item_kind string, item_id string, is_abusive int, category string")
    assert abuse.fit_labels(df, labels).lexicons == abuse.LEXICONS
    assert abuse.score(df.where("false"), abuse.fit([])).count() == 0


# ---- 3: language ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples():
    import pandas as pd

    path = f"{SF}/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    t = pd.read_parquet(path)
    return list(zip(t["lang"], t["text"], strict=True))


def test_language_held_out(samples):
    model = language.fit(samples[::2])
    right = 0
    for lang, text in samples[1::2]:
        s = model.score(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.array([0]))
        right += language.LANGUAGES[s["best"][int(s["letters"].argmax())]] == lang
    assert right / len(samples[1::2]) > 0.98


def test_language_blocks(samples, monkeypatch):
    """Scores do not depend on how many units are held at once; a text of very many lines needs no matrix of them all."""
    import tracemalloc

    model = language.fit(samples)
    text = "\n".join(t for _, t in samples) + "\n" * 120_000
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    tracemalloc.start()
    whole = model.score(cp, np.array([0]))
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    monkeypatch.setattr(language, "UNITS_AT_ONCE", 7)
    head = cp[:20_000]
    small = model.score(head, np.array([0]))
    monkeypatch.setattr(language, "UNITS_AT_ONCE", 10_000)
    large = model.score(head, np.array([0]))
    assert np.allclose(small["margin"], large["margin"]) and (small["best"] == large["best"]).all() and len(whole["best"]) > 120_000


def test_other_scripts_have_no_language(spark, samples):
    rows = [("document", "1", "Это предложение написано на русском языке."), ("document", "2", "Αυτή η πρόταση είναι γραμμένη στα ελληνικά."), ("document", "3", "이 문장은 한국어로 쓰여 있습니다.")]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, text string")
    assert language.stretches(df, language.fit(samples)).count() == 0


def test_language_table(spark, samples):
    by = {lang: [t for a, t in samples if a == lang] for lang in language.LANGUAGES}
    mixed = by["en"][0] + " " + by["fr"][1] + " " + by["en"][2]
    rows = [
        ("document", "1", mixed), ("document", "2", by["de"][0]), ("document", "3", by["zh"][0] + by["zh"][1]), ("document", "4", None), ("document", "5", ""),
        ("document", "6", "0ce0c93bc7abfa96881474cf2427d63e32742f6a0a7bb989e4cbff3e8aed6249"), ("document", "7", (by["it"][3] + " ") * 300), ("transcript", "8", by["nl"][0]), ("transcript", "8", by["pt"][0]),
    ]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, text string")
    found = language.stretches(df, language.fit(samples))
    cut = sorted((r.char_start, r.char_end, r.lang) for r in found.where("item_id = '1'").collect())
    assert [c[2] for c in cut] == ["en", "fr", "en"] and cut[0][0] == 0 and cut[-1][1] == len(mixed)
    assert all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    langs = {r.item_id: r.langs for r in language.item_languages(found).collect()}
    assert langs == {"1": ["en", "fr"], "2": ["de"], "3": ["zh"], "7": ["it"], "8": ["nl", "pt"]}
    labels = spark.createDataFrame([("document", "1", "EN"), ("document", "2", " de-AT"), ("document", "3", "und"), ("document", "7", None), ("transcript", "8", "pt")], "item_kind string, item_id string, label string")
    wrong = sorted((r.item_id, r.lang) for r in language.wrong_labels(language.item_languages(found), labels).collect())
    assert wrong == [("1", "en"), ("1", "fr"), ("3", "zh"), ("7", "it"), ("8", "nl"), ("8", "pt")]
    assert language.stretches(df.where("false"), language.fit(samples)).count() == 0


def test_labels(spark):
    names = ["en", "EN", " fr ", "de-AT", "spa", "Deutsch", "zh-Hans", "pt_BR", "xx", "", None, "und", "english"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i")
    assert [r[0] for r in df.select(language.label_language(F.col("n"))).collect()] == ["en", "en", "fr", "de", "es", "de", "zh", "pt", None, None, None, None, "en"]


# ---- 5: splitting --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", ["abc  ", "ab.\n\n ", "a", "abcdefghij .", "中文字。", "a  　"])
def test_splitting(alphabet):
    rng = random.Random(2)
    for _ in range(25):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(601, 3500)))
        pieces = splitting.split_text(text)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(0 < e - s <= 600 for s, e, _ in pieces)
        assert all(a[1] - 80 <= b[0] <= a[1] < b[1] for a, b in zip(pieces, pieces[1:], strict=False))


def brute_split(text, max_chars, overlap):
    """The least cost over all sequences of boundaries, by recursion over the definition."""
    cp = splitting.code_points(text)
    pos, kind = (v.tolist() for v in splitting.boundaries(cp, max_chars))
    n = len(text)
    pieces = max(1, -(-(n - overlap) // max(1, max_chars - overlap)))
    even = min(max_chars, (n + (pieces - 1) * overlap) / pieces)
    best = {0: 0.0}
    for e in pos[1:]:
        for p in [q for q in pos if q < e and q in best]:
            start = 0 if p == 0 else min(q for q in pos if q >= p - overlap)
            start = max(start, min(q for q in pos if q >= e - max_chars))
            if start <= p:
                lost = 0.0 if p == 0 else splitting.LOST_OVERLAP * (1 - (p - start) / max(1, overlap))
                cut = 0.0 if e == n else splitting.PENALTY[splitting.KINDS[kind[pos.index(e)]]]
                cost = best[p] + 1 + ((e - start - even) / max_chars) ** 2 + lost + cut
                best[e] = min(best.get(e, np.inf), cost)
    return best[n], even


@pytest.mark.parametrize("dense", [splitting.DENSE, 0])
def test_splitting_is_optimal(monkeypatch, dense):
    monkeypatch.setattr(splitting, "DENSE", dense)
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choice("ab c.\n") for _ in range(rng.randint(41, 160))) + "z" * rng.choice([0, 50])
        want, even = brute_split(text, 40, 8)
        cost, before = 0.0, 0
        for s, e, k in splitting.split_text(text, 40, 8):
            lost = 0.0 if before == 0 else splitting.LOST_OVERLAP * (1 - (before - s) / 8)
            cost += 1 + ((e - s - even) / 40) ** 2 + lost + (0.0 if e == len(text) else splitting.PENALTY[k])
            before = e
        assert abs(cost - want) < 1e-9, text
    assert [(s, e) for s, e, _ in splitting.split_text("a" * 700)] == [(0, 390), (310, 700)]


def test_splitting_prefers_strong_boundaries():
    text = "word " * 60 + "end.\n\n" + "word " * 60 + "stop. " + "word " * 60
    cuts = [(text[:e].rstrip()[-4:], k) for _, e, k in splitting.split_text(text, 400, 40)]
    assert cuts[0] == ("end.", "paragraph")
    assert splitting.split_text("x" * 2000, 600, 0)[0][1] <= 600
    assert splitting.split_text("", 600, 80) == [] and splitting.split_text("a b", 600, 80) == [(0, 3, "paragraph")]


def test_splitting_table(spark):
    body = "😀 intro\n\n" + ("some words here. " * 60) + "\n\n" + "x" * 900
    long, run = body.index("some"), body.index("xxx")
    chunk = body[long : run - 2]
    rows = [
        (1, 0, chunk, long, 10**6), (1, 0, None, long, run - 2), (1, 1, None, run, len(body)), (1, 2, chunk, None, None), (1, 3, "short", 0, 5), (2, 0, chunk, 0, 9),
        (None, 0, chunk, 0, 9), (1, 4, None, None, None), (1, 5, chunk, 3, 7),
    ]
    chunks = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, chunk_id int, text string, char_start int, char_end int, piece string")
    documents = spark.createDataFrame([(1, body, "c")], "doc_id bigint, text string, chunk_id string")
    pieces = splitting.split_chunks(chunks, documents).collect()
    assert {(r.doc_id, r.chunk_id): r.forced for r in pieces} == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0, (1, 5): 0}
    for r in pieces:
        assert len(r.text) <= 600
        if r.doc_id == 1:
            assert body[r.char_start : r.char_end] == r.text
        else:
            assert r.char_start is None
    assert splitting.split_chunks(chunks.where("false"), documents).count() == 0
    good = splitting.coverage(splitting.split_chunks(chunks.where("doc_id = 1"), documents), documents).collect()
    assert all((r.too_long, r.gaps, r.wide_overlaps, r.wrong_texts) == (0, 0, 0, 0) for r in good) and len(good) == 4
    twice = spark.createDataFrame([(7, "q" + chunk + "--" + chunk)], "doc_id bigint, text string")
    equal = spark.createDataFrame([(7, 0, chunk, None, None), (7, 1, chunk, None, None), (7, 2, chunk, None, None)], "doc_id bigint, chunk_id int, text string, char_start int, char_end int")
    starts = {r.chunk_id: r.char_start for r in splitting.split_chunks(equal, twice).collect() if r.piece == 0}
    assert starts == {0: 1, 1: len(chunk) + 3, 2: 1}


# ---- 6: packing ----------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 5, 30, 70, 99, 100, 101, 250]), rng.choice(["a", "b ", "B", None])) for i in range(300)]
    rows += [(1000 + i, "same text here", "a") for i in range(40)] + [(2000, None, "a"), (2001, "", None), (None, "x", "a")]
    df = docs(spark, rows)
    out = packing.pack(df, capacity=100, rows_per_shard=120).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: (s or "?").strip().lower() for i, _, s in rows}
    bins: dict = {}
    total: dict = {}
    for r in out:
        bins.setdefault(r.container_id, []).append(r)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.doc_id is None or r.doc_id >= 0
        assert r.is_split == (size.get(r.doc_id, 1) > 100)
    assert all(total[i] == size[i] for i in size if i is not None)
    for members in bins.values():
        assert sum(m.n_tokens for m in members) <= 100
        ids = [m.doc_id for m in members]
        assert sum(1 for i in ids if i is not None and 1000 <= i < 1040) <= 1
        assert len({source.get(i, "a") == "?" for i in ids}) == 1
    assert packing.pack(df.where("false")).count() == 0
    report = packing.fill_report(packing.pack(docs(spark, [(i, "w " * (10 + i % 50), "a") for i in range(2000)]), capacity=100), 100).first()
    assert report.fill > 0.95
    apart = packing.pack(docs(spark, [(1, "x", "a"), (2, "x y", "b"), (3, "z", "c")]), apart={"a": ["b"]}).collect()
    assert len({r.container_id for r in apart if r.doc_id in (1, 2)}) == 2


def test_best_fit_is_tightest():
    assert packing.best_fit([(6, 1, 0, 0), (5, 1, 0, 0), (5, 1, 0, 0), (4, 1, 0, 0)], 10, {}) == [0, 1, 1, 0]


# ---- 7: mixing -----------------------------------------------------------------------------------------------------


def test_permutation():
    for n in (1, 2, 3, 7, 100, 1000):
        i = np.arange(n)
        for key in (1, 99):
            assert sorted(mixing.permute(i, np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_quotas():
    quotas = mixing.plan_quotas([("a", 0.5, 1, 1000), ("b", 0.5, 2, 100), ("c", 0.0, 5, 100), ("d", 0.0, 1, 0)], 10)
    by = {q.source: q for q in quotas}
    assert by["b"].short and by["b"].slots == 20 and not by["a"].short and by["a"].slots == 100


@pytest.mark.parametrize("scale", [1, 10**12])
def test_draws(scale):
    """Totals are exact, slots follow each other, any task draws the same, counts look multinomial; at any size."""
    slots, shards = np.array([5000, 300, 0, 7]) * scale, 16
    drawn = list(mixing.draw_shards(slots, shards, 0, shards, 3))
    assert [d[0] for d in drawn] == list(range(shards))
    at = np.zeros(4, dtype=np.int64)
    for _, first, n in drawn:
        assert (first == at).all() and (n >= 0).all()
        at += n
    assert (at == slots).all()
    for begin in range(0, shards, 5):
        again = list(mixing.draw_shards(slots, shards, begin, min(shards, begin + 5), 3))
        assert all(x[0] == y[0] and (x[1] == y[1]).all() and (x[2] == y[2]).all() for x, y in zip(again, drawn[begin:], strict=False))
    counts = np.array([[n for _, _, n in mixing.draw_shards(np.array([1600]), shards, 0, shards, seed)] for seed in range(200)])[:, :, 0]
    assert abs(counts.mean() - 100) < 1 and 80 < counts.var() < 110  # binomial: 1600 / 16 * 15 / 16
    assert list(mixing.draw_shards(np.array([0]), 0, 0, 0, 1)) == []


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    targets = spark.createDataFrame([(s, 0.3, 1) for s in "abc"], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError, match="more than 2"):
        mixing.mix(docs(spark, [(1, "w", "a")]), targets)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["A", " a", "b", "c", None, "other"])) for i in range(400)] + [(900, None, "a"), (901, "", "b"), (None, "x", "a")]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 3), ("none", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs(spark, rows), targets, block=16, slots_per_shard=32)
    got = mixed.collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    uses: dict = {}
    for r in got:
        for k in range(r.token_from, r.token_to):
            uses[r.doc_id, k] = uses.get((r.doc_id, k), 0) + 1
        assert r.token_to <= size[r.doc_id]
    cap = {"a": 1, "b": 2, "c": 3}
    source = {i: (s or "").strip().lower() for i, _, s in rows}
    assert all(n <= cap[source[i]] for (i, _), n in uses.items())
    for r in report.collect():
        tokens = sum(size[i] for i in size if i is not None and source[i] == r.source)
        total = sum(size[i] for i in size if i is not None and source[i] in cap)
        assert r.tokens == tokens and r.short == (r.max_repeats * tokens < r.target_share * total)
        assert r.mixed_tokens == sum(g.token_to - g.token_from for g in got if g.source == r.source)
    assert mixing.mix(docs(spark, rows).where("false"), targets)[0].count() == 0


# ---- 8: shared spans -----------------------------------------------------------------------------------------------


def test_window_hashes():
    cp = np.frombuffer("abcabcabd".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = spans.window_hashes(cp, 3)
    assert len(h) == 7 and h[0] == h[3] and len({*h.tolist()}) == 4
    assert spans.sliding_min(np.array([5, 3, 9, 1, 7], dtype=np.uint64), 3).tolist() == [3, 1, 1]


@pytest.mark.parametrize(("filter_bytes", "shared_bytes", "hot"), [(spans.MAX_FILTER_BYTES, spans.MAX_FILTER_BYTES, spans.HOT_PLACES), (0, spans.MAX_FILTER_BYTES, 3), (0, 0, spans.HOT_PLACES)])
def test_shared_spans_against_brute_force(spark, monkeypatch, filter_bytes, shared_bytes, hot):
    monkeypatch.setattr(spans, "HOT_PLACES", hot)
    monkeypatch.setattr(spans, "MAX_FILTER_BYTES", shared_bytes)  # of the shared hashes, beyond the bound of the index
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ijk 中é😀") for _ in range(n))
    pool = [noise(rng.randint(40, 130)) for _ in range(8)] + ["ab" * 60, "x" * 150, "x" * 40 + noise(40), noise(20) + "y" * 80 + noise(10)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += noise(rng.randint(0, 40))
            if rng.random() < 0.5:
                p, a = rng.choice(pool), rng.randint(0, 20)
                text += p[a : len(p) - rng.randint(0, 20)]
        rows.append((i, text, "s"))
    rows += [(100, rows[0][1] + "z" * 60, "s"), (101, rows[0][1] + "z" * 60, "s"), (102, None, "s"), (103, "", "s"), (104, "x" * 59, "s"), (105, "q" + "x" * 300 + "z", "s"), (None, rows[1][1], "s"), rows[3]]
    least, where = 60, {}
    for i, t, _ in rows:
        for j in range(len(t or "") - least + 1 if i is not None else 0):
            where.setdefault(t[j : j + least], set()).add(i)
    want = {(a, b) for s in where.values() for a in s for b in s if a < b}
    df = docs(spark, rows).repartition(3)
    got = {(r[0], r[1]) for r in spans.shared_pairs(df, least, filter_bytes).collect()}
    assert got == want and len(want) > 20
    text = {i: t for i, t, _ in rows}
    for r in spans.shared_stretches(df, least, filter_bytes).collect():
        one = text[r.doc_id_a][r.start_a : r.start_a + r.length]
        assert one == text[r.doc_id_b][r.start_b : r.start_b + r.length] and r.length >= least
        before, after = (r.start_a - 1, r.start_b - 1), (r.start_a + r.length, r.start_b + r.length)
        for i, j in (before, after) if "xx" not in one and "yy" not in one and "abab" not in one else ():
            a, b = text[r.doc_id_a][max(i, 0) : i + 1], text[r.doc_id_b][max(j, 0) : j + 1]
            assert not a or not b or a != b
    covered: dict = {}
    for i, t, _ in (r for r in rows if r[0] is not None):
        n = len(t or "")
        hit = [any(o != i for o in where[t[j : j + least]]) for j in range(n - least + 1)] if n >= least else []
        covered[i] = sum(any(hit[max(0, k - least + 1) : k + 1]) for k in range(n))
    report = {r.doc_id: r.shared_chars for r in spans.shared_report(df, least, filter_bytes).collect()}
    assert {i: c for i, c in covered.items() if c} == report
    if filter_bytes:
        assert spans.shared_pairs(df.where("false"), least).count() == 0


@pytest.mark.parametrize("filter_bytes", [spans.MAX_FILTER_BYTES, 0])
@pytest.mark.parametrize("least", [40, 61])
def test_stretches_in_periodic_text_against_brute_force(spark, filter_bytes, least):
    rng = random.Random(least)
    noise = lambda n: "".join(rng.choice("abcdefgh ijk 中é😀") for _ in range(n))
    shared, unit, long_unit = [noise(20) for _ in range(4)], noise(7), noise(25)
    texts = [
        shared[0] + "x" * 400 + shared[1],
        noise(9) + shared[0] + "x" * 400 + shared[1] + noise(5),
        noise(11) + "x" * 150 + noise(30),
        noise(13) + unit * 40 + noise(4),
        noise(30) + unit * 25 + noise(8) + "x" * 90,
        shared[2] + long_unit * 12 + shared[3],
        noise(17) + long_unit * 9 + shared[3],
        noise(3) + "|".join(noise(2) + "-" * 50 for _ in range(3)),
        "-" * 130,
        "é" * 90 + noise(2) + "x" * 90,
    ]
    texts.append(texts[0])

    def repeats(a, b):
        for d in range(-len(a), len(b)):
            i, stop = max(0, -d), min(len(a), len(b) - d)
            while i < stop:
                j = i
                while j < stop and a[j] == b[j + d]:
                    j += 1
                if j - i >= least:
                    yield i, i + d, j - i
                i = max(j, i + 1)

    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = {(p, q, *r) for a, p in first.items() for b, q in first.items() if p < q for r in repeats(a, b)}
    got = [tuple(r) for r in spans.shared_stretches(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3), least, filter_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(r[4] for r in got) == 440
