"""Conversations, look-alikes, leaks, mixture and encodings."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tracemill.llm import conversations, encoding, leakage, lookalike, mixture


def test_kahn_orders_and_sees_cycles():
    assert conversations.kahn(["c", "a", "b"], [["a"], [], ["a"]], [(1,), (0,), (0,)]) == [1, 2, 0]
    assert conversations.kahn(["a", "b"], [["b"], ["a"]], [(0,), (1,)]) is None
    assert conversations.kahn(["a", "a"], [[], []], [(0,), (1,)]) is None
    assert conversations.kahn(["a"], [["gone"]], [(0,)]) is None


def test_whole_debates(spark):
    prov = "record_no long, text string, provenance struct<execution_id: string, agent_id: string, round: int, channel: string, doc_id: string, extra: map<string, string>>, logged_at string, role string"
    row = lambda no, e, a, r, t="said", c="output": (no, t, (e, a, r, c, None, None), f"2025-01-{no % 27 + 1:02d}", "x")
    rows = [row(4, "ok", "A", 1), row(3, "ok", "B", 1), row(2, "ok", "A", 2), row(1, "ok", "B", 2), row(1, "ok", "B", 2), row(9, "ok", None, 0, c="source")]
    rows += [row(10, "late", "A", 1), row(11, "late", "A", 3)]  # a round outside
    rows += [row(20, "blank", "A", 1, "​ ﻿\n")]
    rows += [row(30, "twice", "A", 1), row(31, "twice", "A", 1)]
    rows += [row(40, "stranger", "A", 1), row(41, "stranger", "Q", 1)]
    rows += [row(50, "nobody", "A", 1), row(51, "nobody", None, None)]
    rows += [row(60, "no-row", "A", 1), row(61, None, "A", 1)]
    t = spark.createDataFrame(rows, prov)
    d = [("ok", 2, {"A": "judge", "B": "critic"}), ("ok", 2, {"A": "judge", "B": "critic"}), ("late", 2, {"A": "x"}), ("blank", 1, {"A": "x"}), ("twice", 2, {"A": "x"}), ("stranger", 1, {"A": "x", "B": "y"}), ("nobody", 2, {"A": "x"}), (None, 1, {"A": "x"}), ("empty", 0, {}), ("nulls", None, None)]
    d = spark.createDataFrame([(*x, "2025", 1) for x in d], "execution_id string, rounds int, roles map<string, string>, started_at string, record_no int")
    got = [tuple(r) for r in conversations.whole_debates(t, d).orderBy("execution_id", "turn_no").collect()]
    assert got == [("ok", 1, 4, "A", "judge"), ("ok", 2, 3, "B", "critic"), ("ok", 3, 2, "A", "judge"), ("ok", 4, 1, "B", "critic")]
    assert conversations.whole_debates(t.limit(0), d).count() == conversations.whole_debates(t, d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def unifier():
    return lookalike.Unifier(lookalike.Tables())


@pytest.mark.parametrize("a, b", [("ｆｕｌｌ １２", "full 12"), ("ﬁne ﬂow", "fine flow"), ("café", "café"), ("á̧", "á̧"), ("no break", "no break"), ("ze​ro­", "zero"), ("сорy", "copy"), ("Οslo", "Oslo"), ("ё", "ë"), ("Å", "Å"), ("ﾊﾞ", "バ")])
def test_same_look_same_form(unifier, a, b):
    assert unifier([a])[0] == unifier([b])[0]


@pytest.mark.parametrize("a, b", [("case", "Case"), ("β", "γ"), ("x²", "x2"), ("a b", "ab"), ("ñ", "n"), ("é", "è")])
def test_other_look_other_form(unifier, a, b):
    assert unifier([a])[0] != unifier([b])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), max_size=12), max_size=5))
def test_form_is_stable_and_ignores_normalisation(texts):
    one = UNIFIER[0] if UNIFIER else UNIFIER.append(lookalike.Unifier(lookalike.Tables())) or UNIFIER[0]
    forms = one(texts)
    assert one(forms) == forms
    assert one([unicodedata.normalize("NFC", t) for t in texts]) == one([unicodedata.normalize("NFD", t) for t in texts]) == forms


UNIFIER: list = []


def test_same_looking_pairs(spark):
    rows = [(1, "café au lait"), (2, "café au lait"), (3, "café au lait"), (4, "café au lait"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "tea"), (2, "café au lait"), (None, "café au lait"), (10, "é" * 200_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "ord long, quote string, form int")
    assert {tuple(r) for r in lookalike.same_looking_pairs(df, "ord", "quote").collect()} == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert lookalike.same_looking_pairs(df.limit(0), "ord", "quote").count() == 0
    assert lookalike.unify(df, "quote", "one").where("ord = 3").first().one == "café au lait"
    with pytest.raises(ValueError):
        lookalike.unify(df, "quote", "form")


def _sentences(rng, n):
    return [" ".join(rng.choices([f"word{i}" for i in range(400)], k=12)) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"item{i}x{rng.randrange(40)}" if rng.random() < 0.4 else rng.choice(["the", "of", f"word{rng.randrange(400)}"]) for _ in range(60)), "B") for i in range(12)]
    docs = [(i, " ".join(_sentences(rng, 12))) for i in range(80)]
    want = set()
    for d in range(20):
        i = rng.randrange(12)
        w = items[i][1].split()
        s = rng.randrange(len(w) - 20)
        n = 13 if d % 2 else 12
        text = docs[d][1].split()
        at = rng.randrange(len(text))
        docs[d] = (d, " ".join(text[:at] + ["~".join(w[s : s + n]).upper() if d % 3 else " ".join(w[s : s + n])] + text[at:]))
        if n == 13:
            want.add((d, i))
    docs += [(100, None), (101, ""), (102, "short"), (None, items[0][1]), (103, " ".join(_sentences(rng, 3000)) + " " + items[3][1])]
    want.add((103, 3))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    ev = spark.createDataFrame([(*i, 1) for i in items] + [(*items[0], 1), (50, None, None, 1), (51, "few words", None, 1)], "item_id long, text string, answer string, doc_id int")
    got = leakage.leaks(df, ev)
    assert {(r.doc_id, r.item_id) for r in got.collect() if r.exact} == want
    assert leakage.leaks(df.limit(0), ev).count() == leakage.leaks(df, ev.limit(0)).count() == 0
    assert leakage.common_in_order(list("abcbdab"), list("bdcaba")) == 4


@pytest.mark.parametrize("n", [1, 1000, 4000])
def test_leaks_beside_rare_words(spark, n):
    """Every run of 13 common words is found, whatever stands beside it and however many documents there are."""
    rng = random.Random(9)
    common = [f"common{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(common) for _ in range(30)), None) for i in range(5)]
    rare = iter(range(10**6))
    beside = lambda k: [f"rare{next(rare)}" for _ in range(k)]
    docs = [" ".join(w for i, t, _ in items for s in range(18) for w in [*beside(13), *t.split()[s : s + 13], *beside(13)])] if n == 1 else [" ".join([*beside(13), *t.split()[s : s + 13], *beside(13)]) for _, t, _ in items for s in range(18)]
    want = {(0, i) for i in range(5)} if n == 1 else {(d, d // 18) for d in range(90)}
    docs += [" ".join(rng.sample(common, 12)) for _ in range(n - len(docs))]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    ev = spark.createDataFrame(items, "item_id long, text string, answer string")
    for paraphrases in (False, True):
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, ev, paraphrases=paraphrases).collect() if r.exact} == want


def test_leaks_of_few_and_of_frequent_words(spark):
    """Planted runs in a language of 60 words, and of items that are mostly function words, among rare filler."""
    rng = random.Random(12)
    few = [f"v{k}" for k in range(60)]
    item = " ".join(rng.choice(few) for _ in range(40))
    docs = [" ".join(rng.choice(few) for _ in range(60)) for _ in range(400)]
    for d in range(40):
        s = rng.randrange(28)
        docs[d] += " " + " ".join(item.split()[s : s + 13]) + " " + rng.choice(few)
    ev = spark.createDataFrame([(1, item, None)], "item_id long, text string, answer string")
    got = leakage.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), ev, paraphrases=False)
    assert {r.doc_id for r in got.where("exact").collect()} == set(range(40))

    words = ["the", "of", "and", "to", "in", "that"]
    item = " ".join(rng.choice(words) if rng.random() < 0.6 else f"name{k}" for k in range(60))
    docs = [" ".join(rng.choice(words) if rng.random() < 0.5 else f"rare{d}x{k}" for k in range(80)) for d in range(300)]
    for d in range(40):
        s = rng.randrange(48)
        docs[d] += " " + " ".join(item.split()[s : s + 13]) + f" rare{d}"
    ev = spark.createDataFrame([(1, item, None)], "item_id long, text string, answer string")
    got = leakage.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), ev, paraphrases=False)
    assert {r.doc_id for r in got.where("exact").collect()} == set(range(40))


def test_recall_of_paraphrases(spark):
    """Passages with words replaced, dropped and put in, so that no 13 words stand together; at least nine of ten are found."""
    rng = random.Random(15)
    vocabulary = [f"word{k}" for k in range(3000)]
    function = ["the", "of", "and", "to", "in", "is"]
    sentence = lambda n: [rng.choice(function) if rng.random() < 0.45 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, sentence(52)) for i in range(20)]
    docs, want = [" ".join(sentence(150)) for _ in range(300)], set()
    for d in range(100):
        i, words = items[d % 20]
        said = []
        for k, w in enumerate(words):
            change = rng.random() if k % 6 == 3 or rng.random() < 0.08 else 1
            said += [] if change < 0.2 else [rng.choice(vocabulary)] if change < 0.8 else [w, rng.choice(function)] if change < 1 else [w]
        docs[d] = " ".join([*sentence(40), *said, *sentence(40)])
        want.add((d, i))
    ev = spark.createDataFrame([(i, " ".join(w), None) for i, w in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id): r.exact for r in leakage.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), ev).collect()}
    found = len(want & got.keys())
    print("paraphrases found", found, "of", len(want), "others", len(got.keys() - want))
    assert found >= 90 and not any(got.values()) and len(got.keys() - want) <= 5


def test_p7_found_searches_passages_too(spark, tmp_path, monkeypatch):
    """The query goes through the passages' cosine and their check as well, and gives the exact leaks only."""
    from tracemill.llm import queries

    rng = random.Random(21)
    items = [(i, " ".join(_sentences(rng, 4)), None) for i in range(4)]
    docs = [(d, " ".join(_sentences(rng, 6))) for d in range(40)]
    docs[7] = (7, docs[7][1] + " " + " ".join(items[2][1].split()[5:18]))
    docs[8] = (8, " ".join(w for k, w in enumerate(items[1][1].split()) if k % 6 != 3))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, answer string").write.parquet(f"{tmp_path}/eval_items.parquet")
    asked, search = [], leakage.search
    monkeypatch.setattr(leakage, "search", lambda *a: asked.append(a[-1]) or search(*a))
    assert [tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect()] == [(7, 2)]
    assert asked == [True]
    assert {(r.doc_id, r.item_id, r.exact) for r in queries.p7_leaks(spark, str(tmp_path)).collect()} == {(7, 2, True), (8, 1, False)}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.integers(3, 60))
def test_flight_keeps_totals(seed, n):
    rng = np.random.default_rng(seed)
    sizes, chance = rng.integers(1, 500, n), np.full(n, rng.uniform(0.05, 0.95))
    moved = mixture.flight(sizes, chance, rng)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert abs(moved.sum() - chance.sum()) < 1e-6 and abs((moved * sizes).sum() - (chance * sizes).sum()) < 1e-4
    assert set(mixture.landing(sizes, moved)) <= {0.0, 1.0}


def test_mixture_shares(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(_sentences(rng, rng.randrange(1, 6))), rng.choice(["a-b", " A_b", "c", "c", "c", None, "other"])) for i in range(900)]
    df = spark.createDataFrame([(*d, 1) for d in docs] + [(2000, None, "c", 1), (2001, " ", "c", 1), (None, "text", "c", 1)], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a_b", 0.5, 3), ("C", 0.3, 2), ("absent", 0.2, 5), ("off", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mixture.mixture(df, targets)
    got = {r.source: r for r in shares.collect()}
    assert abs(got["a_b"].actual_share - 0.625) < 0.002 and abs(got["c"].actual_share - 0.375) < 0.002
    assert got["absent"].actual_share == 0 and got["absent"].documents == 0
    most = {r.source: r.m for r in drawn.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert most["a_b"] <= 3 and most["c"] <= 2
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    drawn, shares = mixture.mixture(df.limit(0), targets)
    assert drawn.count() == 0 and shares.count() == 4


GOOD = ["Größere Zweifel äußert C an der Zahl, weil jüngere Mieter müssen.", "Le relevé «Iskgladre» de 2021 signale 67,4 cas, à vérifier dès que possible.", "¿Quién midió el daño al cañón? Nadie lo aclaró, así que C cambió de opinión.", "Żaden świadek nie potwierdził, że prędkość wzrosła właśnie tak.", "После второго раунда стало ясно: урожайность почти не изменилась."]


def test_encoding_restores(spark):
    langs = ["de", "fr", "es", "pl", "ru"]
    clean = [(100 + i, GOOD[i % 5], langs[i % 5]) for i in range(200)]
    bad = [(i, g.encode("utf-8").decode(e, "replace"), langs[i]) for i, (g, e) in enumerate(zip(GOOD, ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251"))) if "�" not in g.encode("utf-8").decode(e, "replace")]
    bad.append((50, GOOD[0].encode().decode("cp1252", "replace").encode().decode("cp1252", "replace").replace("�", ""), None))
    lost = [(60, "�aden �wiadek nie potwierdzi�", "pl")]
    fine = [(70, "plain ASCII", "en"), (71, None, None), (72, "", "en"), (73, "The sign “Ã” is a vowel; it cost €9, √2 ± 0.4 at 21 °C, m³.", "en"), (74, "ascii " * 100_000 + "é", "en")]
    df = spark.createDataFrame([(*r, 1) for r in clean + bad + lost + fine], "doc_id long, text string, lang string, key int")
    got = {r.key: r for r in encoding.restored(df).collect()}
    assert set(got) == {r[0] for r in bad + lost}
    assert all(got[i].restored == GOOD[i] for i, *_ in bad if i < 5)
    assert got[60].restored is None
    assert encoding.restored(df.limit(0)).count() == 0


def test_encodings_are_fitted_on_every_text(spark):
    rows = [(i, f"Der Zeuge {i} prüfte die Höhe.", "de") for i in range(400)] + [(i, f"Der Zeuge {i} fand ein Maß.", "de") for i in range(400, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    dictionaries, known = encoding.fit(df)
    assert known[encoding.LANGUAGES.index("de")] >= {"rü", "üf", "Hö", "öh", "aß"} and not known[0]
    assert encoding.fit(df.repartition(7)) == (dictionaries, known)
    small, same = encoding.fit(df, part=50, fan_in=2)
    assert same == known and len(small) == len(dictionaries) == 1


TRAIN = {
    "de": ["Die Prüfung der Anträge dauert länger als üblich.", "Über die Höhe der Gebühren entscheidet später der Ausschuss.", "Für größere Städte gelten übliche Fristen, für Dörfer kürzere.", "Der Bürgermeister möchte die Straße früher öffnen."],
    "fr": ["Le comité a relevé plusieurs écarts après l'été.", "La qualité du café a été contrôlée à l'arrivée.", "Les élèves répètent la leçon près de la fenêtre.", "Un témoin a déclaré que le marché était fermé."],
    "es": ["La sesión terminó después de la votación.", "El año pasado también se aplazó la reunión.", "Según el informe, la situación cambió rápidamente.", "Los niños están en la montaña con su compañía."],
    "ru": ["Комиссия проверила отчёт и отложила решение.", "Город закрыл мост на время ремонта.", "Свидетель не подтвердил время встречи.", "После обсуждения текст изменили."],
}
HELD_OUT = {
    "de": "Später prüfte der Ausschuss die Höhe der Straße.", "fr": "Après la leçon, un élève a relevé la qualité du marché.",
    "es": "Según la compañía, la votación terminó el año pasado.", "ru": "Город отложил решение после встречи.",
}


@pytest.fixture(scope="module")
def detector():
    from collections import Counter

    import zstandard

    dictionaries, known = [], []
    for texts in TRAIN.values():
        counts = Counter(p for t in texts * 2 for s in encoding.STRETCH.findall(t) for p in set(encoding.pairs_of(s)))
        known.append({p for p, n in counts.items() if n >= 2})
        dictionaries.append(zstandard.train_dictionary(4000, [t.encode() for t in texts * 40]).as_bytes())
    return encoding.Detector(dictionaries, known)


@pytest.mark.parametrize("lang, wrong", [(lang, w) for lang in HELD_OUT for w in ("cp1252", "cp1250", "mac_roman", "cp437", "cp850")])
def test_utf8_read_wrongly_in_sentences_not_fitted(detector, lang, wrong):
    text = HELD_OUT[lang]
    try:
        shown = text.encode().decode(wrong)
    except UnicodeDecodeError:
        return
    assert detector.decide(shown)[:2] == (True, text)


@pytest.mark.parametrize("text", ["Le café est ouvert.", "Le relevé signale un cas de plus."])
@pytest.mark.parametrize("wrong", ["cp1251", "cp1253", "koi8_r", "cp850"])
def test_one_wrong_letter_at_the_end_of_a_word(detector, text, wrong):
    assert detector.decide(text.encode("cp1252").decode(wrong))[:2] == (True, text)


def test_sentences_as_they_should_be_stand(detector):
    fine = [*HELD_OUT.values(), "Le café est ouvert.", "It cost €9; √2 times ± 0.4 at 21 °C, 14 m³ per hour; see notes ¹ and ²."]
    assert not [t for t in fine if detector.decide(t)[0]]
