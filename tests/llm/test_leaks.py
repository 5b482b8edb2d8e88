from __future__ import annotations

import random

import numpy as np

from credograph.llm import leaks

random.seed(7)
NOUNS = [f"{a}{b}" for a in ("bor", "cal", "dim", "fen", "gor", "hul", "jam", "kel", "lor", "mub") for b in ("atic", "esse", "ipon", "orum", "ulet", "anker", "estol", "ivar")]
ITEMS = [(i, " ".join(random.choice(NOUNS) if k % 3 else random.choice(["the", "of", "and", "near"]) for k in range(60)) + f" {random.randrange(1000)}.") for i in range(40)]
FILLER = " ".join(random.choice(["patients", "the", "study", "of", "and", "was", "dose", "near", "with"]) for _ in range(120))


def garble(ws):
    ws = [w.upper() if i % 2 else w for i, w in enumerate(ws)]
    ws[4], ws[11] = "other", ws[11][:3] + "x" + ws[11][3:]
    return ws


DOCS = {
    1: FILLER + " " + ITEMS[3][1] + " " + FILLER,
    2: FILLER + " " + " ".join(garble(ITEMS[5][1].split()[20:44])) + " " + FILLER,
    3: "<p>" + "</b> <i>".join(ITEMS[7][1].split()[5:30]) + "</p>",
    4: FILLER + " " + " ".join(ITEMS[9][1].split()[:9]) + " " + FILLER,
    5: FILLER,
    6: " ".join(ITEMS[11][1].split()[10:34]).replace(" ", ",\n> ") + "\n" + ITEMS[12][1],
    7: "",
    8: (FILLER + " ") * 200 + ITEMS[2][1],
}
WANT = {(1, 3), (2, 5), (3, 7), (6, 11), (6, 12), (8, 2)}


def test_found(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS.items()] + [(9, None, "x"), (None, ITEMS[0][1], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(i, t) for i, t in ITEMS] + [(90, None), (91, " "), (None, "x")], "item_id long, item_text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find(docs, items).collect()} == WANT
    assert leaks.find(docs.limit(0), items).count() == 0
    assert leaks.find(docs, items.limit(0)).count() == 0
    scores = lambda df: {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in df.collect()}
    assert scores(leaks.find(docs, items, range_items=9)) == scores(leaks.find(docs, items)) == scores(leaks.find(docs, items, range_bytes=6000))


def test_wand_finds_all_above_the_threshold():
    """Against the scores of every item, computed one by one."""
    df = {w: 3 for _, t in ITEMS for w in leaks.words(t)}
    index = leaks.Index(ITEMS, df, 1000)
    for k in range(200):
        words = set(random.sample(NOUNS, random.randrange(1, 30))) | set(random.choice(ITEMS)[1].split()[: random.randrange(30)])
        scores = [sum(index.weights[w][index.items[w].index(i)] for w in words if w in index.items and i in index.items[w]) for i in range(len(ITEMS))]
        assert sorted(index.search(words)) == [i for i, s in enumerate(scores) if s >= index.need[i] and s > 0], k


def test_alignment():
    item = [f"w{i}" for i in range(40)]
    assert leaks.aligned(item[5:30], item) == (25.0, 25)
    assert leaks.aligned(item[5:15] + ["zz"] + item[16:30], item) == (23.0, 24)
    assert leaks.aligned(["q"] * 10, item) == (0.0, 0)
    assert leaks.near("receptor", "recetpor") and leaks.near("dose", "doze") and not leaks.near("123", "124") and not leaks.near("cat", "cut")


def test_words():
    assert leaks.words("The <b>inflam-\nmation</b> wasn’t &amp; Café 1:20") == ["the", "inflammation", "wasnt", "and", "cafe", "1", "20"]


def case(k: int) -> str:
    """Three set phrases about case k; facts repeat among the cases, as in the test items."""
    r = random.Random(k)
    n, of = lambda: r.randrange(900), lambda *xs: r.choice(xs)
    towns, jobs = ("arlby", "corvale", "varnes", "talmouth", "ormville", "pellham"), ("farmer", "clerk", "welder", "baker", "tailor")
    tests, signs = ("ferritin", "lactate", "sodium", "troponin", "albumin"), ("tremor", "jaundice", "itching", "dizziness", "palpitations")
    return (
        f"A {of('pale', 'restless', 'anxious')} {20 + n() % 50}-year-old {of(*jobs)} from {of(*towns)} noticed {of(*signs)} {n() % 40} days after {of('selling', 'restoring', 'moving')} a {of('colleague', 'neighbour', 'twin')}'s {of('kiln', 'beehive', 'aquarium')}. "
        f"Imaging in {of(*towns)} found a {of(*tests)} of {n()} beside signs of {of('apoptosis', 'fibrosis', 'angiogenesis')} and {of(*signs)} returned within {n() % 90} hours. "
        f"Stopping {of('selling', 'restoring', 'moving')} the {of('kiln', 'beehive', 'aquarium')} in {of(*towns)} changed a {of(*tests)} of {n()} to a {of(*tests)} of {n()} by visit {n() % 20}."
    )


CASES = [(k, case(k)) for k in range(200)]


def search(items, text):
    df = {w: 5 for _, t in items for w in leaks.words(t)}
    return {i for i, _, _ in leaks.leaked(leaks.Index(items, df, 1000), text)}


def test_thinly_altered_run_is_found_but_no_similar_case():
    for k in range(0, 40):
        ws = leaks.words(CASES[k][1])[:36]
        for at in (4, 11, 17, 25):  # the age's neighbour, and facts of either phrase
            ws[at] = "given"
        assert search(CASES, f"{FILLER} {' '.join(ws)} {FILLER}") == {k}
        assert search(CASES, f"{FILLER} {case(1000 + k)} {FILLER}") == set()


def test_item_given_three_times():
    items = ITEMS + [(i, ITEMS[3][1]) for i in (103, 203)]
    assert search(items, DOCS[1]) == {3, 103, 203}


def test_every_passage_that_can_score_is_a_query(monkeypatch):
    """A passage without a single word pair of an item is searched too: gates on pairs would skip it."""
    asked = []
    search = leaks.Index.search_passages
    monkeypatch.setattr(leaks.Index, "search_passages", lambda self, passage, term: asked.append(term) or search(self, passage, term))
    index = leaks.Index(ITEMS, {w: 3 for _, t in ITEMS for w in leaks.words(t)}, 1000)
    nouns = sorted({w for w in leaks.words(ITEMS[4][1]) if w in NOUNS})
    assert leaks.leaked(index, " zz ".join(nouns[:20])) == []
    assert asked and index.ids.index(4) in search(index, np.zeros(len(asked[0]), int), asked[0])[1]


def test_passages_searched_together_are_searched_one_by_one():
    """Texts of all lengths around a passage, in one pass and each alone."""
    df = {w: 5 for _, t in CASES for w in leaks.words(t)}
    index = leaks.Index(CASES, df, 1000)
    texts = [" ".join((CASES[k][1] + " " + FILLER + " " + CASES[k + 1][1]).split()[: 3 * k]) for k in range(70)] + ["", "zz"]
    assert leaks.leaked_all(index, texts) == [leaks.leaked(index, t) for t in texts]
    for text in texts[::7]:
        ws = leaks.words(text)
        want = {(k, i) for k, at in enumerate(range(0, max(1, len(ws) - leaks.STEP), leaks.STEP)) for i in index.search(set(ws[at : at + leaks.PASSAGE]))}
        keys = sorted({(k, index.term[w]) for k, at in enumerate(range(0, max(1, len(ws) - leaks.STEP), leaks.STEP)) for w in ws[at : at + leaks.PASSAGE] if w in index.term})
        hit = index.search_passages(np.array([k for k, _ in keys], int), np.array([t for _, t in keys], int))
        assert set(zip(hit[0].tolist(), hit[1].tolist())) == want


def test_alignments_of_many_are_those_of_one():
    index = leaks.Index(CASES, {}, 1000)
    found = [(k, leaks.words(CASES[k + 1][1])[: 20 + k] + leaks.words(CASES[k][1])[5 : 10 + k]) for k in range(40)]
    for (i, text), got, score in zip(found, index.alignments(found), index.scores(found)):
        best, matched, evidence = leaks.alignment(text, index.words[i], {w: set(index.like(i, w)) for w in set(text)}, index.worth[i])
        assert got[:2] == (best, matched) and score == best and abs(got[2] - evidence) < 1e-9


def test_markup():
    assert leaks.words("p < 0.05 and n > 30 <meta name='x' content='" + "a " * 3000 + "'> end") == ["p", "0", "05", "and", "n", "30", "end"]


def test_threshold_of_a_passage():
    """Runs of which five words of twenty are altered reach the threshold, or all but."""
    index = leaks.Index(CASES, {w: 5 for _, t in CASES for w in leaks.words(t)}, 1000)
    for i, ws in enumerate(index.words):
        own = {w: index.weights[w][index.items[w].index(i)] for w in set(ws)}
        for k in range(len(ws) - leaks.RUN + 1):
            altered = random.Random(k).sample(range(leaks.RUN), 5)
            kept = {w for n, w in enumerate(ws[k : k + leaks.RUN]) if n not in altered}
            assert sum(own[w] for w in kept) >= 0.95 * index.need[i]
