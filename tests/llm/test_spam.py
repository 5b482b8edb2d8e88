from __future__ import annotations

import random

from credograph.llm import spam

random.seed(8)
WORDS = "the trial showed that patients with early disease had fewer visits after the second dose because nurses called them every week and asked about sleep pain appetite work travel".split()
PROSE = lambda n: " ".join(" ".join(random.sample(WORDS, 12)).capitalize() + f" in {random.randrange(2000)}." for _ in range(n))
KEYWORDS = ", ".join(random.choice(["buy xelomab", "cheap xelomab", "xelomab price", "xelomab online"]) for _ in range(80))
LINKS = "\n".join(f"http://site{random.randrange(10**6)}.test/page-{random.randrange(10**6)}" for _ in range(30))
DOCS = {
    1: PROSE(12),
    2: KEYWORDS,
    3: LINKS,
    4: PROSE(14) + "\n\nKeywords: xelomab; melanoma; trial",
    5: PROSE(2) + "\n\n" + KEYWORDS,
    6: "\n".join(f"{random.choice(WORDS).title()}{random.randrange(99)} {random.randrange(500)} mg x 30 - ${random.randrange(500)}.99 add to cart" for _ in range(20)),
    7: "Visit schedule\n" + "\n".join(f"Week {4 * i}: {random.choice(['MRI', 'blood draw', 'vital signs'])}, {random.choice(['dosing', 'no dosing'])}, {random.choice(['survival', 'pain score', 'walk distance', 'marker'])}" for i in range(20)),
    8: "References\n" + "\n".join(f"{i}. A. {random.choice(WORDS).title()} et al. On {random.choice(WORDS)} and {random.choice(WORDS)}. J Trials 20{i + 10};{i}:{random.randrange(900)}. https://doi.example/{random.randrange(999)}" for i in range(12)),
    9: "",
    10: "buy xelomab",
    11: " ".join(f"#{random.choice(['deal', 'pharma', 'xelomab', 'melanoma', 'trial'])}" for _ in range(60)),
    12: ("The xelomab is xelomab for xelomab. " * 60),
    13: "Inclusion criteria:\n" + "\n".join(f"- {random.choice(['History of', 'No prior', 'Stable', 'Confirmed'])} {random.choice(WORDS)} {random.choice(WORDS)}, within {random.randrange(90)} weeks" for _ in range(15)),
    14: KEYWORDS * 300,
}


def test_found(spark):
    rows = [(d, t, ["en", None, "EN", "x-y"][d % 4], 1) for d, t in DOCS.items()] + [(20, None, "en", 1), (21, " \n ", "en", 1), (None, KEYWORDS, "en", 1)] + [(100 + i, PROSE(random.randrange(1, 20)), "en", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, chars int")
    assert {r["doc_id"] for r in spam.spam(docs).collect()} == {2, 3, 5, 6, 11, 12, 14}
    assert spam.spam(docs.limit(0)).count() == 0


def test_blocks_keep_everything():
    text = "a b c\n\n" + "word " * 1000 + "\nx\n" + "y" * 3000
    assert "".join("".join(spam.blocks(text)).split()) == "".join(text.split())
    assert all(len(b) <= spam.BLOCK_CHARS + 1 for b in spam.blocks(text))
    assert spam.blocks("") == spam.blocks(" \n \n") == []


def test_spam_that_is_most_of_its_language_is_not_usual(spark):
    """Running keywords, which no rule on items tells: copies, and pages that are all different."""
    r = random.Random(3)
    page = lambda: " ".join(r.choice(["xelomab", "cheap", "melanoma", "cure", "price", "order"]) for _ in range(110))
    copied = page()
    rows = [(i, copied, "fr") for i in range(50)] + [(100 + i, page(), "de") for i in range(50)] + [(200, page(), "it")]
    rows += [(300 + i, PROSE(r.randrange(5, 20)), ["fr", "de", "en"][i % 3]) for i in range(30)]
    found = {x["doc_id"] for x in spam.spam(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found == {*range(50), *range(100, 150), 200}
