"""Keyword-stuffed pages, link lists and tag lists.

A text is cut into blocks. Each block's compression ratio is set against what blocks of
its length and language usually have in the whole collection; extreme redundancy is
confirmed by few sentences that say something new. Lists that aren't redundant (links,
prices, tags) are told by what their items are. A text is spam if such blocks make up
the greater part of it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credograph.session import cut, spread

BLOCK_CHARS = 900
#: Below so many characters a text is too short to tell.
MIN_CHARS = 60
#: Part of a text's characters that has to be in spam blocks.
GREATER_PART = 0.5
#: A ratio at most this share of the usual one is extreme; up to the second it needs repeats.
EXTREME, LOW = 0.5, 0.65
#: Share of a block's characters in links, how many at least, and share of its items with a price.
LINK_SHARE, LINKS, OFFER_SHARE = 0.6, 5, 0.5
#: Share of a list's items that repeat others, and of its words that are one and the same.
REPEATED_ITEMS, ONE_WORD = 0.3, 0.17
#: Sentences (of five or more words, each told once) for a hundred words, at most, to confirm.
SENTENCE_DENSITY = 2.0
#: The next coarser statistic weighs as much as so many blocks of a length and language (or length alone).
PRIOR_BLOCKS = 30
#: The usual ratio is at least this share of ordinary prose's, whatever most blocks are.
LEAST_USUAL = 0.75

LINK = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\")]+", re.S | re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
META = re.compile(r"<meta\b[^>]*\bcontent\s*=\s*\"([^\"]*)\"[^>]*>", re.I)
OFFER = re.compile(r"[$€£¥₹]\s?\d|\d\s?[$€£¥₹]")
WORD = re.compile(r"[^\W_]+(?:[-'’,][^\W_]+)*")
#: A sentence, or (without a group) text up to a mark that ends none, which is passed over in one go.
SENTENCE = re.compile(r"([^.!?\n]*[.!?]+[\"'”)]*(?:\s|$)|[^.!?\n]+(?:\n|$))|[^.!?\n]*[.!?]+")
SEPARATORS = ("\n", "»", "|", "•", "#", ";", " / ", ", ", " - ", " · ")


def blocks(text: str) -> list[str]:
    """Paragraphs and lines joined up to the block length; longer ones cut between words."""
    out: list[str] = []
    held, n = [], 0
    for line in text.split("\n"):
        while len(line) > BLOCK_CHARS:
            at = line.rfind(" ", 1, BLOCK_CHARS)
            at = at if at > 0 else BLOCK_CHARS
            piece, line = line[:at], line[at:].lstrip(" ")
            if held:
                out.append("\n".join(held))
                held, n = [], 0
            out.append(piece)
        if held and (n + len(line) > BLOCK_CHARS or not line.strip()):
            out.append("\n".join(held))
            held, n = [], 0
        if line.strip():
            held.append(line)
            n += len(line) + 1
    if held:
        out.append("\n".join(held))
    return out


def ratio(block: str) -> float:
    raw = block.encode("utf-8", "replace")
    return len(zlib.compress(raw, 6)) / max(1, len(raw))


def length_class(n: int) -> int:
    """Blocks of like length: half powers of two."""
    return int(2 * max(n, 1).bit_length() + (n >> max(0, n.bit_length() - 2) & 1))


def items(block: str) -> list[str]:
    """The items of a block in lower case by its commonest separator; lines where it has several."""
    if block.count("\n") >= 2:
        sep = "\n"
    else:
        sep, n = max(((s, block.count(s)) for s in SEPARATORS), key=lambda x: x[1])
        if n < 5:
            return []
    return [x for x in (p.strip(" \t.,") for p in block.split(sep)) if x]


def measures(block: str) -> tuple[float, float, float, float, float]:
    """Share of links (0 if few), items with a price, repeated items and the commonest word; sentences told once per 100 words."""
    text, link_share = block, 0.0
    if "<" in block:
        text = TAG.sub(" ", META.sub(r" \1 ", block))
    if "<" in block or "://" in block or "](" in block or "www." in block.lower():
        spans = [m.end() - m.start() for m in LINK.finditer(block)]
        markup = sum(m.end() - m.start() for m in TAG.finditer(LINK.sub("", block)))
        link_share = (sum(spans) if len(spans) >= LINKS else 0) / max(1, len(block) - markup)
    text = text.lower()
    listed = items(text)
    offers = sum(bool(OFFER.search(x)) for x in listed) / len(listed) if len(listed) >= 4 else float(bool(OFFER.search(block)))
    repeated = 1 - len(set(listed)) / len(listed) if len(listed) >= 6 else 0.0
    words = WORD.findall(text)
    sentences = [x for x in map(str.strip, SENTENCE.findall(text)) if x]
    once = set(sentences)
    if len(sentences) >= 8:
        repeated = max(repeated, 1 - len(once) / len(sentences))
    told = sum(1 for s in once if s.rstrip("\"')”")[-1:] in (".", "!", "?") and s.count(" ") >= 4 and len(s.split()) >= 5)
    top = max(Counter(w for w in words if len(w) >= 5).values(), default=0) / max(1, len(words))
    return link_share, offers, repeated, top, 100 * told / max(1, len(words))


def usual(n: int) -> float:
    """Ratio of ordinary prose of n characters, where the collection has too little to tell."""
    return 0.4 + 5.2 / max(n, 1) ** 0.5


def digest(block: str) -> int:
    """Names the block's text, so that copies count once."""
    return int.from_bytes(hashlib.blake2b(" ".join(block.lower().split()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


BLOCK_ROWS = "doc_id long, lang string, size_class int, n long, digest long, ratio double, prior double, links double, offers double, repeated double, one_word double, told double"


def block_rows(docs: DataFrame) -> DataFrame:
    """The measures of every block of every text; no text is carried along."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            rows = []
            for doc, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for block in blocks(text or ""):
                    n = len(block)
                    rows.append((doc, lang, length_class(n), n, digest(block), ratio(block), usual(n), *measures(block)))
            columns = list(zip(*rows)) if rows else [()] * 12
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()] + [pa.float64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in BLOCK_ROWS.split(", ")])

    lang = F.when(F.lower("lang").rlike("^[a-z]{2}$"), F.lower("lang")).otherwise("und")
    return spread(docs.select("doc_id", "text", "lang"), "doc_id").where("doc_id is not null").select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string")).mapInArrow(run, BLOCK_ROWS)


def spam_share(docs: DataFrame) -> DataFrame:
    """``doc_id, chars, spam_chars`` of every text with anything in it.

    Needs ``doc_id, text, lang``; other columns are not read. Null, empty and blank texts
    give no row, repeated ids are one text, whole texts are measured whatever their
    length. The usual ratio is the median of the distinct blocks of the same length class
    and language, drawn towards that of the length class and of ordinary prose the fewer
    they are, and never far below ordinary prose, so that copies or mere numbers of spam
    don't make it usual; these statistics have at most 677 languages times 130 classes.
    """
    rows = cut(block_rows(docs))
    once = rows.groupBy("size_class", "lang", "digest").agg(F.min("ratio").alias("ratio"))
    by_lang = once.groupBy("size_class", "lang").agg(F.percentile_approx("ratio", 0.5).alias("m1"), F.count("*").alias("n1"))
    by_class = once.groupBy("size_class", "digest").agg(F.min("ratio").alias("ratio")).groupBy("size_class").agg(F.percentile_approx("ratio", 0.5).alias("m2"), F.count("*").alias("n2"))
    x = rows.join(F.broadcast(by_lang), ["size_class", "lang"]).join(F.broadcast(by_class), "size_class")
    coarse = (F.col("n2") * F.col("m2") + PRIOR_BLOCKS * F.col("prior")) / (F.col("n2") + PRIOR_BLOCKS)
    mean = (F.col("n1") * F.col("m1") + PRIOR_BLOCKS * coarse) / (F.col("n1") + PRIOR_BLOCKS)
    low = F.col("ratio") / F.greatest(mean, LEAST_USUAL * F.col("prior"))
    repeats = (F.col("repeated") >= REPEATED_ITEMS) | (F.col("one_word") >= ONE_WORD)
    redundant = ((low <= EXTREME) | ((low <= LOW) & repeats)) & ((F.col("told") <= SENTENCE_DENSITY) | repeats)
    listed = (F.col("links") >= LINK_SHARE) | (F.col("offers") >= OFFER_SHARE) | ((F.col("repeated") >= REPEATED_ITEMS) & (F.col("told") <= SENTENCE_DENSITY / 2))
    flagged = F.when(redundant | listed, F.col("n")).otherwise(0)
    return x.groupBy("doc_id").agg(F.sum("n").alias("chars"), F.sum(flagged).alias("spam_chars"))


def spam(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that are, for the greater part, keywords, links or tags."""
    return spam_share(docs).where((F.col("chars") >= MIN_CHARS) & (F.col("spam_chars") > GREATER_PART * F.col("chars"))).select("doc_id")
