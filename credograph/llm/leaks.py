"""Test items leaking into training texts.

The test items are the small side: their words make a BM25 inverted index whose postings
come in blocks with the largest weight of each. Every passage of every text is a query;
block-max WAND gives all items above a threshold while it skips blocks that can't reach
it. Blocks are aligned over the items' numbers, so one bound holds for a block whatever
the term, and the bounds of many passages are added up at once. An item found is verified
by local alignment: enough of its words in running order, altered words and spelling
allowed, and enough of them said of this case alone.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache, reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credograph.session import cut, spread

PASSAGE, STEP = 40, 20
K1, B = 1.2, 0.75
BLOCK = 8
#: A passage has to score this share of the least that a run of RUN words of the item scores.
SHARE, RUN = 0.55, 20
#: An alignment's score: one for a word, one off for a word altered, lost or put in.
SCORE, MATCHED = 13.0, 15
#: Pairs of neighbouring words shared at about one offset that a passage has to have to be aligned:
#: with five of twenty words altered, nine of nineteen pairs are still whole.
PAIRS, BAND = 8, 8
#: What the alignment's words have to say of the case: each word counts by how little the other items
#: lead one to expect it after the word before it (in nats; set phrases count nothing), words of the
#: item that are altered or lost count against it. A word the items never have there has this chance.
EVIDENCE, CHANCE = 36.0, 1e-3
#: So many words of texts times words of items are scored in one pass.
CELLS = 2_000_000
#: So many words of texts are searched in one pass.
PASS_WORDS = 60_000
#: Items and bytes of item text that one index holds at most; more items are searched range by range.
RANGE_ITEMS, RANGE_BYTES = 4_096, 8_000_000

_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_BREAK = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?=[a-z])|[­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


@cache
def _marks() -> dict[int, None]:
    """All combining marks, to be left out."""
    return {c: None for c in range(0x110000) if unicodedata.combining(chr(c))}


def words(text: str) -> list[str]:
    """Words without case, markup, accents, punctuation and hyphenation."""
    x = html.unescape(_BREAK.sub("", text))
    x = _TAG.sub(" ", x).replace("&", " and ")
    if not x.isascii():
        x = unicodedata.normalize("NFKD", x).translate(_marks())
    return _WORD.findall(x.lower().replace("'", "").replace("’", ""))


class Index:
    """Inverted index of the items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_docs: int, others: tuple[float, Counter[tuple[str, str]], Counter[str]] | None = None):
        """``df``: of the items' words, how many of the ``n_docs`` texts searched hold them.

        ``others``, where these items are one range of many: what ``expectations`` says of all.
        """
        self.ids = [i for i, _ in items]
        self.words = [words(t or "") for _, t in items]
        average, after, first = others or expectations(self.words)
        self.idf = {w: math.log(1 + max(0.0, n_docs - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in {w for ws in self.words for w in ws}}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for w, tf in Counter(ws).items():
                postings[w].append((i, self.idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / average))))
        self.items = {w: [i for i, _ in p] for w, p in postings.items()}
        self.weights = {w: [x for _, x in p] for w, p in postings.items()}
        self.top = {w: max(x) for w, x in self.weights.items()}
        self.worth = [_worth(ws, after, first) for ws in self.words]
        self.places: list[dict[str, list[int]]] = []
        for ws in self.words:
            places: dict[str, list[int]] = defaultdict(list)
            for j, w in enumerate(ws):
                places[w].append(j)
            self.places.append(dict(places))
        self.spelt: dict[str, list[str]] = {}
        self.need = [self._need(i) for i in range(len(items))]
        self.least = min(self.need, default=0.0)
        self._pack()

    def _pack(self) -> None:
        """Postings as rows of one block each, the largest weight of each row, and the places of word pairs."""
        n_blocks = -(-len(self.ids) // BLOCK)
        self.term = {w: k for k, w in enumerate(self.items)}
        self.row = np.zeros((len(self.term), n_blocks), np.int32)  # of a term in a block; row 0 holds nothing
        rows: list[np.ndarray] = [np.zeros(BLOCK)]
        for w, k in self.term.items():
            for i, x in zip(self.items[w], self.weights[w]):
                if not self.row[k, i // BLOCK]:
                    self.row[k, i // BLOCK] = len(rows)
                    rows.append(np.zeros(BLOCK))
                rows[self.row[k, i // BLOCK]][i % BLOCK] = x
        self.rows = np.array(rows)
        self.tops = self.rows.max(axis=1)[self.row] if n_blocks else np.zeros((0, 0))
        self.term_top = np.array([self.top[w] for w in self.term])
        need = np.full(n_blocks * BLOCK, np.inf)
        need[: len(self.need)] = self.need
        self.block_need = need.reshape(n_blocks, BLOCK)
        pairs = [(self.term[x] * len(self.term) + self.term[y], i, j) for i, ws in enumerate(self.words) for j, (x, y) in enumerate(zip(ws, ws[1:]))]
        held = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_from = np.unique(held[:, 0], return_index=True)
        self.pair_until = np.append(self.pair_from[1:], len(held))
        self.pair_item, self.pair_at = held[:, 1], held[:, 2]

    def _need(self, i: int) -> float:
        """The threshold of an item: a share of what its weakest run scores against it."""
        ws = self.words[i]
        own = {w: self.weights[w][self.items[w].index(i)] for w in set(ws)}
        runs = [sum(own[w] for w in set(ws[k : k + RUN])) for k in range(max(1, len(ws) - RUN + 1))]
        return SHARE * min(runs)

    def whole(self, item: int) -> float:
        """What is asked of an item, as a share: items shorter than a run have to be there as a whole."""
        return min(1.0, len(self.words[item]) / RUN)

    def search(self, terms: set[str]) -> list[int]:
        """All items whose BM25 score for these terms reaches their threshold."""
        held = np.array(sorted(self.term[t] for t in terms if t in self.term), np.int64)
        return sorted(self.search_passages(np.zeros(len(held), np.int64), held)[1].tolist())

    def search_passages(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and items of all BM25 scores that reach the item's threshold.

        The passages' terms come sorted by passage, each once. A passage goes on if its
        terms' largest weights could reach any threshold, then a block if its maxima could;
        only such blocks are scored.
        """
        slack, found = 1e-9, [(np.zeros(0, np.int64),) * 2]
        if not len(term):
            return found[0]
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        lengths = np.diff(np.append(starts, len(term)))
        live = np.add.reduceat(self.term_top[term], starts) >= self.least - slack
        term, passage, lengths = term[np.repeat(live, lengths)], passage[starts][live], lengths[live]
        starts = np.cumsum(lengths) - lengths
        least = self.block_need.min(axis=1)
        size = max(1, CELLS // max(1, len(least)))  # terms for one pass
        first = 0
        while first < len(passage):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + size)))
            part = slice(starts[first], starts[last] if last < len(starts) else len(term))
            bounds = np.add.reduceat(self.tops[term[part]], starts[first:last] - starts[first], axis=0)
            who, block = np.nonzero(bounds >= least - slack)
            who += first
            step = max(1, CELLS // (BLOCK * max(1, int(lengths[first:last].max()))))
            for k in range(0, len(who), step):
                w, b = who[k : k + step], block[k : k + step]
                n = lengths[w]
                begin = np.cumsum(n) - n
                at = np.repeat(starts[w] - begin, n) + np.arange(int(n.sum()))
                scores = np.add.reduceat(self.rows[self.row[term[at], np.repeat(b, n)]], begin, axis=0)
                c, j = np.nonzero((scores >= self.block_need[b] - slack) & (scores > 0))
                found.append((passage[w[c]], b[c] * BLOCK + j))
            first = last
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def like(self, item: int, w: str) -> list[str]:
        """The item's words that w may stand for: itself, or else all of like spelling."""
        held = self.places[item]
        if w in held:
            return [w]
        if w not in self.spelt:
            if len(self.spelt) >= 200_000:
                self.spelt.clear()
            self.spelt[w] = [x for x in self.top if (x[0] == w[0] or x[-1] == w[-1]) and near(w, x)]
        return [x for x in self.spelt[w] if x in held]

    def matrices(self, found: list[tuple[int, list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each word of the texts in turn: what it is to the items' words (1 or -1), and the local alignments' scores up to it."""
        height, width = max(len(text) for _, text in found), max(len(self.words[i]) for i, _ in found)
        same = np.full((height, width, len(found)), -1, np.int16)
        for n, (item, text) in enumerate(found):
            held, like, spelt, at = self.places[item], self.like, self.spelt, []
            for i, w in enumerate(text):
                if w in held:
                    at += [(i, j) for j in held[w]]
                elif w not in spelt or spelt[w]:
                    at += [(i, j) for x in like(item, w) for j in held[x]]
            if at:
                i, j = np.array(at).T
                same[i, j, n] = 1
        at = np.arange(width, dtype=np.int16)[:, None]
        score = np.zeros((width + 1, len(found)), np.int16)
        x, skipped = np.empty((width, len(found)), np.int16), np.empty((width, len(found)), np.int16)
        for row in same:
            np.add(score[:-1], row, out=x)
            np.subtract(score[1:], 1, out=skipped)
            np.maximum(x, skipped, out=x)
            np.maximum(x, 0, out=x)
            x += at  # a word of the item left out costs one: the running maximum over the item
            np.maximum.accumulate(x, axis=0, out=x)
            np.subtract(x, at, out=score[1:])
            yield row, score

    def scores(self, found: list[tuple[int, list[str]]]) -> list[int]:
        """The best local alignment's score of each item and text, all in one pass."""
        best = np.zeros((1, 1), np.int16)
        for _, score in self.matrices(found):
            best = np.maximum(best, score)
        return best.max(axis=0).tolist()

    def alignments(self, found: list[tuple[int, list[str]]]) -> list[tuple[int, int, float]]:
        """Score, matched words and evidence of the best local alignment of each item and text: what ``alignment`` gives."""
        rows = [(row.copy(), score.copy()) for row, score in self.matrices(found)]
        same, score = np.array([x for x, _ in rows]), np.array([x for _, x in rows])
        out = []
        for n, (item, text) in enumerate(found):
            mine = np.vstack([np.zeros((1, score.shape[1]), np.int16), score[: len(text), :, n]])
            i, j = divmod(int(mine[:, : len(self.words[item]) + 1].argmax()), len(self.words[item]) + 1)
            best, matched, evidence, worth = int(mine[i, j]), 0, 0.0, self.worth[item]
            while i and j and mine[i, j] > 0:
                if mine[i, j] == mine[i - 1, j - 1] + same[i - 1, j - 1, n]:
                    hit = same[i - 1, j - 1, n] > 0
                    matched += int(hit)
                    evidence += worth[j - 1] if hit else -worth[j - 1]
                    i, j = i - 1, j - 1
                elif mine[i, j] == mine[i - 1, j] - 1:
                    i -= 1
                else:
                    evidence -= worth[j - 1]
                    j -= 1
            out.append((best, matched, evidence))
        return out

    def in_order(self, spans: np.ndarray, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which spans share enough word pairs with their item within two neighbouring bands of offsets.

        ``spans``: item, first and last place (exclusive) among the words of all texts, sorted;
        ``terms``: the words' numbers, -1 for others; ``at``: their places in their own text.
        """
        n = len(self.term)
        out = np.zeros(len(spans), bool)
        if not len(self.pair_keys) or len(terms) < 2:
            return out
        key = np.where((terms[:-1] >= 0) & (terms[1:] >= 0) & (at[1:] > 0), terms[:-1] * n + terms[1:], -1)
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        place = np.flatnonzero(self.pair_keys[k] == key)
        k = k[place]
        many = self.pair_until[k] - self.pair_from[k]
        hit = np.repeat(self.pair_from[k] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        place, item = np.repeat(place, many), self.pair_item[hit]
        band = (at[place] - self.pair_at[hit]) // BAND
        start = spans[:, 0] * (len(terms) + 1) + spans[:, 1]
        last = np.searchsorted(start, item * (len(terms) + 1) + place, side="right") - 1
        wide = int(at.max()) // BAND + max(map(len, self.words)) // BAND + 4
        low = max(map(len, self.words)) // BAND + 2
        keys = []
        for span in (last, last - 1):  # neighbouring spans of an item may overlap
            span, known = np.maximum(span, 0), span >= 0
            ok = known & (spans[span, 0] == item) & (place >= spans[span, 1]) & (place + 1 < spans[span, 2])
            keys.append(span[ok] * wide + band[ok] + low)
        band_of, count = np.unique(np.concatenate(keys), return_counts=True)
        following = np.append((np.diff(band_of) == 1) & (band_of[1:] % wide != 0), False)
        pairs = count + np.where(following, np.append(count[1:], 0), 0)
        need = PAIRS * np.minimum(1.0, np.array([len(ws) for ws in self.words]) / RUN)
        span = band_of // wide
        out[span[pairs >= need[spans[span, 0]]]] = True
        return out


def expectations(told: Iterable[list[str]]) -> tuple[float, Counter[tuple[str, str]], Counter[str]]:
    """Of the items' words: their mean number, and how often each pair and each first word of a pair is told; an item given several times is told once."""
    listed = list(told)
    once = {tuple(ws) for ws in listed}
    after = Counter(p for ws in once for p in zip(ws, ws[1:]))
    first = Counter(w for ws in once for w in ws[:-1])
    return max(1.0, sum(map(len, listed)) / max(1, len(listed))), after, first


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> bool:
    """The same word but for its spelling: one slip from four letters on, two from eight."""
    k = 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 8 else 2
    if not k or abs(len(a) - len(b)) > k or a.isdigit() or b.isdigit():
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        if min(now) > k:
            return False
        before = now
    return before[-1] <= k


def _worth(ws: list[str], after: Counter[tuple[str, str]], first: Counter[str]) -> list[float]:
    """How little each word is to be expected after the one before it, by what the other items say (nats)."""
    own, own_first = Counter(zip(ws, ws[1:])), Counter(ws[:-1])
    return [-math.log(CHANCE)] * bool(ws) + [-math.log((after[p] - own[p] + CHANCE) / (first[p[0]] - own_first[p[0]] + 1)) for p in zip(ws, ws[1:])]


def aligned(text: list[str], item: list[str]) -> tuple[float, int]:
    """Score and matched words of the best local alignment."""
    spelt = set(item)
    same: dict[str, set[str]] = {w: {w} if w in spelt else {x for x in spelt if x[0] == w[0] or x[-1] == w[-1] if near(w, x)} for w in set(text)}
    return alignment(text, item, same, [0.0] * len(item))[:2]


def alignment(text: list[str], item: list[str], same: dict[str, set[str]], worth: list[float]) -> tuple[float, int, float]:
    """Score, matched words and evidence of the best local alignment; ``same``: what each word of the text may stand for."""
    best, matched, evidence = 0.0, 0, 0.0
    score, count, told = [0.0] * (len(item) + 1), [0] * (len(item) + 1), [0.0] * (len(item) + 1)
    for w in text:
        hits = same[w]
        last_s, last_c, last_e = score, count, told
        score, count, told = [0.0], [0], [0.0]
        for j, x in enumerate(item, 1):
            if x in hits:
                s, c, e = last_s[j - 1] + 1, last_c[j - 1] + 1, last_e[j - 1] + worth[j - 1]
            else:
                s, c, e = last_s[j - 1] - 1, last_c[j - 1], last_e[j - 1] - worth[j - 1]
            if last_s[j] - 1 > s:
                s, c, e = last_s[j] - 1, last_c[j], last_e[j]
            if score[j - 1] - 1 > s:
                s, c, e = score[j - 1] - 1, count[j - 1], told[j - 1] - worth[j - 1]
            if s <= 0:
                s, c, e = 0.0, 0, 0.0
            score.append(s)
            count.append(c)
            told.append(e)
            if s > best:
                best, matched, evidence = s, c, e
    return best, matched, evidence


def leaked(index: Index, text: str) -> list[tuple[int, float, int]]:
    """Item id, score and matched words of each item that the text leaks."""
    return leaked_all(index, [text])[0]


def leaked_all(index: Index, texts: list[str]) -> list[list[tuple[int, float, int]]]:
    """``leaked`` of each text, searched together in passes of about ``PASS_WORDS`` words."""
    out: list[list[tuple[int, float, int]]] = []
    held: list[list[str]] = []
    size = 0
    for text in texts:
        held.append(words(text) if index.ids else [])
        size += len(held[-1])
        if size >= PASS_WORDS:
            out += _leaked(index, held)
            held, size = [], 0
    return out + _leaked(index, held)


def _leaked(index: Index, told: list[list[str]]) -> list[list[tuple[int, float, int]]]:
    out: list[list[tuple[int, float, int]]] = [[] for _ in told]
    lengths = np.array([len(ws) for ws in told], np.int64)
    if not lengths.sum() or not index.term:
        return out
    get = index.term.get
    terms = np.array([get(w, -1) for ws in told for w in ws], np.int64)
    begins = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(told)), lengths)
    at = np.arange(len(terms)) - begins[text]
    # passage k of a text has its words from k * STEP on; each word is in two passages, at the ends in one
    count = np.maximum(1, -(-(lengths - STEP) // STEP))
    first = np.cumsum(count) - count
    known = np.flatnonzero(terms >= 0)
    own, step = text[known], at[known] // STEP
    n = len(index.term)
    keys = [(first[own] + k)[ok] * n + terms[known][ok] for k in (step, step - 1) for ok in [(k >= 0) & (k < count[own])]]
    passage, term = np.divmod(np.unique(np.concatenate(keys)), n)
    hit, item = index.search_passages(passage, term)
    if not len(hit):
        return out
    of = np.searchsorted(first, hit, side="right") - 1
    spans: list[list[int]] = []  # item, begin, end, text; neighbouring passages are aligned as one
    for i, t, k in sorted(zip(item.tolist(), of.tolist(), ((hit - first[of]) * STEP).tolist())):
        begin, most = int(begins[t]), int(begins[t] + lengths[t])
        if spans and spans[-1][0] == i and spans[-1][3] == t and begin + k <= spans[-1][4]:
            spans[-1][2], spans[-1][4] = min(most, begin + k + PASSAGE + STEP), begin + k + PASSAGE + STEP
        else:
            spans.append([i, begin + max(0, k - STEP), min(most, begin + k + PASSAGE + STEP), t, begin + k + PASSAGE + STEP])
    ok = index.in_order(np.array(spans, np.int64), terms, at)
    found = [(i, told[t][a - int(begins[t]) : b - int(begins[t])], t) for (i, a, b, t, _), good in zip(spans, ok.tolist()) if good]
    found.sort(key=lambda x: len(x[1]))  # of like length together
    verified: dict[tuple[int, int], tuple[float, int]] = {}
    for part in _parts(index, found):
        near_enough = [x for x, score in zip(part, index.scores([x[:2] for x in part])) if score >= SCORE * index.whole(x[0])]
        if near_enough:
            for (i, _, t), (best, matched, evidence) in zip(near_enough, index.alignments([x[:2] for x in near_enough])):
                if matched >= MATCHED * index.whole(i) and evidence >= EVIDENCE * index.whole(i):
                    verified[t, i] = max(verified.get((t, i), (0.0, 0)), (float(best), matched))
    for (t, i), hit_of in sorted(verified.items()):
        out[t].append((index.ids[i], *hit_of))
    return out


def _parts(index: Index, found: list[tuple[int, list[str], int]]) -> Iterator[list[tuple[int, list[str], int]]]:
    """From the longest on, as many as make ``CELLS`` cells."""
    while found:
        size = max(1, CELLS // (len(found[-1][1]) * max(len(index.words[i]) for i, _, _ in found)))
        yield found[-size:]
        found = found[:-size]


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How many texts hold each word of the vocabulary, and how many there are; counted in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        held = shared.value
        df: Counter[str] = Counter()
        n = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                if text:
                    df.update(held.intersection(words(text)))
        df[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"]: r["n"] for r in counted}
    return df, df.pop("", 0)


def _told(items: DataFrame) -> DataFrame:
    """The words of each item, a blank between."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(words(t or "")) for t in b.column(0).to_pylist()], pa.string())], names=["told"])

    return items.select("item_text").mapInArrow(run, "told string")


def _others(told: DataFrame, listed: list[tuple[int, str]]) -> tuple[float, Counter[tuple[str, str]], Counter[str]]:
    """What all items say of the words and word pairs of a range of them: ``expectations`` of all, for these words only."""
    mine = expectations([words(t) for _, t in listed])
    shared = told.sparkSession.sparkContext.broadcast((frozenset(mine[1]), frozenset(mine[2])))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        pairs, firsts = shared.value
        n: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                ws = t.split()
                n.update(p for p in zip(ws, ws[1:]) if p in pairs)
                n.update((w, "") for w in ws[:-1] if w in firsts)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.string()), pa.array([y for _, y in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["x", "y", "n"])

    average = told.agg(F.avg(F.size(F.filter(F.split("told", " "), lambda w: w != ""))).alias("a")).first()["a"]
    counted = told.distinct().mapInArrow(run, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    return max(1.0, average), Counter({(r["x"], r["y"]): r["n"] for r in counted if r["y"]}), Counter({r["x"]: r["n"] for r in counted if not r["y"]})


_held: dict[str, Index] = {}


def _index(key: str, made_of: tuple[Any, ...]) -> Index:
    """The index of a broadcast, made once a worker process."""
    if key not in _held:
        _held.clear()
        _held[key] = Index(*made_of)
    return _held[key]


def find(docs: DataFrame, items: DataFrame, range_items: int = RANGE_ITEMS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, item_id, score, matched``: every text and each test item it holds a passage of.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, item_text``; other columns
    are not read. Words weigh by how rare they are in all texts; all passages of whole
    texts are searched, however often one text is copied. The index of at most about
    ``range_items`` items and ``range_bytes`` bytes of their text goes to every task; more
    items are searched range by range, each a pass over the texts, with the same result.
    Null, empty and blank texts and items leak nothing; repeated rows give repeated results.
    """
    held = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_id is not null and trim(item_text) <> ''")
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    ranges = max(1, -(-size["n"] // range_items), -(-size["bytes"] // range_bytes))
    docs = spread(docs.select("doc_id", "text"), "doc_id")
    told = cut(_told(held)) if ranges > 1 else None
    found = [_find(docs, [tuple(r) for r in held.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(ranges)) == k).collect()], told) for k in range(ranges)]
    return reduce(DataFrame.unionByName, found)


def _find(docs: DataFrame, listed: list[tuple[int, str]], told: DataFrame | None) -> DataFrame:
    df, n_docs = document_frequencies(docs, {w for _, text in listed for w in words(text)})
    others = None if told is None else _others(told, listed)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((listed, df, n_docs, others))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        index = _index(key, shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [(doc, *hit) for doc, hits in zip(b.column(0).to_pylist(), leaked_all(index, texts)) for hit in hits]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["doc_id", "item_id", "score", "matched"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "doc_id long, item_id long, score double, matched int")
