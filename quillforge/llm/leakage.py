"""Evaluation texts that leak into a corpus (problem 7).

Method: q-gram lemma filtering. Texts are reduced to their letters and digits. A passage with at least half of an item's words and at
most one word in ten changed or added keeps a number of the item's q-grams that follows from the item's own words; shared q-grams are
counted in overlapping bands of diagonals, as wide as the item's edits can move an alignment, and only bands that reach the item's bound
are kept. Each of these is verified by a banded alignment of words: a path over the places where the item's words stand in the document,
with the changed and added words between them as its cost. Spaces play no part in it: a word may be written apart or together.

Defined results: null and blank documents and items leak nothing. Documents are read whole. Repeated documents are each reported. Items
so short that a passage of them may hold no q-gram have no edits to allow; their passages are looked up as they are. The evaluation set
is worked through in blocks of BLOCK characters, so that what is sent to the tasks is bounded: one pass over the documents for a set of
some 100,000 items. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.chars import map_rows

Q, BUCKETS = 6, 20
#: Characters of items that one index holds, which bounds it to some 300 MB.
BLOCK = 20_000_000
#: Share of an item's words that a passage needs, and share of the passage's words that may be changed or added.
SHARE, EDITS = 0.5, 0.1
#: Least half width of a band of diagonals, and characters that a changed or added word moves the alignment by, at most.
BAND, MOVE = 64, 16
HYPHEN = re.compile(r"[-‐­](?<=\w[-‐­])[​⁠﻿]*\s*\n[\s>|]*(?=\w)")
#: A table of the characters that stay, folded; zero for the others.
KEEP = np.zeros(0x10000, np.uint16)
for _c in range(0x10000):
    _s = chr(_c)
    if _s.isalnum():
        _f = unicodedata.normalize("NFKC", _s).casefold()
        KEEP[_c] = ord(_f[0]) if _f and ord(_f[0]) < 0x10000 else _c
#: What parts words; the zero stands between texts.
SPACE = np.array([chr(c).isspace() and unicodedata.category(chr(c)) != "Cc" for c in range(0x10000)])
SPACE[[0, 9, 10, 11, 12, 13]] = True


class Compact:
    """Letters and digits of many texts, folded, as codes end to end, with the number of the word that each stands in."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts)
        if joined.count("\0") != max(0, len(texts) - 1):
            joined = "\0".join(t.replace("\0", " ") for t in texts)
        if not unicodedata.is_normalized("NFC", joined):
            joined = unicodedata.normalize("NFC", joined)
        raw = np.frombuffer(HYPHEN.sub("", joined).encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(raw, 0xFFFF)
        kept = np.where(raw < 0x10000, KEEP[low], raw).astype(np.uint32)
        stay = kept != 0
        word = np.cumsum(SPACE[low], dtype=np.int32)[stay]
        self.codes = kept[stay]
        # numbers without gaps: words without a letter or digit do not count
        self.word = np.cumsum(np.diff(word, prepend=word[:1]) != 0, dtype=np.int32)
        parts = np.flatnonzero(raw == 0)
        self.first = np.concatenate(([0], np.cumsum(stay)[parts])).astype(np.int64)[: len(texts)] if len(raw) else np.zeros(len(texts), np.int64)
        self.last = np.append(self.first[1:], len(self.codes))


def item_words(text: str) -> list[np.ndarray]:
    c = Compact([text])
    return np.split(c.codes, np.flatnonzero(np.diff(c.word)) + 1) if len(c.codes) else []


def string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "replace")


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """32-bit hashes of the q-grams of a sequence of codes."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(Q):
        h *= np.uint32(0x01000193)
        h += codes[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def least_grams(lens: np.ndarray) -> int:
    """The fewest q-grams that a passage keeps, of any length from half of the words (of lengths ``lens``) to all, each with its own number of edits."""
    ends = np.concatenate(([0], np.cumsum(lens)))
    lost = np.concatenate(([0], np.cumsum(np.sort(lens)[::-1] + Q - 1)))
    return min(int((ends[n:] - ends[:-n]).min()) - (Q - 1) - int(lost[int(n * EDITS)]) for n in range(-(-len(lens) // 2), len(lens) + 1))


class Index:
    """The q-grams of the items' sides, with the bound and the width of the bands of each side."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items, self.words, self.places, bounds, wide = [], [], [], [], []
        self.short: list[tuple[int, list[str]]] = []
        hashes, sides, places = [], [], []
        for item, text in items:
            ws = item_words(text or "")
            if not ws:
                continue
            lens = np.array([len(w) for w in ws])
            k, least = len(self.items), least_grams(lens)
            bounds.append(max(1, least))
            wide.append(max(BAND, MOVE * int(EDITS * len(ws))))
            self.items.append(item)
            self.words.append([string(w) for w in ws])
            self.places.append(np.concatenate(([0], np.cumsum(lens))).tolist())
            if least < 1:
                half = -(-len(ws) // 2)
                self.short.append((k, ["".join(self.words[-1][i : i + half]) for i in range(len(ws) - half + 1)]))
            h = gram_hash(np.concatenate(ws))
            hashes.append(h)
            sides.append(np.full(len(h), k, np.int32))
            places.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.hashes, self.count_from, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.side = np.concatenate(sides)[order] if sides else np.zeros(0, np.int32)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int32)
        self.bound, self.wide = np.array(bounds, np.int64), np.array(wide, np.int64)
        #: where the hashes of each bucket, by their first bits, begin
        self.bucket = np.searchsorted(self.hashes >> np.uint32(32 - BUCKETS), np.arange((1 << BUCKETS) + 1)).astype(np.int32)
        self.fullest = int(np.diff(self.bucket).max()) if len(self.hashes) else 0
        self.longest = max((p[-1] for p in self.places), default=0)

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text whose q-gram an item has, and the gram's slot."""
        top = h >> np.uint32(32 - BUCKETS)
        at = np.flatnonzero(self.bucket[top + np.uint32(1)] > self.bucket[top])
        slot, end, mine = self.bucket[top[at]], self.bucket[top[at] + np.uint32(1)], h[at]
        found_at, found = [], []
        for _ in range(self.fullest):
            same = self.hashes[slot] == mine
            found_at.append(at[same])
            found.append(slot[same])
            slot = slot + 1
            more = ~same & (slot < end)
            at, slot, end, mine = at[more], slot[more], end[more], mine[more]
            if not len(at):
                break
        return np.concatenate(found_at), np.concatenate(found)

    def bands(self, c: Compact) -> Iterator[tuple[int, int, int, int]]:
        """(text, side, first and last diagonal) of neighbouring bands that reach their side's bound; a diagonal counts from the text's start."""
        if len(c.codes) < Q or not len(self.hashes):
            return
        h = gram_hash(c.codes)
        at, slot = self.shared(h)
        text = np.searchsorted(c.first, at, "right") - 1
        inside = at + Q <= c.last[text]
        at, slot, text = at[inside], slot[inside], text[inside]
        n = self.count[slot]
        if not n.sum():
            return
        rows = np.repeat(self.count_from[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        side = self.side[rows].astype(np.int64)
        # texts lie so far apart that no band reaches from one to the next
        apart = self.longest + 4 * int(self.wide.max()) + 1
        gap = np.repeat(text, n) * apart + apart
        diagonal = np.repeat(at, n) - self.place[rows] + gap
        # each diagonal lies in two overlapping bands, each twice as wide as the edits can move the alignment
        key = side << 40 | diagonal // self.wide[side]
        key, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        good = count >= self.bound[key >> 40]
        key = key[good]
        if not len(key):
            return
        groups = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        for a, b in zip(key[groups].tolist(), key[np.append(groups[1:], len(key)) - 1].tolist()):
            side = a >> 40
            w = int(self.wide[side])
            low, high = (a & (1 << 40) - 1) * w, ((b & (1 << 40) - 1) + 2) * w
            # the text: the one whose stretch of diagonals holds the band's middle
            t = int(np.searchsorted(c.first + np.arange(1, len(c.first) + 1) * apart, low + w + self.longest, "right")) - 1
            shift = int(c.first[max(t, 0)]) + (max(t, 0) + 1) * apart
            yield max(t, 0), side, low - shift, high - shift

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(text, item, largest share of its words in a passage) for each item that leaks into a text."""
        c = Compact([t or "" for t in texts])
        out: dict[tuple[int, int], float] = {}
        strings: dict[int, str] = {}
        for t, side, low, high in self.bands(c):
            a, b = int(c.first[t]), int(c.last[t])
            if t not in strings:
                strings = {t: string(c.codes[a:b])}
            share = passage(self.words[side], self.places[side], strings[t], c.word[a:b], low, high)
            if share >= SHARE:
                out[t, self.items[side]] = max(out.get((t, self.items[side]), 0.0), share)
        for t in range(len(texts)) if self.short else ():
            a, b = int(c.first[t]), int(c.last[t])
            doc = string(c.codes[a:b])
            for side, forms in self.short:
                if any(f in doc for f in forms):
                    share = passage(self.words[side], self.places[side], doc, c.word[a:b], -self.longest, len(doc))
                    if share >= SHARE:
                        out[t, self.items[side]] = max(out.get((t, self.items[side]), 0.0), share)
        return [(t, item, share) for (t, item), share in sorted(out.items())]


def runs_of(words: list[str], places: list[int], doc: str, spaced: np.ndarray, low: int, high: int) -> list[tuple[int, int, list[int], int]]:
    """Longest runs of the item's words that stand in the document one after the other, within the band: first and last word, the place of
    each, and the end. A single short word counts where the document has it as a word of its own."""
    margin = 2 * MOVE
    open_at: dict[int, tuple[int, list[int]]] = {}  # runs that end with the word before: by their end
    out = []
    for i, w in enumerate([*words, ""]):
        now: dict[int, tuple[int, list[int]]] = {}
        if w:
            stop = max(0, places[i] + high + margin + len(w))
            p = doc.find(w, max(0, places[i] + low - margin), stop)
            while p >= 0:
                first, at = open_at.pop(p, (i, []))
                at.append(p)
                now[p + len(w)] = first, at
                p = doc.find(w, p + 1, stop)
        for end, (first, at) in open_at.items():
            a = at[0]
            apart = (a == 0 or spaced[a - 1] != spaced[a]) and (end == len(doc) or spaced[end - 1] != spaced[end])
            if i - 1 > first or end - a >= Q or apart:
                out.append((first, i - 1, at, end))
        open_at = now
    return out


def passage(words: list[str], places: list[int], doc: str, spaced: np.ndarray, low: int, high: int) -> float:
    """Largest share of an item's words in a passage of the document between two diagonals that keeps the edit budget.

    Runs of the item's words in the document are joined to paths. Between two of them lie words of the item that are missing or changed
    and words of the document that are changed or added; the larger number is the cost. For each run and each cost up to the budget the path
    that begins earliest is kept. Where two runs overlap, the second is entered behind the first."""
    n = len(words)
    budget = int(EDITS * n)
    runs = sorted(runs_of(words, places, doc, spaced, low, high), key=lambda r: (r[1], r[3]))
    lasts = [r[1] for r in runs]
    firsts: list[np.ndarray] = []
    costs = np.arange(budget + 1)
    best = 0
    for r, (first, last, at, end) in enumerate(runs):
        mine = np.full(budget + 1, first)
        for j in range(bisect_left(lasts, first - 1 - budget), bisect_left(lasts, last)):
            _, last0, at0, end0 = runs[j]
            if end0 >= end:
                continue
            t = max(0, last0 + 1 - first)
            while t < len(at) and at[t] < end0:
                t += 1
            if t == len(at):
                continue
            cost = first + t - last0 - 1
            if at[t] > end0:
                cost = max(cost, int(spaced[at[t] - 1]) - int(spaced[end0]) + 1)
            if cost <= budget:
                np.minimum(mine[cost:], firsts[j][: budget + 1 - cost], out=mine[cost:])
        firsts.append(mine)
        size = last - mine + 1
        kept = size[costs <= EDITS * size + 1e-9]
        if len(kept):
            best = max(best, int(kept.max()))
    return best / n


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items' sides in blocks of about BLOCK characters. The driver reads the set partition by partition and holds one block."""
    rows = items.select("item_id", "source", "target").dropna(subset=["item_id"]).distinct().orderBy("item_id")
    block: list[tuple[int, str | None]] = []
    size = 0
    for r in rows.toLocalIterator():
        for text in (r["source"], r["target"]):
            block.append((r["item_id"], text))
            size += len(text or "")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and the share of the item's words in the longest passage. One pass over the documents for each block of items."""
    spark = documents.sparkSession
    fields = documents.select("doc_id", "text")
    schema = "doc_id bigint, item_id bigint, share double"
    out = None
    for block in blocks(items):
        sent = spark.sparkContext.broadcast(Index(block))

        def make(sent=sent):
            index = sent.value

            def work(ids, texts):
                found = index.leaks(texts)
                return {"doc_id": [ids[t] for t, _, _ in found], "item_id": [i for _, i, _ in found], "share": [s for _, _, s in found]}

            return work

        part = map_rows(fields, make, schema, text=1)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def p7_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and the items that leaked into them."""
    return leaked(documents, items).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item, the documents it leaked into and the largest share of its words found."""
    return leaked(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 4).alias("share"))
