"""Passages of evaluation items inside documents.

Size-partitioned MinHash containment search.  Items are parted by the size of their sets of word shingles, and each part has
document windows of its own: items of up to six shingles meet windows of exactly their size, longer ones are cut into
windows of 16 words that meet windows of 32 words, so that a short passage is a large part of the window it stands in,
however long the document.  Windows that share a minimum under one of the hash functions are candidates.  A window can
only share one if it holds a shingle of an item, so documents are first searched for those, and minima are computed for
windows around them alone; nothing is lost by it.  Candidates are verified by exact containment: so many shingles of the
item stand in the window, and the words of the item are aligned with those of the document, where the aligned stretch must
be long and dense enough.

Items are a stated query set: they are taken in blocks of bounded size, each block against all documents.

Defined results: null and blank texts hold nothing; items of under nine words are found word for word (two changes in so
few leave no shingle), items of nine and more, but fewer than ``least``, as a whole with changes; an item that stands
twice in a document is reported once; repeated items and documents each count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 3
#: Words of a window, and how far the next begins: of an item, of a document.
ITEM_WINDOW, ITEM_STEP = 16, 4
DOC_WINDOW, DOC_STEP = 32, 8
HASHES = 48
#: Shingles that a stretch of 15 words still shares when two of its words are changed: 13 less 3 for each change.  Items
#: that have no more than that many less one are in parts of their own, one for each size.
MIN_SHARED = 7
#: What a changed, missing or added word costs where a matching one gains 1; so two stretches far apart stay two.
EDIT = 2
#: Items of a block; their sketch, about 40 MB for items of 60 words, goes to every executor.
BLOCK = 5000
_MERSENNE = (1 << 31) - 1
_WORD = re.compile(r"\w+")
_JOINT = re.compile(r"(?<=\w)[-‐‑­]\s*\n\s*(?=\w)|[­​‌‍⁠﻿'’`]")


def words(text: str) -> list[str]:
    """Words without case, accents kept; compatibility forms as usual letters, words cut at line ends joined."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_JOINT.sub("", text).lower().replace("_", " "))


class Sketch:
    """What is known of a block of items: vocabulary, shingles, minima of their windows."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words = [words(t) for t in texts]
        self.vocabulary: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        self.coded = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for w in self.words]
        shingles = [self.shingles(c) for c in self.coded]
        self.own = [frozenset(x.tolist()) for x in shingles]
        self.known = np.unique(np.concatenate([*(x for x in shingles if len(x) >= MIN_SHARED), np.zeros(0, np.int64)]))
        draw = np.random.default_rng(7)
        self.a = draw.integers(1, _MERSENNE, HASHES, dtype=np.int64)
        self.b = draw.integers(0, _MERSENNE, HASHES, dtype=np.int64)
        #: The part of the long items: of each hash function the minima in order and the items that have them.
        size = ITEM_WINDOW - SHINGLE + 1
        minima, of = [np.zeros((HASHES, 0), np.int64)], []
        #: The parts of the short ones: by number of words one number for the whole text.
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, s in enumerate(shingles):
            if len(s) < MIN_SHARED:
                if len(self.coded[i]):
                    short[len(self.coded[i])].append((self.whole(self.coded[i][None, :])[0], i))
                continue
            starts = {*range(0, max(1, len(s) - size + 1), ITEM_STEP), max(0, len(s) - size)}
            minima += [self.hashed(s[at : at + size]).min(axis=1)[:, None] for at in sorted(starts)]
            of += [i] * len(starts)
        table, of = np.concatenate(minima, axis=1), np.array(of, np.int32)
        order = np.argsort(table, axis=1, kind="stable")
        self.minima, self.of = np.take_along_axis(table, order, axis=1), of[order] if len(of) else np.zeros((HASHES, 0), np.int32)
        self.short = {n: dict(_grouped(x)) for n, x in sorted(short.items())}

    def whole(self, windows: np.ndarray) -> list[int]:
        """One number for each row of words; it says little alone, so what has it is compared word by word."""
        with np.errstate(over="ignore"):
            return (windows * self._weights(windows.shape[1])).sum(axis=1).tolist()

    @staticmethod
    def _weights(n: int) -> np.ndarray:
        return np.random.default_rng(n).integers(1, 1 << 62, n, dtype=np.int64) | 1

    def verbatim(self, coded: np.ndarray) -> set[int]:
        """The short items that stand in the document word for word."""
        found = set()
        for n, items in self.short.items():
            known = (coded != 0).astype(np.int64)
            runs = np.flatnonzero(np.convolve(known, np.ones(n, np.int64), "valid") == n) if len(coded) >= n else ()
            if len(runs):
                for at, code in zip(runs.tolist(), self.whole(coded[runs[:, None] + np.arange(n)])):
                    found.update(i for i in items.get(code, ()) if np.array_equal(self.coded[i], coded[at : at + n]))
        return found

    def shingles(self, coded: np.ndarray) -> np.ndarray:
        """One number for each run of SHINGLE words."""
        if len(coded) < SHINGLE:
            return np.zeros(0, np.int64)
        out = coded[: len(coded) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            out = out * self.base + coded[i : len(coded) - SHINGLE + 1 + i]
        return out

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles ^ (shingles >> 29)) % _MERSENNE
        return (self.a[:, None] * x[None, :] + self.b[:, None]) % _MERSENNE

    def candidates(self, coded: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item index to the (start, end) of the windows of a document that share a minimum with it."""
        s = self.shingles(coded)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # Words that no item holds are coded 0; shingles with one can't be known.
        maybe = coded != 0
        maybe = np.flatnonzero(np.logical_and.reduce([maybe[i : len(s) + i] for i in range(SHINGLE)]))
        place = np.searchsorted(self.known, s[maybe])
        hits = maybe[self.known[np.minimum(place, len(self.known) - 1)] == s[maybe]] if len(self.known) else maybe[:0]
        size = DOC_WINDOW - SHINGLE + 1
        if len(hits) < MIN_SHARED:
            return found
        before = np.searchsorted(hits, np.arange(0, len(s), DOC_STEP))
        after = np.searchsorted(hits, np.arange(0, len(s), DOC_STEP) + size)
        for k in np.flatnonzero(after - before >= MIN_SHARED).tolist():
            at = k * DOC_STEP
            inside = set(s[hits[before[k] : after[k]]].tolist())
            for i in self.sharing(self.hashed(s[at : at + size]).min(axis=1)):
                # Exact containment: so many shingles of the item stand in this window.
                if len(self.own[i] & inside) >= MIN_SHARED:
                    found[i].append((at, at + DOC_WINDOW))
        return found

    def sharing(self, minima: np.ndarray) -> set[int]:
        """The long items with a window that has one of these minima under the same hash function."""
        out: set[int] = set()
        for table, of, m in zip(self.minima, self.of, minima):
            low = np.searchsorted(table, m)
            if low < len(table) and table[low] == m:
                out.update(of[low : np.searchsorted(table, m, side="right")].tolist())
        return out


def _grouped(pairs: list[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def longest_passage(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """(words of the item, matched words) of the best aligned stretch: a match gains one, an edit costs EDIT.

    Row by row, as the dense alignment, but only where a stretch has a score; in most candidates few places have one.  Where
    these become many, the rest is aligned densely.
    """
    n = len(doc)
    places: dict[int, list[int]] = defaultdict(list)
    for j, w in enumerate(doc.tolist(), 1):
        places[w].append(j)
    best = (0, 0, 0)
    #: Place to (score, beginning, matches) where the score is positive.
    live: dict[int, tuple[int, int, int]] = {}
    for r, w in enumerate(item.tolist()):
        hits = places.get(w, ())
        if len(live) + len(hits) > 32 + n // 32:
            return _dense(item, doc, r, live, best)
        if not live and not hits:
            continue
        # A match scores one at least; without one a score goes on from the place before or from the row above.
        at = set(hits)
        for j, x in live.items():
            if x[0] > EDIT:
                at.add(j)
                if j < n:
                    at.add(j + 1)
        own, here = set(hits), []
        for j in sorted(at):
            last, above = live.get(j - 1), live.get(j)
            hit = j in own
            score, begin, match = last or (0, r, 0)
            score += 1 if hit else -EDIT
            if above and above[0] - EDIT > score:
                score, begin, match = above[0] - EDIT, above[1], above[2]
            else:
                match += hit
            if score > 0:
                here.append((j, score, begin, match))
        # Words added in the document: a score goes on to the right until none is left or another is better.
        live = {}
        for j, score, begin, match in here:
            if j in live and live[j][0] > score:
                continue
            live[j] = (score, begin, match)
            for to in range(j + 1, min(n, j + (score - 1) // EDIT) + 1):
                live[to] = (score - EDIT * (to - j), begin, match)
        if live:
            k = min(live, key=lambda j: (-live[j][0], j))
            if live[k][0] > best[0]:
                best = (live[k][0], r + 1 - live[k][1], live[k][2])
    return best[1], best[2]


def _dense(item: np.ndarray, doc: np.ndarray, row: int = 0, live: dict[int, tuple[int, int, int]] | None = None, best: tuple[int, int, int] = (0, 0, 0)) -> tuple[int, int]:
    """The same over all places, from a row of the item on, with the scores before it."""
    n = len(doc)
    score = np.zeros(n + 1, np.int64)
    begin = np.zeros(n + 1, np.int64)
    match = np.zeros(n + 1, np.int64)
    for j, x in (live or {}).items():
        score[j], begin[j], match[j] = x
    steps = np.arange(n + 1)
    for r, w in enumerate(item[row:], row):
        hit = doc == w
        diag = score[:-1] + np.where(hit, 1, -EDIT)
        up = score[1:] - EDIT
        take = diag >= up
        s = np.concatenate(([0], np.where(take, diag, up)))
        b = np.concatenate(([r + 1], np.where(take, np.where(score[:-1] > 0, begin[:-1], r), begin[1:])))
        m = np.concatenate(([0], np.where(take, np.where(score[:-1] > 0, match[:-1], 0) + hit, match[1:])))
        s, b, m = np.where(s > 0, s, 0), np.where(s > 0, b, r + 1), np.where(s > 0, m, 0)
        # Words added in the document: the running maximum of score and cost so far says where they began.
        reach = np.maximum.accumulate(s + EDIT * steps)
        source = np.maximum.accumulate(np.where(s + EDIT * steps == reach, steps, 0))
        gap = reach - EDIT * steps
        better = gap > s
        s, b, m = np.where(better, gap, s), np.where(better, b[source], b), np.where(better, m[source], m)
        score, begin, match = s, b, m
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), r + 1 - int(begin[k]), int(match[k]))
    return best[1], best[2]


def passages(sketch: Sketch, text: str | None) -> list[tuple[int, int, int]]:
    """(item, words, matched) for the items of which the text holds a stretch."""
    if not text:
        return []
    get = sketch.vocabulary.get
    coded = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
    out = [(sketch.ids[i], len(sketch.coded[i]), len(sketch.coded[i])) for i in sorted(sketch.verbatim(coded))]
    for i, windows in sketch.candidates(coded).items():
        best, at = (0, 0), 0
        while at < len(windows):
            # Windows that touch are one stretch of the document.
            low, high = windows[at]
            while at + 1 < len(windows) and windows[at + 1][0] <= high + ITEM_WINDOW:
                at += 1
                high = windows[at][1]
            best = max(best, longest_passage(sketch.coded[i], coded[max(0, low - ITEM_WINDOW) : high + ITEM_WINDOW]), key=lambda x: x[1])
            at += 1
        out.append((sketch.ids[i], *best))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: int = 15, density: float = 0.8) -> DataFrame:
    """(doc_id, item_id, words, matched) for documents that hold ``least`` or more consecutive words of an item."""
    spark = docs.sparkSession
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).filter(F.length(F.trim("t")) > 0).distinct()
    # Instructions are counted over all items, blocks taken afterwards.
    first = F.split(F.trim("t"), r"(?<=[.!?:])\s+")[0]
    shared = rows.withColumn("first", first).groupBy("first").agg(F.count_distinct("t").alias("n")).filter("n > 1").select("first")
    rows = rows.withColumn("first", first).join(shared.withColumn("shared", F.lit(True)), "first", "left")
    rows = rows.select("i", F.when(F.col("shared"), F.expr("ltrim(substring(ltrim(t), length(first) + 1))")).otherwise(F.col("t")).alias("t")).filter("t <> ''")
    blocks = max(1, -(-rows.count() // BLOCK))
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, words int, matched int"
    corpus = docs.select(doc_id, text).filter(F.col(text).isNotNull())
    out = None
    for k in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i").collect() if blocks > 1 else rows.orderBy("i").collect()
        held = spark.sparkContext.broadcast(Sketch([r["i"] for r in block], [r["t"] for r in block]))

        def search(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            sketch = held.value
            whole = {i: len(w) for i, w in zip(sketch.ids, sketch.words)}
            for part in parts:
                found = [(d, *p) for d, t in zip(part[doc_id], part[text]) for p in passages(sketch, t)]
                kept = [x for x in found if x[2] >= min(least, whole[x[1]]) and x[3] >= density * x[2]]
                yield pd.DataFrame(kept, columns=[doc_id, item_id, "words", "matched"])

        part = corpus.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out
