"""Problem 7: passages of evaluation items inside training documents.

Winnowing keeps, of every window of k-gram hashes, the least one, in the items and in the documents alike, so any run
of ``K + WINDOW - 1`` equal words leaves a common fingerprint.  With a window of one every word pair is kept, as changes
and foreign sentences together may leave no longer runs.  Of a passage part of n words with c changes and b sentence
ends inside, n - c words are left in at most c + 1 + b runs within sentences, so at least n - 2 c - 1 - b pairs: no
fewer than ``PAIRS - b`` among ``REACH`` words.  Therefore a document that has so many has one of the rarest of them:
only those are looked up, the common pairs are never (see :class:`LeakFinder`).  What has enough pairs is extended in
two exact steps: longest common subsequences of all windows of a passage at once drop what can't be a part, then the
fewest changes of an alignment decide whether 15 words of the passage stand there in order with at most a fifth
changed, dropped or added.  Whole sentences of the document between the passage's sentences are no change.

The items are the small side.  Their size is checked: one block of at most ``BLOCK_BYTES`` is indexed once and
broadcast.  More blocks take one pass over the documents that keeps those with a rare pair of any item, by a bitmap of
fixed size; only these are met by the blocks, one after the other.
"""

from __future__ import annotations

import html
import math
import re as stdlib_re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import cut, spread

#: Words in a k-gram and k-grams in a window: every run of two equal words is found.
K, WINDOW = 2, 1
#: Words of the passage that must be there, and the share of them that may be changed, dropped or added.
MIN_WORDS, MAX_CHANGED = 15, 0.2
#: 12 of 15 words left by 3 changes lie in at most 4 runs, and in one more for each sentence end: pairs without sentence ends, and the least asked for.
PAIRS, MIN_PAIRS = 8, 2
#: Passage words among which so many pairs must begin.
REACH = 20
#: Words of the passage that a part beside foreign sentences has at least: single words stand in any text.
MIN_PART = 2
#: A part of at least 15 words, a fifth of them changed at most, holds a window of 15, 20 or 25 words of which four fifths are left.
WINDOWS = ((15, 12), (20, 16), (25, 20))
#: Of a window of 25 words of which 20 are left, 10 are left of some 15 at the least; so, too, of one of 20 words.
LEAST_COMMON = 10
#: Words of the document within which pairs of one of the passage's sentences stand: as many as within reach, and some added.
CLOSE = REACH + 6
#: Of the pairs needed, so many are looked up: more name fewer items in vain, fewer leave out more of the common pairs.
PROBES = 4
#: A part of 36 words or more, cut after 18, has a part in one of the pieces: its changes are few enough there, too.
LONGEST = 35
#: Windows' starts of a passage whose subsequences are found together.
LANES = 128
#: Cells that one step of the alignments holds.
CELLS = 1 << 20
#: Most bytes of passages broadcast at once, and bits of the map of all items' rare pairs.
BLOCK_BYTES, MAP_BITS = 8 << 20, 1 << 27

_MARKUP = re.compile(r"<[^<>]+>|\[\d+\]|&(?:[a-zA-Z]+|#\d+);")
_SPLIT_WORD = re.compile(r"(?<=\p{L})[-­]\s*\n\s*(?=\p{Ll})")
_WORD = re.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+(?:'\p{L}+)?")
#: The same for plain text in ASCII.
_ASCII_WORD = stdlib_re.compile(r"[0-9]+(?:\.[0-9]+)*|[a-z]+(?:'[a-z]+)?")
_GROUPED = re.compile(r"(?<=\p{N}),(?=\p{N})")
_SENTENCE_END = re.compile(r"[.!?;:।]+(?=\s|$)|\n")
_BREAK = re.compile(r"[.!?;:।…\n]")
_FAR = np.int16(1 << 12)


def _plain(text: str) -> str:
    if "<" in text or "[" in text or "&" in text:
        text = _MARKUP.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else " ", text)
    if "\n" in text:
        text = _SPLIT_WORD.sub("", text)
    if "," in text:
        text = _GROUPED.sub("", text)
    return text.lower().replace("’", "'")


def words_of(text: str) -> list[str]:
    """Words in lower case; layout, punctuation, commas in numbers and markup dropped."""
    return _words(_plain(text))


def _words(plain: str) -> list[str]:
    return (_ASCII_WORD if plain.isascii() else _WORD).findall(plain)


def _breaks(plain: str) -> np.ndarray:
    """After which of the words a sentence may end; in a text that shows no ends, after any."""
    spans = [m.span() for m in _WORD.finditer(plain)]
    stops = np.array([m.start() for m in _BREAK.finditer(plain)], dtype=np.int64)
    after = np.searchsorted(stops, [b for _, b in spans])
    before = np.searchsorted(stops, [*(a for a, _ in spans[1:]), len(plain)][: len(spans)])
    breaks = before > after
    if not breaks[:-1].any():
        breaks[:] = True
    return breaks


def _ids(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _kgrams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    if len(ids) < k:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = (out ^ ids[j : len(ids) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least hash of each window of ``window`` consecutive ones, each kept once; of fewer, the least one."""
    if len(hashes) <= window:
        return hashes[:0] if not len(hashes) else np.array([hashes.min()])
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1))


class _Item:
    """A passage: its words, the ends of its sentences, its word pairs within sentences with their places."""

    def __init__(self, key: object, passage: str) -> None:
        self.key = key
        ids, ends = [], set()
        for sentence in _SENTENCE_END.split(passage):
            ids += _ids(words_of(sentence)).tolist()
            ends.add(len(ids) - 1)
        self.ids = np.array(ids, dtype=np.uint64)
        self.end = np.isin(np.arange(len(ids)), list(ends))
        self.places = np.flatnonzero(~self.end[:-1]) if len(ids) else np.empty(0, np.int64)  # no pair over a sentence end: foreign text may stand there
        self.pairs = _kgrams(self.ids, K)[self.places]
        self.needed, self.close = self._needed()
        self.pairs_sorted = np.unique(self.pairs)
        self._words = np.unique(self.ids)
        self._lanes: dict[int, list[tuple[dict[int, int], int, list[tuple[int, int]]]]] = {}

    def _needed(self) -> tuple[np.ndarray, int]:
        """How many pairs are asked for among the ``REACH`` words from each pair's place, and how many close together wherever a part is.

        With b sentence ends inside, the pairs lie in b + 1 places of the document: the most at one place are no fewer
        than their share.
        """
        ends = np.concatenate(([0], np.cumsum(self.end)))
        at = lambda x: ends[np.clip(x, 0, len(self.end))]
        # a part may begin half a reach before its first pair
        inside = at(self.places + REACH) - at(self.places - REACH // 2)
        share = -(-np.maximum(1, PAIRS - inside) // (inside + 1))
        return np.maximum(MIN_PAIRS, PAIRS - inside), int(share.min(initial=1 << 30))

    def rare(self, common: np.ndarray) -> np.ndarray:
        """Which pairs are looked up, by how common each is: of ``n`` pairs within reach of which ``t`` are needed, all but the ``t - PROBES`` most common.

        A part then has ``PROBES`` of them, or all that are needed if those are fewer.
        """
        keep = np.zeros(len(self.pairs), bool)
        until = np.searchsorted(self.places, self.places + REACH)
        for k, (stop, t) in enumerate(zip(until.tolist(), self.needed.tolist(), strict=True)):
            rarest = np.argsort(common[k:stop], kind="stable")[: max(0, stop - k - max(0, t - PROBES))]
            keep[k + rarest] = True
        return keep

    def lanes(self, length: int) -> list[tuple[dict[int, int], int, list[tuple[int, int]]]]:
        """For every ``LANES`` windows of ``length`` words: word to bits, all bits, and (first bit, start) of each window."""
        if length not in self._lanes:
            groups = []
            for first in range(0, len(self.ids) - length + 1, LANES):
                masks: dict[int, int] = {}
                windows = [((length + 1) * k, start) for k, start in enumerate(range(first, min(first + LANES, len(self.ids) - length + 1)))]  # a spare bit takes the carry
                for bit, start in windows:
                    for j, w in enumerate(self.ids[start : start + length].tolist()):
                        masks[w] = masks.get(w, 0) | 1 << (bit + j)
                groups.append((masks, sum(((1 << length) - 1) << bit for bit, _ in windows), windows))
            self._lanes[length] = groups
        return self._lanes[length]

    def may_be_in(self, vocabulary: np.ndarray) -> bool:
        """Has some window enough words among sorted distinct ones, in whatever order?"""
        there = np.concatenate(([0], np.cumsum(vocabulary[np.minimum(np.searchsorted(vocabulary, self.ids), len(vocabulary) - 1)] == self.ids)))
        return any((there[length:] - there[:-length] >= least).any() for length, least in WINDOWS)

    def likely_starts(self, words: np.ndarray) -> list[int]:
        """Starts of the windows that share enough words with ``words`` in order, the fullest first; none means there is no part.

        Longest common subsequences by bits, many windows in one number.
        """
        words = words[self._words[np.minimum(np.searchsorted(self._words, words), len(self._words) - 1)] == words]
        there = np.concatenate(([0], np.cumsum(np.isin(self.ids, words))))
        known, found = words.tolist(), []
        for length, least in WINDOWS:
            if not (there[length:] - there[:-length] >= least).any():
                continue
            most = 0
            for masks, every, windows in self.lanes(length):
                left = every
                for w in known:
                    if both := left & masks.get(w, 0):
                        left = ((left + both) | (left - both)) & every
                for bit, start in windows:
                    common = length - ((left >> bit) & ((1 << length) - 1)).bit_count()
                    most = max(most, common)
                    if common >= least:
                        found.append((common / length, -start))
            if most < LEAST_COMMON:  # then no longer window has enough either
                break
        return [-s for _, s in sorted(found, reverse=True)]


Pair = tuple[np.ndarray, np.ndarray, _Item]  # a document's words, its sentence ends, item


def contains(pairs: list[Pair], starts: list[list[int]]) -> np.ndarray:
    """Is a part of the item there that begins at one of the passage's ``starts``?  One answer a pair, exact.

    Fewest changes of alignments that begin with a word that is there, all starts of all pairs at once; steps go along
    the passages' words, columns are the documents'.  A part of w words that ends in a word that is there may have
    ``MAX_CHANGED`` w changes.  After a sentence of the passage an alignment goes on at any later place: without a
    change if whole sentences of the document are passed over, with one otherwise, and with at least ``MIN_PART`` words
    of the passage on either side.
    """
    owner = np.repeat(np.arange(len(pairs)), [len(s) for s in starts])
    begin = np.array([a for some in starts for a in some], dtype=np.int64)
    found = np.zeros(len(pairs), bool)
    if not len(begin):
        return found
    n, m = max(len(d) for d, _, _ in pairs), max(len(i.ids) for _, _, i in pairs)
    docs, breaks = np.zeros((len(pairs), n), np.uint64), np.zeros((len(pairs), n), bool)
    passages, ends = np.ones((len(pairs), m + 1), np.uint64), np.zeros((len(pairs), m + 1), bool)
    lengths = np.array([len(i.ids) for _, _, i in pairs])
    for r, (doc, stops, item) in enumerate(pairs):
        docs[r, : len(doc)], breaks[r, : len(doc)], passages[r, : len(item.ids)], ends[r, : len(item.ids)] = doc, stops, item.ids, item.end
    at = np.arange(n, dtype=np.int16) if n < 1 << 14 else np.arange(n, dtype=np.int32)
    few, there = np.full((len(owner), n), _FAR, at.dtype), docs[owner]
    few[there == passages[owner, begin][:, None]] = 0
    few = np.minimum.accumulate(few - at, axis=1) + at
    since = np.zeros(len(owner), np.int64)  # words since the last sentence end
    stayed, jumped = few, np.zeros(len(owner), bool)  # before a jump just made
    for step in range(1, min(m, LONGEST)):
        live = (begin + step < lengths[owner]) & ~found[owner] & (few.min(axis=1) <= MAX_CHANGED * np.minimum(lengths[owner] - begin, LONGEST))
        if not live.any():
            break
        if not live.all():
            owner, begin, few, there, since, stayed, jumped = (x[live] for x in (owner, begin, few, there, since, stayed, jumped))
        i = begin + step
        equal = there == passages[owner, i][:, None]
        if step + 1 >= MIN_WORDS:
            # a jump just made leaves one word after it: too few, so the part must have gone on without it
            last = np.where(jumped[:, None], stayed, few)[:, :-1]
            done = (equal[:, 1:] & (last <= MAX_CHANGED * (step + 1) + 1e-6)).any(axis=1)
            found[owner[done]] = True
        changed = few + at.dtype.type(1)
        diagonal = few[:, :-1] + ~equal[:, 1:]
        changed[:, 1:] = np.minimum(changed[:, 1:], diagonal)
        few = np.minimum.accumulate(changed - at, axis=1) + at  # words added in the document
        since += 1
        stop = ends[owner, i]
        jumped = stop & (since + 1 >= MIN_PART) & (i + 1 < lengths[owner])
        stayed = few
        if jumped.any():
            best = np.minimum.accumulate(few, axis=1)
            whole = np.minimum.accumulate(np.where(breaks[owner], few, _FAR), axis=1)
            over = np.minimum(best[:, :-1] + at.dtype.type(1), np.where(breaks[owner][:, 1:], whole[:, :-1], _FAR))
            few = few.copy()
            few[:, 1:] = np.where(jumped[:, None], np.minimum(few[:, 1:], over), few[:, 1:])
        since[stop] = -1
        few = np.minimum(few, _FAR)
    return found


def _contained(pairs: list[Pair], starts: list[list[int]]) -> np.ndarray:
    """:func:`contains`; of a pair too large for ``CELLS``, some starts at a time."""
    step = max(1, CELLS // len(pairs[0][0]))
    if len(pairs) > 1 or len(starts[0]) <= step:
        return contains(pairs, starts)
    return np.array([any(contains(pairs, [starts[0][i : i + step]])[0] for i in range(0, len(starts[0]), step))])


class LeakFinder:
    """The items of one block with their rare pairs by hash; built once, then broadcast.

    A pair is the rarer the fewer places it has in the block.  Of the pairs that a part must have in common with a
    document, only the rarest have postings; all of an item's pairs are counted for the items that these name.
    """

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self._items = [x for k, p in items if len((x := _Item(k, p)).ids) >= MIN_WORDS]
        pairs = np.concatenate([np.empty(0, np.uint64), *(x.pairs for x in self._items)])
        _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        common = counts[inverse]
        # all items one after the other, so far apart that no reach meets two
        self._starts = np.cumsum([0, *(len(x.ids) + REACH for x in self._items)])
        places = np.concatenate([np.empty(0, np.int64), *(a + x.places for a, x in zip(self._starts, self._items))])
        self._needed = np.zeros(self._starts[-1] + 1, np.int16)
        self._needed[places] = np.concatenate([np.empty(0, np.int64), *(np.minimum(PROBES, x.needed) for x in self._items)])
        keep, start = np.zeros(len(pairs), bool), 0
        for x in self._items:
            keep[start : start + len(x.pairs)] = x.rare(common[start : start + len(x.pairs)])
            start += len(x.pairs)
        order = np.argsort(pairs[keep], kind="stable")
        self._places = places[keep][order]
        self.prints, self._first = np.unique(pairs[keep][order], return_index=True)
        self._first = np.append(self._first, len(order))

    def _named(self, grams: np.ndarray) -> np.ndarray:
        """Items with enough rare pairs within reach among sorted distinct ``grams``."""
        if not len(grams) or not len(self.prints):
            return np.empty(0, np.int64)
        known = np.minimum(np.searchsorted(self.prints, grams), len(self.prints) - 1)
        known = known[self.prints[known] == grams]
        counts = self._first[known + 1] - self._first[known]
        places = np.sort(self._places[np.arange(counts.sum()) + np.repeat(self._first[known] - np.cumsum(counts) + counts, counts)])
        near = np.searchsorted(places, places + REACH) - np.arange(len(places))
        return np.unique(np.searchsorted(self._starts, places[near >= self._needed[places]], side="right") - 1)

    def _candidates(self, text: str) -> list[tuple[Pair, list[int]]]:
        """(the document's words, its sentence ends, item) of the items that may be in ``text``, with likely starts."""
        plain = _plain(text)
        ids = _ids(_words(plain))
        grams = _kgrams(ids, K)
        distinct, breaks, out = np.unique(grams), None, []
        named = self._named(distinct).tolist()
        vocabulary = np.unique(ids) if named else ids
        for i in named:
            item = self._items[i]
            if not item.may_be_in(vocabulary):
                continue
            there = distinct[np.minimum(np.searchsorted(distinct, item.pairs), len(distinct) - 1)] == item.pairs
            places = item.places[there]
            near = np.searchsorted(places, places + REACH) - np.arange(len(places))
            if not (near >= item.needed[there]).any():
                continue
            # foreign text of any length may stand between a part's sentences, but some of its pairs stand close together
            where = np.flatnonzero(item.pairs_sorted[np.minimum(np.searchsorted(item.pairs_sorted, grams), len(item.pairs_sorted) - 1)] == grams)
            if not (where[item.close - 1 :] - where[: len(where) - item.close + 1] < CLOSE).any():
                continue
            if starts := item.likely_starts(ids):
                breaks = _breaks(plain) if breaks is None else breaks
                out.append(((ids, breaks, item), starts))
        return out

    def find(self, texts: list[str]) -> list[list[object]]:
        """For each text the keys of the items that it contains."""
        found: list[list[object]] = [[] for _ in texts]
        open_ = [(k, pair, starts) for k, text in enumerate(texts) for pair, starts in self._candidates(text)]
        # the fullest window's start nearly always decides; where it doesn't, every start is tried
        for first in (True, False):
            todo = [(k, p, starts[:1] if first else list(range(len(p[2].ids) - MIN_WORDS + 1))) for k, p, starts in open_]
            order = sorted(range(len(todo)), key=lambda x: len(todo[x][1][0]))
            left, block, rows = [], [], 0
            for x in [*order, None]:
                if block and (x is None or (rows + len(todo[x][2])) * len(todo[x][1][0]) > CELLS):
                    for y, yes in zip(block, _contained([todo[b][1] for b in block], [todo[b][2] for b in block]), strict=True):
                        if yes:
                            found[todo[y][0]].append(todo[y][1][2].key)
                        else:
                            left.append(open_[y])
                    block, rows = [], 0
                if x is not None:
                    block.append(x)
                    rows += len(todo[x][2])
            open_ = left
        return found


def _with_rare_pairs(corpus: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """The documents with a rare pair of any block's items: one pass, by a bitmap whose size doesn't grow.

    ``known`` has blocks; each sets the bits of its items' rare pairs in turn, so no more than one block is held.
    """
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for b in range(known.agg(F.max("block")).first()[0] + 1):
        finder = LeakFinder([(r.item, r.passage) for r in known.filter(F.col("block") == b).select("item", "passage").toLocalIterator()])
        at = (finder.prints >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = corpus.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = shared.value
        for batch in batches:
            keep = []
            for text in batch["text"]:
                at = (_kgrams(_ids(words_of(text)), K) >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)
                keep.append(bool((some[at >> 3] >> (at & 7).astype(np.uint8) & 1).any()))
            yield batch[keep]

    return cut(spread(corpus).mapInPandas(run, f"doc {kind}, text string"))


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_key, item_key) of each document that contains a passage of an item, fully or in part.

    Null or short texts and passages (under ``MIN_WORDS`` words) match nothing; equal items are each reported; repeated
    documents give repeated rows; an empty table on either side gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    known = items.select(F.col(item_key).alias("item"), F.col(passage).alias("passage")).filter("item is not null and passage is not null").distinct()
    total = known.agg(F.coalesce(F.sum(F.octet_length("passage") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    corpus = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    if blocks > 1:
        known = cut(known.withColumn("block", F.pmod(F.xxhash64("item", "passage"), F.lit(blocks))))
        corpus = _with_rare_pairs(corpus, known, kinds[0])
    out = None
    for b in range(blocks):
        block = known.filter(F.col("block") == b) if blocks > 1 else known
        shared = spark.sparkContext.broadcast(LeakFinder([(r.item, r.passage) for r in block.select("item", "passage").toLocalIterator()]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, i) for d, some in zip(batch["doc"], shared.value.find(batch["text"].tolist()), strict=True) for i in some]
                yield pd.DataFrame(rows, columns=["doc", "item"])

        part = spread(corpus).mapInPandas(run, f"doc {kinds[0]}, item {kinds[1]}")
        if blocks > 1:  # one block after the other: no two are held at once
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))
