"""Evaluation texts that leak into training text.

Q-gram lemma filtering. Both sides are reduced to plain words; shared character
q-grams between documents and items are counted in overlapping bands of
diagonals. Diagonals are counted in words (words before the gram in the document
minus words before it in the item), so an edit moves what follows by one at most,
however long the word that was put in, and a band as wide as twice the edit
budget holds all of a passage. By the q-gram lemma a passage with the allowed
edits still shares a certain number of q-grams, so only regions that reach this
bound are kept; the bound is the least over all lengths that a passage may have.
Each region is verified by a banded alignment of words: from every run of equal
words that a passage must contain at least, the furthest reach to both sides for
each number of edits. The filter loses no passage, and the alignment is exact.

The items are the stated query set: their index is built once for each block of
bounded size and goes to the tasks as arrays; all documents pass by once per
block, reduced to words only once; no document meets another.

Defined results: null or empty texts leak nothing; an item of fewer than
``min_words`` words cannot leak; several ids of one text are each reported;
items with the same passage all count; null item texts are ignored; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

_INLINE = re.compile(r"</?(?:b|i|u|em|strong|code|span|a|mark|small|sub|sup|tt|font)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_JOIN = re.compile(r"[­​-‏⁠﻿*`~]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ASCII = re.compile(r"[a-z0-9]+")


def without_comments(text: str) -> str:
    """Markup comments of any length left out; what is never closed is text."""
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out += [text[at:a], " "]
        at = b + 3
    return "".join([*out, text[at:]])


def plain_words(text: str | None) -> list[str]:
    """The words of a text regardless of case, punctuation, layout and markup."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        if "<!--" in text:
            text = without_comments(text)
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        text = text.lower()
        if "*" in text or "`" in text or "~" in text:
            text = _JOIN.sub("", text)
        return _ASCII.findall(text)
    text = _JOIN.sub("", unicodedata.normalize("NFKC", text).casefold())
    return _WORD.findall(text)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q characters, by doubling."""
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = {1: codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)}
        mult = {1: base}
        n = 1
        while 2 * n <= q:
            h = power[n]
            power[2 * n] = h[:-n] * mult[n] + h[n:] if len(h) > n else h[:0]
            mult[2 * n] = mult[n] * mult[n]
            n *= 2
        out, have = None, 0
        for size in sorted(power, reverse=True):
            if q & size:
                if out is None:
                    out = power[size]
                else:
                    h = power[size][have:]
                    m = min(len(out), len(h))
                    out = out[:m] * mult[size] + h[:m]
                have += size
    return out ^ (out >> np.uint64(31))


def least_shared(sizes: np.ndarray, q: int, min_words: int, per_edit: int) -> int:
    """The fewest q-grams that a passage shares, over all its places and lengths: below twice ``min_words``, as a longer one holds a shorter.

    ``sizes``: the length of each word of the item and the space after it. An edit spoils the grams that touch a word.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    least = None
    for n in range(min_words, min(2 * min_words - 1, len(sizes)) + 1):
        e = n // per_edit
        windows = np.lib.stride_tricks.sliding_window_view(sizes, n)
        worst = np.sort(windows, axis=1)[:, n - e :].sum(axis=1) if e else 0
        b = int((total[n:] - total[:-n] - 1 - q + 1 - worst - e * (q - 1)).min())
        least = b if least is None else min(least, b)
    return 0 if least is None else least


class GramTable:
    """The q-grams of items, sorted, with the item and the number of words before each."""

    def __init__(self, q: int, keys: list[int], texts: list[str], need: list[int]):
        self.q, self.keys = q, np.array(keys, np.int64)
        self.need = np.array(need, np.int64)
        hashes, item, word = [], [], []
        for k, t in enumerate(texts):
            codes = _codes(t)
            h = gram_hashes(codes, q)
            hashes.append(h)
            item.append(np.full(len(h), k, np.int32))
            word.append(_words_before(codes)[: len(h)].astype(np.int32))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.word = h[order], np.concatenate(item)[order], np.concatenate(word)[order]
        self.shift = np.uint64(64 - max(16, int(16 * len(h)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.hash >> self.shift).astype(np.int64)] = True

    def bands(self, codes: np.ndarray, starts: np.ndarray, words: np.ndarray, step: int) -> list[tuple[int, int, int]]:
        """(text, item, first diagonal of the band) wherever the bound is reached; ``starts``: where each text begins."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        keep = n > 0
        at, lo, n = at[keep], lo[keep], n[keep]
        if not len(at):
            return []
        text = np.searchsorted(starts, at, "right") - 1
        rep = np.repeat(np.arange(len(at)), n)
        idx = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item = self.item[idx].astype(np.int64)
        diagonal = (words[at] - words[starts[text]])[rep] - self.word[idx]
        band = (diagonal + (1 << 30)) // step
        key = (text[rep].astype(np.int64) * len(self.keys) + item) << 32
        # every hit counts in the two bands that overlap there
        both, count = np.unique(np.concatenate([key + band, key + band - 1]), return_counts=True)
        pair = both >> 32
        full = count >= self.need[pair % len(self.keys)]
        return [
            (int(k) // len(self.keys), int(self.keys[int(k) % len(self.keys)]), int(x) * step - (1 << 30))
            for k, x in zip(pair[full], both[full] & 0xFFFFFFFF)
        ]


class ItemIndex:
    """A block of items: their q-grams by the length of q that suits them, and their words for the alignment."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 20, per_edit: int = 8, lengths: tuple[int, ...] = (20, 16, 12, 8, 6, 4, 2), enough: int = 12):
        self.min_words, self.per_edit = min_words, per_edit
        self.most = (2 * min_words - 1) // per_edit
        #: a passage with e edits has e + 1 runs of equal words at most, so one of them is at least this long
        self.seed = max(1, min(-(-(n - n // per_edit) // (n // per_edit + 1)) for n in range(min_words, 2 * min_words)))
        self.ids, self.words = [], []
        chosen: dict[int, list[tuple[int, int]]] = {}
        for i, t in items:
            w = plain_words(t)
            if len(w) < min_words:
                continue
            sizes = np.array([len(x) + 1 for x in w])
            for q in lengths:
                need = least_shared(sizes, q, min_words, per_edit)
                if need >= enough or q == lengths[-1]:
                    chosen.setdefault(q, []).append((len(self.ids), max(1, need)))
                    break
            self.ids.append(i)
            self.words.append(w)
        self.tables = [GramTable(q, [k for k, _ in x], [" ".join(self.words[k]) for k, _ in x], [n for _, n in x]) for q, x in sorted(chosen.items())]
        self._runs: dict[int, dict[tuple, list[int]]] = {}

    def candidates(self, texts: list[str]) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> first diagonals (in words) of the bands that reach the bound."""
        out: dict[tuple[int, int], list[int]] = {}
        if not self.tables or not texts:
            return out
        codes = _codes(SEPARATOR.join(texts))
        words = _words_before(codes)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        starts = np.minimum(starts, max(0, len(codes) - 1))
        for table in self.tables:
            for text, k, d in table.bands(codes, starts, words, max(1, self.most)) if len(codes) else ():
                out.setdefault((text, k), []).append(d)
        return out

    def _seeds(self, k: int) -> dict[tuple, list[int]]:
        """Where each run of as many words as a seed has begins in an item; made when the item is first met."""
        runs = self._runs.get(k)
        if runs is None:
            if len(self._runs) > 5000:
                self._runs.clear()
            runs = self._runs[k] = {}
            w = self.words[k]
            for i in range(len(w) - self.seed + 1):
                runs.setdefault(tuple(w[i : i + self.seed]), []).append(i)
        return runs

    def verify(self, doc: list[str], k: int, diagonals: list[int]) -> bool:
        item, n = self.words[k], self.seed
        runs = self._seeds(k)
        width = 2 * max(1, self.most)
        done: set[tuple[int, int]] = set()  # (diagonal, end in the item) of runs tried
        last = -1
        for d in sorted(diagonals):
            lo, hi = max(0, d, last), min(len(doc), d + width + len(item))
            for j in range(lo, hi - n + 1):
                for i in runs.get(tuple(doc[j : j + n]), ()):
                    if i and j and item[i - 1] == doc[j - 1] and j > lo:
                        continue  # not where its run begins
                    if self._passage(item, doc, i, j, done):
                        return True
            last = max(last, hi - n + 1)
        return False

    def _passage(self, item: list[str], doc: list[str], i: int, j: int, done: set) -> bool:
        """Whether the run of equal words at (i, j) lies in a passage."""
        while i and j and item[i - 1] == doc[j - 1]:
            i, j = i - 1, j - 1
        end = i
        while end < len(item) and end - i + j < len(doc) and item[end] == doc[end - i + j]:
            end += 1
        if (j - i, end) in done:
            return False
        done.add((j - i, end))
        if end - i >= self.min_words:
            return True
        right = furthest(item, doc, end, end - i + j, 1, self.most)
        left = furthest(item, doc, i - 1, j - 1, -1, self.most)
        for a, x in enumerate(left):
            for b, y in enumerate(right[: self.most + 1 - a]):
                words = x + y + end - i
                if words >= self.min_words and (a + b) * self.per_edit <= words:
                    return True
        return False


def furthest(item: list[str], doc: list[str], i: int, j: int, way: int, most: int) -> list[int]:
    """For each number of edits up to ``most``, how many words of the item can be passed from (i, j), in one direction."""
    n = len(item) - i if way > 0 else i + 1
    m = len(doc) - j if way > 0 else j + 1
    out = []
    reach: dict[int, int] = {}
    for e in range(most + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):  # words of the document passed minus words of the item
            x = 0 if e == 0 else max(reach.get(d, -9) + 1, reach.get(d + 1, -9) + 1, reach.get(d - 1, -9))
            x = min(x, n)
            if x < 0 or x + d < 0:
                continue
            if x + d > m:
                x = m - d
                if x < 0:
                    continue
            while x < n and x + d < m and item[i + way * x] == doc[j + way * (x + d)]:
                x += 1
            new[d] = x
        reach = new
        out.append(max(new.values(), default=0))
    return out


SEPARATOR = "\x00"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words_before(codes: np.ndarray) -> np.ndarray:
    """The number of spaces before each character."""
    space = (codes == 32) | (codes == 0)
    return np.cumsum(space) - space


def _slices(column: pa.Array, chars: int = 1_000_000) -> Iterator[tuple[int, list]]:
    """Texts in a few at a time, by their length."""
    begin, texts, n = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py()
        texts.append(t)
        n += len(t or "")
        if n >= chars or len(texts) >= 512:
            yield begin, texts
            begin, texts, n = i + 1, [], 0
    if texts:
        yield begin, texts


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in _slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array([" ".join(plain_words(t)) for t in texts], pa.string())], names=["doc_id", "text"])


def _search(index, plain: bool):
    """``index``: a broadcast ItemIndex; ``plain``: whether the texts are reduced to words already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            for lo, texts in _slices(batch.column(1)):
                docs = [(t or "").split(" ") if plain else plain_words(t) for t in texts]
                found = items.candidates([" ".join(w) for w in docs])
                hits = [(lo + d, items.ids[k]) for (d, k), diagonals in found.items() if items.verify(docs[d], k, diagonals)]
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([d for d, _ in hits])).cast(pa.int64()), pa.array([i for _, i in hits], pa.int64())],
                        names=["doc_id", "item_id"],
                    )

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, min_words: int = 20, per_edit: int = 8, block_chars: int = 2_000_000
) -> DataFrame:
    """One row per document and item whose text it holds in part: doc_id, item_id.

    ``block_chars`` bounds the item text whose index is sent to the tasks at once; more items make more passes.
    """
    stated = items.where("item_text is not null").select(F.col("item_id").cast("bigint"), F.col("item_text").cast("string"))
    chars = stated.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    if blocks > 1:
        texts = stage(texts.mapInArrow(_normalise, "doc_id bigint, text string"), "words")
    out = None
    for b in range(blocks):
        # bounded: a block holds about block_chars characters
        block = [tuple(r) for r in (stated if blocks == 1 else stated.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).collect()]
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex(block, min_words, per_edit))
        found = texts.mapInArrow(_search(index, blocks > 1), "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
