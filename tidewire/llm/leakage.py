"""Evaluation texts that leak into documents.

Method: spaced-seed hashing. Fixed masks pick some of a window's token positions and ignore the others, so
a window still hits where a word at an ignored position was altered. The hashes of the evaluation items
are joined to those of every window of every document (by sorted lookup); around each hit the overlap is
verified word by word, where a word may carry a slip (a small edit), be split or joined. Another word in a
word's place ends a run: template-like test items differ by just such words.

Reach: j joins and o slips or splits leave at least 12 - 2j - o words of twelve as they were, in at most j + o + 1
groups. While 3j + 2o < 11 some group holds two words, and the mask of two neighbours hits: three alterations of any
kind, and five slips or splits, wherever they lie. No pair of a document and an item is dropped unverified, but for
hits beside which no third word can match (``_extends``): a run of two words counts for nothing.

A document contains an item if an overlap covers at least ``min_words`` consecutive words of it, or its
overlaps together cover its whole text (``min_cover`` of its words), in any sentence order.

Tokens are runs of letters and digits, lower-cased, ё as е, Latin look-alikes inside Cyrillic words as the
Cyrillic letters, hyphenated line breaks joined.

Scale: one map over the documents, no shuffle of texts. The items are a stated query set: they go to the tasks in
blocks of at most ``BLOCK_TOKENS`` tokens, each block one pass, so their number is not limited by memory. A document
is read whole whatever its length; a document copied a million times is a million independent rows.

Defined results: null or empty texts and items give no row; an item of one or two words is found only as it stands,
word for word; repeated documents of one id give one row; ties do not arise; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TOKENS = 1_000_000
#: Offsets each mask looks at: two neighbours, or every other word of seven.
MASKS = ((0, 1), (0, 2, 4, 6))
WEIGHTS = np.array([len(m) for m in MASKS])
#: Words that may be joined into one, or parts that one may be split into.
PIECES = 4
#: Hits that touch no more words than this need a third one beside them.
MIN_TOUCHED = 2
WORD = re.compile(r"[^\W_]+")
# Latin letters that look like Cyrillic ones.
LOOKALIKE = str.maketrans("aceopxyëkmtbhu", "асеорхуекмтвни")
CYR = re.compile(r"[а-я]")
LATIN = re.compile(r"[a-zë]")
BROKEN = re.compile(r"(?<=\w)(?:-|‐|­)[ \t]*\n[ \t>]*(?=\w)")
INVISIBLE = re.compile("[­​‌‍⁠﻿̀́]")


def tokens(text: str) -> list[str]:
    if "\n" in text and ("-" in text or "­" in text or "‐" in text):
        text = BROKEN.sub("", text)
    if not unicodedata.is_normalized("NFKC", text) or INVISIBLE.search(text):
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower().replace("ё", "е")
    out = WORD.findall(text)
    if LATIN.search(text):
        out = [t.translate(LOOKALIKE) if not t.isascii() and LATIN.search(t) and CYR.search(t) else t for t in out]
    return out


def near(a: str, b: str) -> bool:
    """Equal but for a slip: one edit (or swap) in words of four letters or more, two in words of nine or more."""
    if a == b:
        return True
    n, m = len(a), len(b)
    short = n if n < m else m
    if short < 4 or n - m > 2 or m - n > 2:
        return False
    # Different at both ends: two edits at least.
    ends = (a[0] != b[0] and a[:2] != b[1::-1]) + (a[-1] != b[-1] and a[-2:] != b[:-3:-1])
    limit = 1 if short < 9 else 2
    if ends > limit or n - m > limit or m - n > limit or a.isdigit() or b.isdigit():
        return False
    if limit == 2 and len(set(a) ^ set(b)) > 4:
        return False
    # What differs lies between the common ends; longer than the edits allow, it is no slip.
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    if limit == 1 and max(n, m) - i > 2:
        return False
    a, b, n, m = a[i:n], b[i:m], n - i, m - i
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        now = [i] + [0] * m
        for j in range(1, m + 1):
            now[j] = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now) > limit:
            return False
        before, row = row, now
    return row[m] <= limit


def _steps(item: list[str], doc: list[str], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """(words of the item, words of the document) that match from (i, j) on, both included: one and one, joined, split, or with spaces moved."""
    a, b = item[i], doc[j]
    out = [(1, 1)] if near(a, b) else []
    if len(b) > len(a):  # joined in the document?
        k = 1
        while k < PIECES and len(a) < len(b) + 2 and 0 <= i + step * k < len(item):
            c = item[i + step * k]
            a = a + c if step > 0 else c + a
            k += 1
            if -3 < len(a) - len(b) < 3 and near(a, b):
                out.append((k, 1))
    elif len(a) > len(b):  # split in the document?
        k = 1
        while k < PIECES and len(b) < len(a) + 2 and 0 <= j + step * k < len(doc):
            c = doc[j + step * k]
            b = b + c if step > 0 else c + b
            k += 1
            if -3 < len(a) - len(b) < 3 and near(a, b):
                out.append((1, k))
    # Spaces moved: several words each, equal letter by letter.
    a, b, x, y = item[i], doc[j], 1, 1
    while len(a) != len(b) and ((a.startswith(b) or b.startswith(a)) if step > 0 else (a.endswith(b) or b.endswith(a))):
        if len(a) < len(b):
            if x == PIECES or not 0 <= i + step * x < len(item):
                break
            c = item[i + step * x]
            a, x = (a + c if step > 0 else c + a), x + 1
        else:
            if y == PIECES or not 0 <= j + step * y < len(doc):
                break
            c = doc[j + step * y]
            b, y = (b + c if step > 0 else c + b), y + 1
    if x > 1 < y and a == b:
        out.append((x, y))
    return out


def _walk(item: list[str], doc: list[str], i: int, j: int, step: int) -> tuple[int, list[tuple[int, int]]]:
    """How many words of the item match going on from (i, j), both included, in one direction, and the places passed.
    Where a word can be read in several ways (a slip, or joined with a short one), each is tried."""
    n, m, start, best = len(item), len(doc), i, 0
    seen: list[tuple[int, int]] = []
    known: set[tuple[int, int]] = set()
    todo: list[tuple[int, int]] = []
    while True:
        while 0 <= i < n and 0 <= j < m:
            seen.append((i, j))
            if item[i] == doc[j]:
                i, j = i + step, j + step
                continue
            ways = _steps(item, doc, i, j, step)
            if not ways:
                break
            for x, y in ways[1:]:
                to = (i + step * x, j + step * y)
                if to not in known:
                    known.add(to)
                    todo.append(to)
            x, y = ways[0]
            i, j = i + step * x, j + step * y
        best = max(best, (i - start) * step)
        if not todo:
            return best, seen
        i, j = todo.pop()


def verify(item: list[str], doc: list[str], hits: list[tuple[int, int]], min_words: int, min_cover: float) -> bool:
    covered: set[int] = set()
    done: set[tuple[int, int]] = set()
    for i, j in hits:
        if (i, j) in done:
            continue
        right, seen = _walk(item, doc, i, j, 1)
        left, _ = _walk(item, doc, i - 1, j - 1, -1)
        done.update(seen)  # hits this run explains need no second look
        if left + right >= min_words:
            return True
        if left + right >= 3:
            covered.update(range(i - left, i + right))
            if len(covered) >= min_cover * len(item):
                return True
    return False


#: Lengths that stand between texts: no word is near one.
OFF_ITEM, OFF_DOC = 1 << 20, 1 << 24


def _shape(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of words, and sets of their letters as bits."""
    bits = []
    for w in words:
        x = 0
        for c in w:
            x |= 1 << (ord(c) & 63)
        bits.append(x)
    return np.array([len(w) for w in words], np.int64), np.array(bits, np.uint64)


def _alike(la: np.ndarray, xa: np.ndarray, lb: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Whether words of these lengths and letters can be near (``near`` is stricter): an edit changes a length by one and two letters."""
    short = np.minimum(la, lb)
    limit = np.where(short < 9, 1, 2)
    return (la == lb) & (xa == xb) | (short >= 4) & (np.abs(la - lb) <= limit) & (np.bitwise_count(xa ^ xb) <= 2 * limit)


class Seeds:
    """The seed index of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = {k: tokens(t) for k, t in items}
        #: Items of one or two words have no third to verify by.
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k, ts in self.items.items():
            if 0 < len(ts) < 3:
                self.short.setdefault(tuple(ts), []).append(k)
        words = sorted({w for ts in self.items.values() for w in ts})
        self.vocab = {w: n + 1 for n, w in enumerate(words)}
        rng = np.random.default_rng(20_25)
        self.mix = rng.integers(1, 1 << 62, len(words) + 1, dtype=np.uint64)
        self.mix[0] = 0
        self.odd = [rng.integers(1, 1 << 62, len(m), dtype=np.uint64) | np.uint64(1) for m in MASKS]
        self.index = []
        ids = {k: np.array([self.vocab[w] for w in ts], np.int64) for k, ts in self.items.items()}
        for n, mask in enumerate(MASKS):
            hashes, owners, places = [], [], []
            for k, arr in ids.items():
                h, at = self._hash(arr, n)
                hashes.append(h)
                owners.append(np.full(len(at), k, np.int64))
                places.append(at)
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            self.index.append((h[order], np.concatenate(owners)[order] if hashes else h, np.concatenate(places)[order] if hashes else h))
        # All items in a row, with room between them.
        self.begins, flat, end = {}, [], 0
        for k, arr in ids.items():
            self.begins[k] = end + PIECES + 2
            end = self.begins[k] + len(arr)
            flat += [np.full(PIECES + 2, -1), arr - 1]
        self.flat = np.concatenate([*flat, np.full(PIECES + 2, -1)])
        length, letters = _shape([*words, ""])
        length[-1] = OFF_ITEM
        self.length, self.letters = length[self.flat], letters[self.flat]

    def _hash(self, arr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows whose looked-at words are all known, and where they begin."""
        mask = MASKS[n]
        size = len(arr) - mask[-1]
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(arr[:size])
        for off in mask[1:]:
            at = at[arr[at + off] > 0]
        h = np.zeros(len(at), np.uint64)
        for off, odd in zip(mask, self.odd[n]):
            h += self.mix[arr[at + off]] * odd
        return h, at

    def hits(self, arr: np.ndarray) -> np.ndarray:
        """Rows (document position, item, item position, mask); ``arr`` may hold many documents with gaps of zeros between."""
        out = []
        for n in range(len(MASKS)):
            h, at = self._hash(arr, n)
            keys, owners, places = self.index[n]
            if not len(h) or not len(keys):
                continue
            lo = np.searchsorted(keys, h, "left")
            some = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
            if not len(some):
                continue
            lo, at = lo[some], at[some]
            n_each = np.searchsorted(keys, h[some], "right") - lo
            x = np.repeat(lo - np.r_[0, np.cumsum(n_each)[:-1]], n_each) + np.arange(n_each.sum())
            out.append(np.stack([np.repeat(at, n_each), owners[x], places[x], np.full(len(x), n)], 1))
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


#: Words of no text between documents: as many as a mask or the words beside a hit reach over.
GAP = 8


def _extends(seeds: Seeds, at: np.ndarray, place: np.ndarray, known: np.ndarray, length: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Whether beside a hit of two words (at ``at`` of the items in a row, at ``place`` of the documents in a row) a third can match."""
    out = np.zeros(len(at), bool)
    for i, j, step in ((at + 2, place + 2, 1), (at - 1, place - 1, -1)):
        la, xa, lb, xb = seeds.length[i], seeds.letters[i], length[j], letters[j]
        out |= (seeds.flat[i] + 1 == known[j]) & (known[j] > 0)
        out |= _alike(la, xa, lb, xb)
        joined, split = [(la, xa)], [(lb, xb)]
        for k in range(1, PIECES):
            joined.append((joined[-1][0] + seeds.length[i + step * k], joined[-1][1] | seeds.letters[i + step * k]))
            split.append((split[-1][0] + length[j + step * k], split[-1][1] | letters[j + step * k]))
            out |= _alike(*joined[-1], lb, xb) | _alike(la, xa, *split[-1])
        for lj, xj in joined[1:]:
            for ls, xs in split[1:]:
                out |= (lj == ls) & (xj == xs)
    return out


def _matcher(items: list[tuple[int, str]], min_words: int, min_cover: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items)
        for b in batches:
            docs, found, flat, starts, words = [], [], [-1] * GAP, [], []
            ids = b.column(0).to_pylist()
            number: dict[str, int] = {}
            for text in b.column(1).to_pylist():
                ts = tokens(text)
                words.append(ts)
                if seeds.short:
                    for key in {(w,) for w in ts} | set(zip(ts, ts[1:])):
                        for item in seeds.short.get(key, ()):
                            docs.append(ids[len(words) - 1])
                            found.append(item)
                starts.append(len(flat))
                flat.extend([number.setdefault(w, len(number)) for w in ts])
                flat.extend([-1] * GAP)
            nos = np.array(flat, np.int64)
            known = np.array([*(seeds.vocab.get(w, 0) for w in number), 0], np.int64)[nos]
            hits = seeds.hits(known)
            if len(hits):
                length, letters = _shape([*number, ""])
                length[-1] = OFF_DOC
                owners, own = np.unique(hits[:, 1], return_inverse=True)
                at = np.array([seeds.begins[k] for k in owners.tolist()])[own.ravel()] + hits[:, 2]
                hits = hits[(WEIGHTS[hits[:, 3]] > MIN_TOUCHED) | _extends(seeds, at, hits[:, 0], known, length[nos], letters[nos])]
            if len(hits):
                starts = np.array(starts)
                row = np.searchsorted(starts, hits[:, 0], "right") - 1
                place = hits[:, 0] - starts[row]
                per = np.unique(np.stack([row, hits[:, 1], hits[:, 2], place], 1), axis=0)
                edge = np.flatnonzero(np.r_[True, (per[1:, :2] != per[:-1, :2]).any(1), True])
                for lo, hi in zip(edge[:-1], edge[1:]):
                    r, item = int(per[lo, 0]), int(per[lo, 1])
                    if verify(seeds.items[item], words[r], [(int(i), int(j)) for i, j in per[lo:hi, 2:]], min_words, min_cover):
                        docs.append(ids[r])
                        found.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The query set, a bounded block of items at a time."""
    block, size = [], 0
    rows = items.selectExpr("cast(item_id as bigint) item_id", "text").filter("item_id is not null and text is not null").dropDuplicates(["item_id"])
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 5 + 1
        if size >= BLOCK_TOKENS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, min_cover: float = 0.9) -> DataFrame:
    """(doc_id, item_id), distinct: the documents that contain an item, or min_words consecutive words of it."""
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "text").filter("doc_id is not null and text is not null")
    parts = [docs.mapInArrow(_matcher(block, min_words, min_cover), "doc_id bigint, item_id bigint") for block in _blocks(items)]
    if not parts:
        return docs.selectExpr("doc_id", "cast(null as bigint) item_id").limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): per test item, in how many documents it leaks; 0 where in none."""
    n = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))
