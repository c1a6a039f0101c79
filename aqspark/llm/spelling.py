"""Spelling variants by k-d trees over letter-count vectors.

One inserted or deleted letter changes a word's letter counts by one in all, one
replaced letter by two. So a word's variants lie within L1 distance one (among
words one letter longer) or two (among words of its length) of its count vector.
Count vectors are kept in k-d trees, one for each length: a query goes down
every branch whose box it can reach by gaining at most one letter and, for words
of its own length, losing at most one. What the boxes leave is compared exactly
and then verified letter by letter.

The upper levels of the trees are planes fitted on a sample of at most
``SAMPLE`` words; they cut all words into leaves of about ``LEAF_WORDS``. A word
is stored in its one leaf and sent as a query to the leaves it can reach, each
leaf is a Spark group with a tree of its own. Words whose vectors are equal
share a point and are found through a hash table by the letters to exchange, so
no group of anagrams is compared in pairs.

Defined results: null texts have no words; a null id counts as an empty one in
the hash that decides which letters are deleted; every row counts, also equal
ones; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.llm.common import map_batches
from aqspark.llm.winnowing import lowered
from aqspark.session import settle

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5  # a form is at least this many times as frequent
DELETION = 199  # a run loses a letter if this divides its hash
#: a-z and U+00C0 to U+00FF; upper-case letters beyond A-Z stay as they are
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
SAMPLE = 50_000
LEAF_WORDS = 40_000
POINTS = 12  # vectors in a leaf of a group's own tree
CELLS = 1 << 24  # letter counts compared at a time
MAX_HOPS = 32  # a form is RATIO times as frequent, so paths of longs are shorter


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words of MIN_LENGTH letters and MIN_COUNT occurrences or more."""
    known = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    runs = docs.select(known.alias("_id"), F.explode(F.split(lowered(F.col(f"`{text}`")), "[^a-zÀ-ÿ]+")).alias("_run")).where("_run <> ''")
    hashed = runs.withColumn("_hash", F.crc32(F.concat("_id", F.lit(":"), "_run")))
    run, at = F.col("_run"), (F.col("_hash") % F.length("_run")).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    word = F.when(F.col("_hash") % DELETION == 0, shorter).otherwise(run)
    words = hashed.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts for each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    column = np.where(codes < 0x7B, codes - 0x61, codes - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    flat = np.bincount(row * len(LETTERS) + column, minlength=len(words) * len(LETTERS))
    kind = np.int8 if not len(flat) or flat.max() < 120 else np.int64
    return flat.astype(kind).reshape(len(words), len(LETTERS))


@dataclass
class Tree:
    """Planes of a k-d tree: at a node, counts of ``letter`` up to ``most`` go to ``low``, others to ``high``.

    A child is the number of a node, or of a leaf as ``-1 - leaf``.
    """

    letter: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def fit(cls, vectors: np.ndarray, size: int) -> Tree:
        """Halve the vectors until at most ``size`` are together or no plane parts them."""
        tree = cls()
        tree._grow(vectors, np.arange(len(vectors)), size)
        return tree

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, size: int) -> int:
        plane = self._plane(vectors[rows]) if len(rows) > size else None
        if plane is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.letter)
        letter, most = plane
        for part, value in ((self.letter, letter), (self.most, most), (self.low, 0), (self.high, 0)):
            part.append(value)
        left = vectors[rows, letter] <= most
        self.low[node] = self._grow(vectors, rows[left], size)
        self.high[node] = self._grow(vectors, rows[~left], size)
        return node

    @staticmethod
    def _plane(vectors: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that part the vectors most evenly; none if all are equal."""
        middle = np.partition(vectors, (len(vectors) - 1) // 2, axis=0)[(len(vectors) - 1) // 2]
        best, found = 0, None
        for shift in (0, -1):
            below = (vectors <= middle + shift).sum(axis=0)
            even = np.minimum(below, len(vectors) - below)
            letter = int(even.argmax())
            if even[letter] > best:
                best, found = int(even[letter]), (letter, int(middle[letter]) + shift)
        return found

    def reach(self, vectors: np.ndarray, lose: int, gain: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box a vector reaches by losing and gaining that many letters."""
        rows, leaves = [], []
        top = np.iinfo(np.int64).max
        root = 0 if self.letter else -1
        start = np.arange(len(vectors))
        stack = [(root, start, np.zeros(len(start), np.int16), np.zeros(len(start), np.int16), {})]
        while stack:
            node, at, lost, gained, box = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -1 - node))
                continue
            letter, most = self.letter[node], self.most[node]
            count = vectors[at, letter].astype(np.int64)
            least, greatest = box.get(letter, (0, top))
            # what this letter costs in the box so far, and in each half of it
            now_lost = lost + np.maximum(count - most, 0) - np.maximum(count - greatest, 0)
            keep = now_lost <= lose
            stack.append((self.low[node], at[keep], now_lost[keep], gained[keep], box | {letter: (least, most)}))
            now_gained = gained + np.maximum(most + 1 - count, 0) - np.maximum(least - count, 0)
            keep = now_gained <= gain
            stack.append((self.high[node], at[keep], lost[keep], now_gained[keep], box | {letter: (most + 1, greatest)}))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def fit_planes(words: DataFrame, total: int) -> dict[int, Tree]:
    """A tree of Spark groups for each length, from the ``SAMPLE`` words of smallest hash."""
    sample = [r[0] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    size = max(8, int(LEAF_WORDS * min(1.0, len(sample) / max(total, 1))))
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    return {length: Tree.fit(letter_counts(found), size) for length, found in by_length.items()}


def route(words: DataFrame, planes: dict[int, Tree]) -> DataFrame:
    """(length, leaf, stored, word, n): each word once where it is stored and wherever it has to ask."""
    whole = Tree(leaves=1)

    def send(batch: pa.RecordBatch) -> Iterator[dict]:
        text, counts = batch["word"].to_pylist(), np.array(batch["n"].to_pylist(), np.int64)
        lengths = np.fromiter(map(len, text), np.int64, len(text))
        vectors = letter_counts(text)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            for target, lose, gain, stored in ((length, 0, 0, True), (length, 1, 1, False), (length + 1, 0, 1, False)):
                row, leaf = planes.get(target, whole).reach(vectors[at], lose, gain)
                row = at[row]
                yield {
                    "length": pa.array(np.full(len(row), target), pa.int32()), "leaf": pa.array(leaf, pa.int32()),
                    "stored": pa.array(np.full(len(row), stored)),
                    "word": pa.array([text[k] for k in row.tolist()], pa.string()), "n": pa.array(counts[row], pa.int64()),
                }

    return map_batches(words.select("word", "n"), "length int, leaf int, stored boolean, word string, n long", send)


def exchanged(word: str, lost: str, gained: str) -> set[str]:
    """``word`` with one ``lost`` replaced by ``gained``, or with ``gained`` inserted if nothing is lost."""
    if not lost:
        return {word[:k] + gained + word[k:] for k in range(len(word) + 1)}
    return {word[:k] + gained + word[k + 1 :] for k, letter in enumerate(word) if letter == lost}


def variants(stored: list[str], queries: list[str], length: int) -> Iterator[tuple[int, int]]:
    """(query, stored) positions of words that differ by one letter; the stored ones have ``length`` letters."""
    if not stored or not queries:
        return
    place = {word: k for k, word in enumerate(stored)}
    points, vectors = np.unique(letter_counts(stored), axis=0), letter_counts(queries)
    used = np.flatnonzero(points.any(axis=0) | vectors.any(axis=0))
    letters = [LETTERS[k] for k in used]
    points, vectors = np.ascontiguousarray(points[:, used]), np.ascontiguousarray(vectors[:, used])
    if points.dtype != vectors.dtype:
        points, vectors = points.astype(np.int64), vectors.astype(np.int64)
    tree = Tree.fit(points, POINTS)
    home, leaf = tree.reach(points, 0, 0)  # each has one home
    points = points[home[np.argsort(leaf, kind="stable")]]
    sizes = np.bincount(leaf, minlength=tree.leaves)
    starts = np.cumsum(sizes) - sizes
    sizes_of = np.fromiter(map(len, queries), np.int64, len(queries))
    for lose in (0, 1):
        asked = np.flatnonzero(sizes_of == length - 1 + lose)
        query, at = tree.reach(vectors[asked], lose, 1)
        query = asked[query]
        ends = np.cumsum(sizes[at])
        step = max(1, CELLS // len(letters))
        first = 0
        while first < len(query):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + step, side="right")))
            count = sizes[at[first:last]]
            q = np.repeat(query[first:last], count)
            offset = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            p = np.repeat(starts[at[first:last]], count) + offset
            change = points[p] - vectors[q]
            near = np.flatnonzero((np.abs(change).sum(axis=1) == 1 + lose) & (change.max(axis=1) == 1))
            gained = change[near].argmax(axis=1)
            lost = change[near].argmin(axis=1)
            for k, g, d in zip(q[near].tolist(), gained.tolist(), lost.tolist()):
                for candidate in exchanged(queries[k], letters[d] if lose else "", letters[g]):
                    if candidate in place:
                        yield k, place[candidate]
            first = last


LINK = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def leaf_links(table: pa.Table) -> pa.Table:
    """Links of the queries that came to one leaf; those to longer words in both directions."""
    length = table["length"][0].as_py()
    here = np.array(table["stored"].to_pylist(), bool)
    text, counts = table["word"].to_pylist(), table["n"].to_pylist()
    stored, queries = np.flatnonzero(here).tolist(), np.flatnonzero(~here).tolist()
    out: tuple[list, list, list] = ([], [], [])
    for q, p in variants([text[k] for k in stored], [text[k] for k in queries], length):
        a, b = queries[q], stored[p]
        for x, y in [(a, b)] if len(text[a]) == length else [(a, b), (b, a)]:
            for part, value in zip(out, (text[x], text[y], counts[y])):
                part.append(value)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, LINK.types)], schema=LINK)


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all words that differ by one letter; ``words`` should be stored."""
    planes = fit_planes(words, words.count())
    return route(words, planes).groupBy("length", "leaf").applyInArrow(leaf_links, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, doubling the steps taken in each round."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    steps = 1
    while steps < MAX_HOPS:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(now.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now, steps = moved.select("word", "root"), steps * 2
        if moved.where("_moved").isEmpty():
            break
    return now


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n from (word, n)."""
    words = settle(words)
    order: Column = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))
    near = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(order).alias("_best"))
    joined = words.join(near, "word", "left")
    taken = -F.col("_best.n") >= RATIO * F.col("n")
    found = settle(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("_best.word")).alias("form"), F.when(taken, -F.col("_best.n")).alias("form_n"),
    ))
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their frequent near forms and the last form of each."""
    return group(word_counts(docs, id, text))
