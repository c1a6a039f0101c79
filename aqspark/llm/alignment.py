"""Cross-tokenizer alignment with counts kept under minimal perfect hashes.

Two tokenizers cut the same bytes; where tokens of both end, a group ends. Token
pairs that share a group are linked, and an id pair counts the documents that
hold it linked. Two passes over the texts:

1. Align; each slice of texts stores its distinct id pairs with the number of its
   documents that hold them. The distinct pairs of all are cut into shards by the
   first id, and each shard gets a minimal perfect hash: in every level, pairs
   that are alone in their bit keep it, the others go on to the next level, and
   a pair's index is its bit's rank. Groups of slices add their counts into dense
   vectors by index, with the key at an index compared, and vectors are summed as
   a tree.
2. Align again and look the counts up, shard by shard, with keys compared again.

No group holds more than one shard's vectors (about ``SHARD_PAIRS`` entries) and
``FAN`` slices' arrays or vectors; nothing is broadcast or collected but the
number of pairs and of slices.

White space that follows other characters begins a new unit: no token of either
vocabulary reaches over that place, so tokens of units in turn are the tokens of
the text, and a unit is encoded and aligned once for all its occurrences in a
slice. (Units are cut only at U+0020 after a character that isn't white space.)

Defined results: a text that is null or empty, or whose tokens of one vocabulary
don't give its bytes back, has no tokens: all numbers are 0 and its groups ''.
Equal rows are separate documents. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aqspark.llm.common import map_batches
from aqspark.session import settle

SLICE_CHARS = 1 << 21  # texts aligned together, unless one is longer
LONG_UNIT = 256  # longer units are encoded by themselves
SHARD_PAIRS = 1 << 20
FAN = 24
SECOND = 16  # bits of the second id in a pair
LOAD = 2  # bits of a hash level for each key left
LEVELS = 40
WIDE_GROUP = 4096  # links of a group that are counted by distinct ids

# fixed value: how the byte-level vocabulary's tokenizer cuts texts before merging
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = re.compile(r"(?<=\S)(?= )")
SPACED = re.compile(r"\s ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        a = Tokenizer.from_file(first)
        self.path, self.long = first, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        stand_in, vocabulary = byte_alphabet(), a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, id in vocabulary.items():
            self.a_bytes[id] = bytes(stand_in[c] for c in token)
        # merges are numbered in the order of their ids, so the entries are ranks as well
        self.ranks = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={x: k for k, x in enumerate(self.a_bytes) if x}, special_tokens={})
        pieces = [(self.b.id_to_piece(k), self.b.is_byte(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if single else piece.replace("▁", " ").encode() for piece, single in pieces]
        self.blank = self.b.piece_to_id("▁")
        # an id as text with the mark after it: inside a group, and at the end of its side
        marks = [f"{k}{mark}" for side, end in ((self.a_bytes, "|"), (self.b_bytes, ";")) for k in range(len(side)) for mark in (",", end)]
        self.marks = pa.array(marks, pa.large_string())

    def whole(self, unit: str) -> list[int]:
        """Ids of one unit of the byte-level vocabulary; a long one by the tokenizer itself, which bears any length."""
        if len(unit) <= LONG_UNIT:
            return self.ranks.encode_ordinary(unit)
        if self.long is None:
            self.long = Tokenizer.from_file(self.path)
            self.long.encode_special_tokens = True
        return self.long.encode(unit, add_special_tokens=False).ids

    def first(self, units: list[str], sizes: np.ndarray) -> Side:
        """Tokens of the byte-level vocabulary; units of ``sizes`` bytes that end in a word are encoded as one text."""
        alone = [k for k, u in enumerate(units) if len(u) > LONG_UNIT or u[-1].isspace()]
        apart = set(alone)
        together = [k for k in range(len(units)) if k not in apart]
        ids = np.array(self.ranks.encode_ordinary("".join([units[k] for k in together])), np.int64)
        table = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        ends = np.cumsum(sizes[together])
        owner = np.searchsorted(ends, np.cumsum(table[ids]) - table[ids], side="right")
        lists = [self.whole(units[k]) for k in alone]
        owner = np.concatenate([np.array(together, np.int64)[owner], np.repeat(np.array(alone, np.int64), [len(x) for x in lists])])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(lists), np.int64)])
        order = np.argsort(owner, kind="stable") if alone else slice(None)
        return Side(ids[order], owner[order], self.a_bytes, len(units))

    def second(self, units: list[str]) -> Side:
        """Tokens of the piece model, which puts the blank before a text itself; for an empty rest it would give nothing."""
        lists = [ids or [self.blank] for ids in self.b.encode([u[1:] for u in units], num_threads=1)] if units else []
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, lists), np.int64, len(lists)))
        return Side(np.fromiter(chain.from_iterable(lists), np.int64), owner, self.b_bytes, len(units))


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _LOADED:
        _LOADED[paths] = Aligner(*paths)
    return _LOADED[paths]


class Side:
    """Tokens of one vocabulary over many units: ids, the unit of each, and the byte at which each ends."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, table: list[bytes], n: int) -> None:
        self.ids, self.owner = ids, owner
        parts = [table[k] for k in ids.tolist()]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.raw = b"".join(parts)
        self.bytes_of = np.bincount(owner, self.sizes, n).astype(np.int64)

    def only(self, good: np.ndarray) -> None:
        keep = good[self.owner]
        self.ids, self.owner, self.sizes = self.ids[keep], self.owner[keep], self.sizes[keep]
        self.ends = np.cumsum(self.sizes)

    def grouped(self, other: Side) -> None:
        """Group of each token; a group ends where tokens of both sides end."""
        self.last = np.isin(self.ends, other.ends, assume_unique=True)
        self.group = np.cumsum(self.last) - self.last


class Units:
    """Distinct units, aligned.

    ``good`` are those that both vocabularies give back byte for byte; ``numbers``
    are n_a, n_b, n_groups and n_links of each; unit ``u`` holds the distinct id
    pairs ``pairs[starts[u]:starts[u + 1]]``, linked ``times`` times.
    """

    def __init__(self, units: list[str], loaded: Aligner) -> None:
        self.loaded, n = loaded, len(units)
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, n)
        a, b = loaded.first(units, sizes), loaded.second(units)
        self.good = (a.bytes_of == sizes) & (b.bytes_of == sizes)
        whole = b"".join(raw)
        for side in (a, b):
            if side.raw != whole:
                ends = np.cumsum(side.bytes_of).tolist()
                self.good &= np.fromiter((side.raw[x:y] == u for x, y, u in zip([0, *ends], ends, raw)), bool, n)
        a.only(self.good)
        b.only(self.good)
        a.grouped(b)
        b.grouped(a)
        self.a, self.b = a, b
        self.owner = a.owner[a.last]  # unit of each group
        n_a, n_b = (np.bincount(side.group, minlength=len(self.owner)) for side in (a, b))
        count = lambda owner, weights=None: np.bincount(owner, weights, n).astype(np.int64)
        self.numbers = np.stack([count(a.owner), count(b.owner), count(self.owner), count(self.owner, n_a * n_b)], axis=1)
        self._link(n_a, n_b, n)

    def _link(self, n_a: np.ndarray, n_b: np.ndarray, n: int) -> None:
        a, b = self.a, self.b
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        wide = n_a * n_b > WIDE_GROUP
        x = np.flatnonzero(~wide[a.group])
        each = n_b[a.group[x]]
        y = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[a.group[x]], each)
        x = np.repeat(x, each)
        keys, times = [a.owner[x] << 32 | a.ids[x] << SECOND | b.ids[y]], [np.ones(len(x), np.int64)]
        for g in np.flatnonzero(wide).tolist():  # repeated ids are counted before they are paired
            (p, m), (q, k) = (np.unique(side.ids[f[g] : f[g] + c[g]], return_counts=True) for side, f, c in ((a, first_a, n_a), (b, first_b, n_b)))
            keys.append((self.owner[g] << 32 | p[:, None] << SECOND | q[None, :]).ravel())
            times.append((m[:, None] * k[None, :]).ravel())
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        self.times = np.bincount(where, np.concatenate(times), len(keys)).astype(np.int64)
        self.pairs = keys & 0xFFFFFFFF
        self.starts = np.searchsorted(keys >> 32, np.arange(n + 1))

    def texts(self) -> pa.LargeStringArray:
        """Groups of each unit as text, each with a semicolon after it."""
        a, b = self.a, self.b
        n_a, n_b = (np.bincount(side.group, minlength=len(self.owner)) for side in (a, b))
        at = np.zeros(len(a.ids) + len(b.ids), np.int64)
        at[np.arange(len(a.ids)) + (np.cumsum(n_b) - n_b)[a.group]] = 2 * a.ids + a.last
        at[np.arange(len(b.ids)) + np.cumsum(n_a)[b.group]] = 2 * (len(self.loaded.a_bytes) + b.ids) + b.last
        shown = self.loaded.marks.take(pa.array(at))
        bounds = np.frombuffer(shown.buffers()[1], np.int64, len(at) + 1)
        tokens = np.concatenate(([0], np.cumsum(self.numbers[:, 0] + self.numbers[:, 1])))
        offsets = pa.py_buffer(np.ascontiguousarray(bounds[tokens]))
        return pa.LargeStringArray.from_buffers(len(tokens) - 1, offsets, shown.buffers()[2])


def unit_codes(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units, the index of each unit of all texts, and each text's bounds in that list."""
    plain = [None if not t or t[0] == " " or SPACED.search(t) else t for t in texts]
    lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    units, codes = [" " + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not any(t and p is None for t, p in zip(texts, plain)):
        return units, codes, np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
    index = {u: k for k, u in enumerate(units)}
    sizes = np.fromiter(pc.fill_null(pc.list_value_length(lists), 0).to_pylist(), np.int64, len(texts))
    ends = np.cumsum(sizes)
    parts = []
    for k, text in enumerate(texts):
        if plain[k] is not None:
            parts.append(codes[ends[k] - sizes[k] : ends[k]])
        else:
            found = UNIT.split(" " + text) if text else []
            parts.append(np.fromiter((index.setdefault(u, len(index)) for u in found), np.int64, len(found)))
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    return list(index), np.concatenate(parts) if parts else codes, bounds


class Slice:
    """Some texts, aligned: text ``owner[k]`` holds the distinct pair ``pairs[at[k]]``, linked ``times[k]`` times."""

    def __init__(self, texts: list[str | None], paths: tuple[str, str]) -> None:
        found, codes, bounds = unit_codes(texts)
        self.units, n = Units(found, aligner(paths)), len(texts)
        row = np.repeat(np.arange(n), np.diff(bounds))
        bad = np.bincount(row, ~self.units.good[codes], n) > 0
        keep = ~bad[row]
        self.row, self.codes = row[keep], codes[keep]
        both, often = np.unique(self.row << 32 | self.codes, return_counts=True)
        unit, owner = both & 0xFFFFFFFF, both >> 32
        count = np.diff(self.units.starts)[unit]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.units.starts[unit], count)
        self.pairs, local = np.unique(self.units.pairs[place], return_inverse=True)
        cells, where = np.unique(np.repeat(owner, count) << 32 | local, return_inverse=True)
        self.owner, self.at = cells >> 32, cells & 0xFFFFFFFF
        self.times = np.bincount(where, np.repeat(often, count) * self.units.times[place], len(cells)).astype(np.int64)
        self.numbers = np.stack([np.bincount(self.row, self.units.numbers[self.codes, k], n).astype(np.int64) for k in range(4)], axis=1)
        self.n = n

    def groups(self) -> list[bytes]:
        """Groups of each text, joined by semicolons."""
        shown = self.units.texts().take(pa.array(self.codes))
        bounds = np.frombuffer(shown.buffers()[1], np.int64, len(shown) + 1) if len(shown) else np.zeros(1, np.int64)
        raw = memoryview(shown.buffers()[2]) if len(shown) else memoryview(b"")
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.row, minlength=self.n))))
        at = bounds[ends].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(at, at[1:])]


def text_slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of at most ``SLICE_CHARS`` in all, or of one text."""
    first = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > first and size + n > SLICE_CHARS:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of integers."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each pair, by its first id alone."""
    return (mixed(pairs >> SECOND, 77) % np.uint64(shards)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct keys, with the keys in the order of their indexes."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray) -> None:
        self.levels, self.keys = levels, keys
        ones = [int(bits.sum()) for bits in levels]
        self.ranks = [np.cumsum(bits) - bits + sum(ones[:k]) for k, bits in enumerate(levels)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            at = (mixed(left, len(levels)) % np.uint64(LOAD * len(left))).astype(np.int64)
            bits = np.bincount(at, minlength=LOAD * len(left)) == 1
            levels.append(bits)
            left = left[~bits[at]]
        found = cls(levels, np.zeros(0, np.int64))
        found.keys = np.zeros(len(keys), np.int64)
        found.keys[found.places(keys)] = keys
        return found

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level holds its bit."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (mixed(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, compared with the key that is there."""
        at = self.places(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise ValueError("a pair was not in the first pass")
        return at

    def sizes(self) -> bytes:
        return np.array([len(bits) for bits in self.levels], "<i8").tobytes()

    def bits(self) -> bytes:
        return np.packbits(np.concatenate(self.levels)).tobytes() if self.levels else b""

    @classmethod
    def read(cls, sizes: bytes, bits: bytes, keys: bytes) -> PerfectHash:
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(ends[-1]) if len(ends) else 0).astype(bool)
        return cls(np.split(flat, ends[:-1]) if len(ends) else [], np.frombuffer(keys, "<i8"))


HASH = "shard int, sizes binary, bits binary, keys binary"


def slice_counts(docs: DataFrame, paths: tuple[str, str], text: str) -> DataFrame:
    """(slice, pairs, counts), stored: the distinct id pairs of each slice and the documents of it that hold them."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch[0].to_pylist()
        for a, b in text_slices(texts):
            found = Slice(texts[a:b], paths)
            held = np.bincount(found.at, minlength=len(found.pairs))
            yield {
                "slice": pa.array([uuid.uuid4().int >> 65], pa.int64()), "pairs": pa.array([found.pairs.astype("<i8").tobytes()], pa.binary()),
                "counts": pa.array([held.astype("<i8").tobytes()], pa.binary()),
            }

    return settle(map_batches(docs.select(F.col(f"`{text}`")), "slice long, pairs binary, counts binary", run))


def distinct_pairs(counted: DataFrame) -> DataFrame:
    """(pair) of all id pairs linked anywhere, stored."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for pairs in batch[0]:
            yield {"pair": pa.array(np.frombuffer(pairs.as_py(), "<i8"))}

    return settle(map_batches(counted.select("pairs"), "pair long", run).distinct())


def sharded_counts(counted: DataFrame, shards: int) -> DataFrame:
    """(shard, slice, pairs, counts): the same arrays cut into shards."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for uid, pairs, counts in zip(batch["slice"], batch["pairs"], batch["counts"]):
            pairs, counts = (np.frombuffer(x.as_py(), "<i8") for x in (pairs, counts))
            for shard, part in by_shard(pairs, shards):
                yield {
                    "shard": pa.array([shard], pa.int32()), "slice": pa.array([uid.as_py()], pa.int64()),
                    "pairs": pa.array([pairs[part].tobytes()], pa.binary()), "counts": pa.array([counts[part].tobytes()], pa.binary()),
                }

    return map_batches(counted, "shard int, slice long, pairs binary, counts binary", run)


def hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """One perfect hash for each shard, stored."""

    def place(batch: pa.RecordBatch) -> dict:
        keys = batch[0].to_numpy()
        return {"shard": pa.array(shard_of(keys, shards), pa.int32()), "pair": batch[0]}

    def build(table: pa.Table) -> pa.Table:
        found = PerfectHash.build(table["pair"].to_numpy())
        return pa.table({
            "shard": table["shard"][:1].cast(pa.int32()), "sizes": pa.array([found.sizes()], pa.binary()),
            "bits": pa.array([found.bits()], pa.binary()), "keys": pa.array([found.keys.astype("<i8").tobytes()], pa.binary()),
        })

    placed = map_batches(pairs, "shard int, pair long", place)
    return settle(placed.groupBy("shard").applyInArrow(build, HASH))


def by_shard(pairs: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of each shard that some of ``pairs`` belong to."""
    owner = shard_of(pairs, shards)
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(owner[part[0]]), part


def summed_vectors(counted: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(shard, counts, best): documents of each pair by index, and whether a pair is its first id's most frequent."""
    groups = max(1, -(-counted.count() // FAN))
    sent = sharded_counts(counted, shards)

    def add(sparse: pa.Table, table: pa.Table) -> pa.Table:
        if not sparse.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})
        found = PerfectHash.read(*(table[c][0].as_py() for c in ("sizes", "bits", "keys")))
        total = np.zeros(len(found.keys), np.int64)
        for pairs, counts in zip(sparse["pairs"], sparse["counts"]):
            total[found.index(np.frombuffer(pairs.as_py(), "<i8"))] += np.frombuffer(counts.as_py(), "<i8")
        return pa.table({"shard": table["shard"][:1], "vector": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), "<i8") for v in table["vector"])
        return pa.table({"shard": table["shard"][:1], "vector": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    salted = sent.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(groups)).cast("int"))
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    vectors = salted.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(add, "shard int, vector binary")
    while groups > 1:
        groups = -(-groups // FAN)
        parted = settle(vectors).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        vectors = parted.groupBy("shard", "part").applyInArrow(merge, "shard int, vector binary")

    def finish(table: pa.Table) -> pa.Table:
        keys, total = (np.frombuffer(table[c][0].as_py(), "<i8") for c in ("keys", "vector"))
        first, at = np.unique(keys >> SECOND, return_inverse=True)
        most = np.zeros(len(first), np.int64)
        np.maximum.at(most, at, total)
        return pa.table({"shard": table["shard"][:1], "counts": table["vector"][:1].cast(pa.binary()), "best": pa.array([(total == most[at]).tobytes()], pa.binary())})

    return known.join(vectors, "shard").groupBy("shard").applyInArrow(finish, "shard int, counts binary, best binary")


def written_cells(row: np.ndarray, pair: np.ndarray, times: np.ndarray) -> bytes:
    """Rows in order, how many pairs each holds, the pairs, and how often each is linked, in as few bytes as fit."""
    rows, sizes = np.unique(row, return_counts=True)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or times.max(initial=0) < 1 << 8 * w)
    head = np.array([len(rows), len(pair), width], "<i8").tobytes()
    return b"".join([head, *(x.astype("<u4").tobytes() for x in (rows, sizes, pair)), times.astype(f"<u{width}").tobytes()])


def read_cells(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, where the pairs of each begin, the pairs, and how often each is linked."""
    n, m, width = np.frombuffer(raw, "<i8", 3).tolist()
    rows, sizes = np.frombuffer(raw, "<u4", n, 24), np.frombuffer(raw, "<u4", n, 24 + 4 * n)
    pair, times = np.frombuffer(raw, "<u4", m, 24 + 8 * n), np.frombuffer(raw, f"<u{width}", m, 24 + 8 * n + 4 * m)
    return rows, np.cumsum(sizes, dtype=np.int64) - sizes, pair, times.astype(np.int64)


ROWS = "slice long, row int, id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, shard int, pairs binary, cells binary"


def aligned(docs: DataFrame, paths: tuple[str, str], id: str, text: str, shards: int, digest: bool) -> DataFrame:
    """The third pass, stored: rows of documents (shard null) and each slice's pairs by shard with the rows that hold them."""
    narrow = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = ROWS.format(id=narrow.schema["id"].dataType.simpleString())

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch["text"].to_pylist()
        for first, last in text_slices(texts):
            found = Slice(texts[first:last], paths)
            n, uid, numbers = last - first, uuid.uuid4().int >> 65, found.numbers
            groups = [(sha256(g).hexdigest() if digest else bytes(g).decode()) if len(g) else "" for g in found.groups()]
            none = lambda kind, n: pa.nulls(n, kind)
            yield {
                "slice": pa.array(np.full(n, uid), pa.int64()), "row": pa.array(np.arange(n), pa.int32()), "id": batch["id"].slice(first, n),
                **{c: pa.array(numbers[:, k], pa.int64()) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "groups": pa.array(groups, pa.string()), "shard": none(pa.int32(), n), "pairs": none(pa.binary(), n), "cells": none(pa.binary(), n),
            }
            for shard, part in by_shard(found.pairs, shards):
                local = np.full(len(found.pairs), -1, np.int64)
                local[part] = np.arange(len(part))
                here = np.flatnonzero(local[found.at] >= 0)
                cells = written_cells(found.owner[here], local[found.at[here]], found.times[here])
                yield {
                    "slice": pa.array([uid], pa.int64()), "row": none(pa.int32(), 1), "id": none(batch["id"].type, 1),
                    **{c: none(pa.int64(), 1) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": none(pa.string(), 1),
                    "shard": pa.array([shard], pa.int32()), "pairs": pa.array([found.pairs[part].astype("<i8").tobytes()], pa.binary()),
                    "cells": pa.array([cells], pa.binary()),
                }

    return settle(map_batches(narrow, schema, run))


def looked_up(sent: DataFrame, known: DataFrame, vectors: DataFrame, shards: int) -> DataFrame:
    """(slice, row, n_best, count_sum) of each document that has pairs of a shard."""
    groups = max(1, -(-sent.select("slice").distinct().count() // FAN))
    schema = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def look(cells: pa.Table, table: pa.Table) -> pa.Table:
        parts = []
        if cells.num_rows:
            found = PerfectHash.read(*(table[c][0].as_py() for c in ("sizes", "bits", "keys")))
            counts = np.frombuffer(table["counts"][0].as_py(), "<i8")
            best = np.frombuffer(table["best"][0].as_py(), bool)
            for uid, pairs, raw in zip(cells["slice"], cells["pairs"], cells["cells"]):
                at = found.index(np.frombuffer(pairs.as_py(), "<i8"))
                rows, starts, pair, times = read_cells(raw.as_py())
                sums = [np.add.reduceat(times * of[at][pair], starts) for of in (best, counts)]
                parts.append(pa.Table.from_arrays([
                    pa.array(np.full(len(rows), uid.as_py()), pa.int64()), pa.array(rows, pa.int32()), pa.array(sums[0]), pa.array(sums[1]),
                ], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    salted = sent.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(groups)).cast("int"))
    copies = known.join(vectors, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    out = salted.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(look, "slice long, row int, n_best long, count_sum long")
    return out.groupBy("slice", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, first: str, second: str, id: str = "doc_id", text: str = "text", digest: bool = True) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of ``docs``.

    ``first`` is a byte-level vocabulary file, ``second`` a piece model. ``groups``
    is the SHA-256 of the groups' text, or with ``digest=False`` the text itself.
    """
    paths = (first, second)
    counted = slice_counts(docs, paths, text)
    pairs = distinct_pairs(counted)
    shards = max(1, -(-pairs.count() // SHARD_PAIRS))
    known = hashes(pairs, shards)
    vectors = settle(summed_vectors(counted, known, shards))
    every = aligned(docs, paths, id, text, shards, digest)
    sums = looked_up(every.where("shard is not null").select("slice", "shard", "pairs", "cells"), known, vectors, shards)
    rows = every.where("shard is null").select("slice", "row", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = F.lit(0).cast("long")
    return rows.join(sums, ["slice", "row"], "left").select(
        F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups"
    )
