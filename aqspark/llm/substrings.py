"""Exact removal of repeated word windows behind a count-min prefilter.

Every window of ``WINDOW`` words is represented by its anchor: among the runs
of ``GRAM`` words in it, the one with the smallest hash. Equal windows have
equal anchors, so the number of documents that hold a window's anchor is never
less than the number that hold the window. Each partition counts its
documents' anchors in a count-min sketch whose counters stop at two; the
sketches are merged by slices. In the second pass only windows whose anchor is
estimated in two documents or more are grouped, by a 128-bit hash of their
words, and compared by the smallest document in which each starts. The sketch
can only overestimate, so no repeated window is lost.

The sketch has ``ROWS`` rows of counters, about ``LOAD`` for each anchor, at
most ``MAX_WIDTH`` in a row: the merged bits that tasks receive never exceed
``ROWS * MAX_WIDTH / 8`` bytes (32 MB). Beyond that width more windows pass the
prefilter; results stay the same.

Defined results: null text has no words; texts shorter than a window lose
nothing; a repeat inside one document only removes nothing; rows with equal ids
are one document as a source but judged row by row (a row is known by its id
and a 128-bit hash of its text); rows with a null id are
never sources and never lose words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.common import encoded_words, map_batches, slices
from aqspark.session import settle

WINDOW = 50
GRAM = 20
ROWS = 2
LOAD = 4
MIN_WIDTH, MAX_WIDTH = 1 << 22, 1 << 27
SLICE = 1 << 20  # counters of a sketch that are merged together
PART_BYTES = 4 << 20  # of text that a task hashes at a time

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_KEPT: dict[np.uint64, np.ndarray] = {}  # powers of texts of usual length, computed once in a worker


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n at least."""
    kept = _KEPT.get(base)
    if kept is None or len(kept) <= n:
        size = max(n, 1 << 12)
        kept = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64))))
        if size <= 1 << 20:
            _KEPT[base] = kept
    return kept


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(BASE, len(words))[: len(words)], dtype=np.uint64)))
    h = (sums[width:] - sums[:n]) * _powers(INVERSE, n)[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` consecutive ones: minima of doubling spans, then of two that cover."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    h = run_hashes(words, GRAM)
    return window_minima(h, WINDOW - GRAM + 1) if len(h) > WINDOW - GRAM else h[:0]


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start. Neighbouring windows mostly share their anchor."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))


def cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    """Counter of each anchor in one row of the sketch."""
    mixed = (anchor ^ np.uint64(row * 0xA5A5A5A5)) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * row)
    return (mixed >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


class WordHashes:
    """Two 64-bit hashes of each word (seeds 1 and 2) for each text of a batch; the second is a function, as few texts need it."""

    def texts(self, column: pa.Array):
        for _, part in slices(column, PART_BYTES):
            vocabulary, index, bounds = encoded_words(part)
            raw = [w.encode() for w in vocabulary]
            hashes = lambda seed: np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in raw), np.uint64, len(raw))  # noqa: E731,B023
            second = cache(lambda: hashes(2))  # noqa: B023
            first = hashes(1)[index]
            for i, j in zip(bounds[:-1], bounds[1:]):
                yield first[i:j], lambda i=i, j=j, second=second, index=index: second()[index[i:j]]


def _pack(counts: np.ndarray) -> bytes:
    """Counters 0, 1, 2 as two bit planes, deflated."""
    return zlib.compress(np.packbits(counts >= 1).tobytes() + np.packbits(counts >= 2).tobytes(), 1)


class Counters:
    """Counters that stop at two, four to a byte."""

    def __init__(self, width: int) -> None:
        self.bytes = np.zeros(width // 4, np.uint8)

    def add(self, cells: np.ndarray) -> None:
        """Count distinct cells; those at one place in their bytes lie in distinct bytes."""
        for place in range(4):
            at = cells[cells & 3 == place] >> 2
            self.bytes[at] += ((self.bytes[at] >> (2 * place) & 3) < 2).astype(np.uint8) << (2 * place)

    def part(self, start: int, length: int) -> np.ndarray:
        packed = self.bytes[start // 4 : (start + length) // 4]
        return (packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()


def _merge(found: pa.Table) -> bytes:
    """Sum of packed slices, counters stopping at two."""
    one = two = None
    for raw in found["counts"]:
        planes = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
        a, b = planes[: len(planes) // 2], planes[len(planes) // 2 :]
        one, two = (a, b) if one is None else (one | a, two | b | one & a)
    return zlib.compress(one.tobytes() + two.tobytes(), 1)


def sketch(rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each row of the merged sketch, one bit for each counter: two documents or more.

    Partitions send their sketch in slices; 64 partitions are merged first, then
    all. Only the final bits, of bounded size, come to the driver.
    """

    def count(batches):
        part, counts = TaskContext.get().partitionId(), None
        for batch in batches:
            for id, (words, _) in zip(batch.column(0), WordHashes().texts(batch.column(1))):
                if len(words) < WINDOW or not id.is_valid:
                    continue
                if counts is None:
                    counts = [Counters(width) for _ in range(ROWS)]
                found = anchors(words)
                found = np.unique(found[runs(found)])
                for row in range(ROWS):
                    counts[row].add(np.unique(cells(found, row, width)))
        for row in range(ROWS) if counts is not None else ():
            for at in range(0, width, SLICE):
                piece = counts[row].part(at, SLICE)
                if piece.any():
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row], pa.int32()), "slice": pa.array([at // SLICE], pa.int32()),
                        "part": pa.array([part // 64], pa.int32()), "counts": pa.array([_pack(piece)], pa.binary()),
                    })

    kinds = "row int, slice int, part int, counts binary"

    def some(key, found):
        return pa.table({n: pa.array([k.as_py()], pa.int32()) for n, k in zip(("row", "slice", "part"), key)} | {"counts": pa.array([_merge(found)], pa.binary())})

    def whole(key, found):
        return pa.table({n: pa.array([k.as_py()], pa.int32()) for n, k in zip(("row", "slice"), key)} | {"counts": pa.array([_merge(found)], pa.binary())})

    parts = rows.mapInArrow(count, kinds).groupBy("row", "slice", "part").applyInArrow(some, kinds)
    merged = parts.groupBy("row", "slice").applyInArrow(whole, "row int, slice int, counts binary")
    bits = [np.zeros(width // 8, np.uint8) for _ in range(ROWS)]
    for r in merged.toLocalIterator():
        planes = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
        bits[r["row"]][r["slice"] * SLICE // 8 :][: len(planes) // 2] = planes[len(planes) // 2 :]
    return bits


def estimated_repeated(anchor: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Whether all rows of the sketch have counted two documents for the anchor."""
    out = np.ones(len(anchor), bool)
    for row, plane in enumerate(bits):
        at = cells(anchor, row, len(plane) * 8)
        out &= plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    return out


def sketch_width(rows: DataFrame) -> int:
    """Counters in a row: a power of two, ``LOAD`` for each anchor at about six bytes a word."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    expected = LOAD * size / 6 * 2 / (WINDOW - GRAM + 2)
    return int(min(MAX_WIDTH, max(MIN_WIDTH, 1 << int(np.ceil(np.log2(max(expected, 1)))))))


def _rows(df: DataFrame, id: str, text: str) -> DataFrame:
    """_id, _text and the two halves of the hash of each text, which tell rows of one id apart."""
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.select("*", *(F.xxhash64(F.lit(seed), "_text").alias(f"_t{seed}") for seed in (1, 2)))


def repeated_windows(df: DataFrame, id: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """(id, _t1, _t2, start) of each window whose words also start in a document with a smaller id; ``_t1``, ``_t2`` hash the row's text."""
    rows = _rows(df, id, text)
    kind = rows.schema["_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(sketch(rows.select("_id", "_text"), width or sketch_width(rows)))

    def candidates(batch: pa.RecordBatch):
        ids, starts, keys, n = [], [], [], 0
        t1, t2 = (batch.column(k).to_numpy() for k in (2, 3))
        for row, (id, (first, second)) in enumerate(zip(batch.column(0), WordHashes().texts(batch.column(1)))):
            if len(first) < WINDOW or not id.is_valid:
                continue
            anchor = anchors(first)
            starts_of = runs(anchor)
            repeated = estimated_repeated(anchor[starts_of], shared.value)
            if repeated.any():
                at = np.flatnonzero(np.repeat(repeated, np.diff(starts_of, append=len(anchor))))
                ids.append(pa.repeat(id, len(at)))
                starts.append(at)
                keys.append((run_hashes(first, WINDOW)[at].view(np.int64), run_hashes(second(), WINDOW)[at].view(np.int64), np.full(len(at), t1[row]), np.full(len(at), t2[row])))
                n += len(at)
            if n > 200_000:
                yield table(ids, starts, keys)
                ids, starts, keys, n = [], [], [], 0
        if n:
            yield table(ids, starts, keys)

    def table(ids, starts, keys) -> dict:
        return {c: pa.array(np.concatenate(k)) for c, k in zip(("h1", "h2", "_t1", "_t2"), zip(*keys))} | {
                "_id": pa.concat_arrays(ids), "start": pa.array(np.concatenate(starts).astype(np.int32))}

    found = map_batches(rows, f"h1 bigint, h2 bigint, _t1 bigint, _t2 bigint, _id {kind}, start int", candidates)
    first = found.groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    first = settle(first)  # stored, so the join reads two plain exchanges and may split a very common window
    return found.join(first, ["h1", "h2"]).where("_first < _id").select(F.col("_id").alias(id), "_t1", "_t2", "start")


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window with one of the starts."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """id, n_words, n_removed, kept_text (kept words joined by one space) of every row of ``df``."""
    rows = _rows(df, id, text)
    kind = rows.schema["_id"].dataType.simpleString()
    windows = repeated_windows(df, id, text, width).groupBy(F.col(id).alias("_key"), F.col("_t1").alias("_k1"), F.col("_t2").alias("_k2"))
    found = settle(windows.agg(F.collect_set("start").alias("starts")))
    same = (rows["_id"] == found["_key"]) & (rows["_t1"] == found["_k1"]) & (rows["_t2"] == found["_k2"])
    joined = rows.join(found, same, "left").select("_id", "_text", "starts")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for t, starts in zip(batch.column(1), batch.column(2)):
            words = (t.as_py() or "").encode().split()
            if starts.is_valid:
                gone = covered(starts.values.to_numpy().astype(np.int64), len(words))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                kept = words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        n, removed, kept = zip(*out)
        return {"_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}

    return map_batches(joined, f"_id {kind}, n_words bigint, n_removed bigint, kept_text string", run).withColumnRenamed("_id", id)


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
