"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into two 23-bit segments A and B and an 18-bit rest C
(two halves C1, C2). Each 23-bit word lies within three bits of exactly one
Golay codeword, and the codewords reached from the word by flipping at most one
bit (one, or six) are its keys: a word one bit away decodes to one of them.
With three wrong bits in all, some key of two parts is shared:

* C right: A or B has at most one wrong bit: (C, key of A), (C, key of B);
* one wrong bit in C: half of C is right; A and B have one at most each:
  (half, key of A, key of B), or one of them is right: (A, half), (B, half);
* two or three in C: one of A and B is right, the other has one at most:
  (A, key of B), (key of A, B).

The indexed side stores one decoded key per rule, the probing side all its
keys; candidates are verified by counting differing bits. Keys that index more
than ``crowded`` fingerprints are left to an exact way without pairs: any two
fingerprints within three bits share a word one bit from one of them and two
from the other, so links to the smallest fingerprint around each such word
give the same components.

Defined results: null or blank text has fingerprint zero; equal fingerprints
are one node, so copies never form pairs; rows with equal ids are kept; a null
id takes part and the component id is the smallest non-null id (null if none).
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from aqspark.llm.common import connected_components, map_batches, packed, unpacked
from aqspark.session import settle

WIDTH = 3  # words in a shingle
SEED = 42
MAX_BITS = 3
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the binary Golay code
CROWDED = 128


def fingerprint(text: str | None) -> bytes:
    """Eight big-endian bytes; a bit is set if it is in over half of the shingle hashes."""
    joined = b" ".join(text.encode().lower().split()) if text else b""
    if not joined:
        return bytes(8)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_digest
    if len(spaces) < WIDTH:
        return digest(joined, SEED)
    starts = [0, *(spaces[: 1 - WIDTH] + 1).tolist()]
    ends = [*spaces[WIDTH - 1 :].tolist(), len(joined)]
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(df: DataFrame, text: str = "text", name: str = "_fp", keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (or ``keep``) with a signed 64-bit fingerprint column ``name``."""
    rows = df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)], F.col(f"`{text}`").alias("_simhash_text"))
    fields = [f for f in rows.schema.fields if f.name != "_simhash_text"]
    schema = StructType([*fields, StructField(name, LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.num_columns - 1)
        raw = b"".join([fingerprint(t.as_py()) for t in column])
        out = {f.name: batch.column(i) for i, f in enumerate(fields)}
        return out | {name: pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))}

    return map_batches(rows, schema, run)


class Golay:
    """Decoder of the (23, 12) code: nearest codeword's 12-bit index, by syndrome."""

    def __init__(self) -> None:
        self.low, self.high = self._remainders(np.arange(1 << 12)), self._remainders(np.arange(1 << 11) << 12)
        bits = 1 << np.arange(23, dtype=np.int64)
        two = bits[:, None] ^ bits[None, :]
        errors = np.unique(np.concatenate(([0], bits, two.ravel(), (two[:, :, None] ^ bits).ravel())))
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.syndrome(errors)] = errors  # one error of weight 3 at most for each syndrome

    @staticmethod
    def _remainders(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.int64)
        for k in range(22, 10, -1):
            v = np.where(v >> k & 1, v ^ (GENERATOR << (k - 11)), v)
        return v

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 0xFFF] ^ self.high[v >> 12]

    def index(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.syndrome(v)]) >> 11

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct indices reached by at most one flip: (owner, index) rows."""
        flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
        found = np.sort(self.index(v[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        owner, _ = np.nonzero(new)
        return owner, found[new]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def _parts(fp: np.ndarray) -> tuple[np.ndarray, ...]:
    u = fp.view(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((41, 0x7FFFFF), (18, 0x7FFFFF), (0, 0x3FFFF)))
    return a, b, c, c >> 9, c & 0x1FF


def index_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key): the ten keys under which a fingerprint is stored."""
    a, b, c, c1, c2 = _parts(fp)
    i, j = golay().index(a), golay().index(b)
    rules = [c << 12 | i, c << 12 | j, (c1 << 12 | i) << 12 | j, (c2 << 12 | i) << 12 | j, a << 12 | j, b << 12 | i,
             a << 9 | c1, a << 9 | c2, b << 9 | c1, b << 9 | c2]
    keys = np.stack([np.int64(r) << 48 | k for r, k in enumerate(rules)], axis=1)
    return np.repeat(np.arange(len(fp)), len(rules)), keys.ravel()


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key): every key under which a fingerprint within three bits may be stored."""
    a, b, c, c1, c2 = _parts(fp)
    (oa, ka), (ob, kb) = golay().keys(a), golay().keys(b)
    # all combinations of the keys of A and B of one owner
    counts, first = np.bincount(ob, minlength=len(fp)), np.concatenate(([0], np.cumsum(np.bincount(ob, minlength=len(fp)))))
    reps = counts[oa]
    o = np.repeat(oa, reps)
    step = np.arange(len(o)) - np.repeat(np.cumsum(reps) - reps, reps)
    i, j = np.repeat(ka, reps), kb[first[o] + step]
    n = np.arange(len(fp))
    rows = [(oa, c[oa] << 12 | ka), (ob, c[ob] << 12 | kb), (o, (c1[o] << 12 | i) << 12 | j), (o, (c2[o] << 12 | i) << 12 | j),
            (ob, a[ob] << 12 | kb), (oa, b[oa] << 12 | ka), (n, a << 9 | c1), (n, a << 9 | c2), (n, b << 9 | c1), (n, b << 9 | c2)]
    return np.concatenate([x for x, _ in rows]), np.concatenate([np.int64(r) << 48 | k for r, (_, k) in enumerate(rows)])


def ball(radius: int) -> np.ndarray:
    """All 64-bit words with at most ``radius`` (1 or 2) bits set."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    words = np.concatenate(([np.uint64(0)], bits))
    return np.unique(words[:, None] ^ words[None, :]) if radius == 2 else words


def _keyed(nodes: DataFrame, rule) -> DataFrame:
    """(key, fp) rows of ``rule`` for the column fp of ``nodes``, in small batches.

    Spark takes the many rows of a fingerprint for one when it sizes them, so
    what is joined with them unstored is to carry the hint ``merge``.
    """

    def run(batch: pa.RecordBatch):
        fp = batch.column(0).to_numpy()
        for at in range(0, len(fp), 512):
            part = fp[at : at + 512]
            owner, key = rule(part)
            yield {"key": pa.array(key), "fp": pa.array(part[owner])}

    return map_batches(nodes.select("fp"), "key bigint, fp bigint", run)


def _around(radius: int):
    def rule(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = ball(radius)
        return np.repeat(np.arange(len(fp)), len(near)), (fp.view(np.uint64)[:, None] ^ near[None, :]).ravel().view(np.int64)

    return rule


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``nodes`` (distinct, column fp) within three bits.

    Every edge is within three bits. Fingerprints indexed under a crowded key
    get a connecting subset of their links; all others get each link.
    """
    stored = settle(_keyed(nodes, index_keys))
    hot = stored.groupBy("key").count().where(F.col("count") > crowded).select("key")
    hot = settle(hot)
    cold = stored.join(hot, "key", "left_anti")
    probes = _keyed(nodes, probe_keys).withColumnRenamed("fp", "other").hint("merge")
    pairs = probes.join(cold, "key").where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS))
    found = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    if hot.isEmpty():
        return found
    # a pair is missed above only if both of its fingerprints are stored under crowded keys
    members = settle(stored.join(hot, "key", "left_semi").select("fp").distinct())
    near = _keyed(members, _around(1))
    centre = settle(near.groupBy("key").agg(F.min("fp").alias("first")))
    star = _keyed(members, _around(2)).hint("merge").join(centre, "key").where("fp != first")
    return found.union(star.select(F.least("fp", "first").alias("a"), F.greatest("fp", "first").alias("b")).distinct())


def groups(prints: DataFrame, id: str = "doc_id", fp: str = "_fp", crowded: int = CROWDED) -> DataFrame:
    """(fp, first_id, component_id, root) for each distinct fingerprint: smallest id with it, smallest id and fingerprint of its component."""
    nodes = settle(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("first_id")))
    component = settle(connected_components(links(nodes, crowded)))
    placed = nodes.join(component, nodes.fp == component.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    # lone fingerprints need no second grouping
    lone = placed.where("root = fp").join(component.select(F.col("component").alias("root")).distinct(), "root", "left_anti")
    joined = placed.join(component.select(F.col("component").alias("root")).distinct(), "root", "left_semi")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "root").select("fp", "first_id", "component_id", "root")
    return named.union(lone.select("fp", "first_id", F.col("first_id").alias("component_id"), "root"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row of ``df``."""
    alone = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    prints = settle(fingerprints(alone, "_text", keep=["_id"]))
    found = settle(groups(prints, "_id", crowded=crowded)).select(F.col("fp").alias("_fp"), "component_id")
    shown = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return prints.join(found, "_fp").select(F.col("_id").alias(id), shown, "component_id")


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row of each component: the smallest id (null if all are), then the smallest fingerprint; of rows with equal id and fingerprint, one stays."""
    rows = packed(df)
    body, key = F.col("_row").getField(text), F.col("_row").getField(id)
    prints = fingerprints(rows.select("_row", body.alias("_text")), "_text", keep=["_row"])
    alone = fingerprints(rows.select(key.alias("_id"), body.alias("_text")), "_text", keep=["_id"])
    found = settle(groups(settle(alone), "_id", crowded=crowded))
    # a component is known by its root, as several may have one smallest id or none
    least = found.where(F.col("first_id").eqNullSafe(F.col("component_id")))
    kept = least.groupBy("root").agg(F.min("first_id").alias("_id"), F.min("fp").alias("_kept")).drop("root")
    same = key.eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_kept"))
    one = prints.join(kept, same, "left_semi").withColumn("_id", key).dropDuplicates(["_id", "_fp"])
    return unpacked(one, df.columns)
