"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on random directions. Two of them at the cosine
threshold differ by a normal deviate of known width in each projection, so the
number of projections in which one lies in the window around the other is
binomial, and the count that ``RECALL`` of such pairs reach follows from that.

To bring close vectors together, each of ``TABLES`` groups of projections is
cut at its medians: a vector is stored in the cell of its signs and looked up
in every cell that its windows of ``PROBE`` widths touch. Inside a cell the
stored vectors are sorted along every projection, the ranks between the two
ends of a query's window are its collisions, and pairs with enough collisions
are verified in double precision. A pair that meets in several tables is taken
in the first only, so links can be counted without listing pairs. Cells larger
than a block are split on both sides, so every task handles bounded blocks.

Equal vectors are one node with a number of copies. Defined results: vectors
that are null, empty, zero or hold null or non-finite numbers link with
nothing; vectors of different lengths do not link; a null id takes part and is
never a component's id unless no other is there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.common import connected_components
from aqspark.session import settle

THRESHOLD = 0.95
RECALL = 0.9999
TABLES = 3
CELL = 512  # vectors in a cell, about
COUNTED = 32  # projections whose windows are counted
WINDOW = 2.0  # half of a counted window, in widths of the pairs' difference
PROBE = 1.5  # half of a probing window
STORED_BLOCK, PROBE_BLOCK = 1024, 2048
SAMPLE = 4096  # vectors, at most about, from which the medians are taken
SEED = 11


def width(threshold: float) -> float:
    """Standard deviation of the difference of two unit vectors at the threshold along a random direction."""
    return math.sqrt(2 - 2 * threshold)


def needed(counted: int = COUNTED, window: float = WINDOW, recall: float = RECALL) -> int:
    """Collisions that pairs at the threshold reach with probability ``recall``."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for k in range(counted, -1, -1):
        tail += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if tail >= recall:
            return k
    return 0


def directions(dim: int, columns: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, columns))


def unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps the squares in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Plan:
    """Projections, medians and sizes that all tasks share."""

    def __init__(self, bits: dict[int, int], cuts: dict[int, np.ndarray], threshold: float) -> None:
        self.bits, self.cuts, self.threshold = bits, cuts, threshold
        self.probe, self.window, self.least = PROBE * width(threshold), WINDOW * width(threshold), needed()

    def project(self, v: np.ndarray) -> np.ndarray:
        return v @ directions(v.shape[1], max(COUNTED, TABLES * self.bits[v.shape[1]]))

    def sides(self, p: np.ndarray, dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Sign of each of the table's projections, and whether the window reaches over the median."""
        k = self.bits[dim]
        off = p[:, table * k : (table + 1) * k] - self.cuts[dim][table * k : (table + 1) * k]
        return off > 0, np.abs(off) <= self.probe


def _codes(sign: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, cell) of every cell that a vector's windows touch."""
    owner, code = np.arange(len(sign)), np.zeros(len(sign), np.int64)
    for k in range(sign.shape[1]):
        more = both[owner, k]
        own = code << 1 | sign[owner, k]
        owner, code = np.concatenate((owner, owner[more])), np.concatenate((own, own[more] ^ 1))
    return owner, code


def _by_dim(batch: pa.RecordBatch):
    """(rows, unit vectors) of each vector length in a batch."""
    raw = batch.column("vector").to_pylist()
    lengths = np.array([len(r) // 8 for r in raw])
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, unit([raw[i] for i in rows])


def _first_meeting(plan: Plan, dim: int, table: int, pq: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Whether the pairs (row of pq looks up row of pi) meet in no table before this one."""
    out = np.ones(len(pq), bool)
    for t in range(table):
        (sq, both), (si, _) = plan.sides(pq, dim, t), plan.sides(pi, dim, t)
        out &= ~((sq == si) | both).all(axis=1)
    return out


def block_links(plan: Plan, table: int, nodes: np.ndarray, copies: np.ndarray, stored: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, links) of the vectors of a block that have links; root is the block's smallest node linked to it."""
    dim = v.shape[1]
    p = plan.project(v)
    q_rows, i_rows = np.flatnonzero(~stored), np.flatnonzero(stored)
    counted = p[:, :COUNTED]
    order = np.argsort(counted[i_rows], axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(i_rows))[:, None], axis=0)
    along = np.take_along_axis(counted[i_rows], order, axis=0)
    rank, left, right = rank.astype(np.uint16), [], []
    found = []
    for at in range(0, len(q_rows), 256):
        q = q_rows[at : at + 256]
        hits = np.zeros((len(q), len(i_rows)), np.uint8)
        for c in range(COUNTED):
            low = np.searchsorted(along[:, c], counted[q, c] - plan.window, side="left").astype(np.uint16)
            high = np.searchsorted(along[:, c], counted[q, c] + plan.window, side="right").astype(np.uint16)
            # ranks from low on, below high: one comparison of unsigned differences
            hits += (rank[None, :, c] - low[:, None]) < (high - low)[:, None]
        a, b = np.nonzero(hits >= plan.least)
        a, b = q[a], i_rows[b]
        some = nodes[a] < nodes[b]
        a, b = a[some], b[some]
        for k in range(0, len(a), 65536):
            x, y = a[k : k + 65536], b[k : k + 65536]
            close = np.einsum("ij,ij->i", v[x], v[y]) >= plan.threshold
            x, y = x[close], y[close]
            first = _first_meeting(plan, dim, table, p[x], p[y])
            found.append((x[first], y[first]))
    x, y = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    # a vector may be in the block on both sides
    names, place = np.unique(nodes, return_inverse=True)
    x, y = place[x], place[y]
    times = np.zeros(len(names), np.int64)
    times[place] = copies
    links = np.bincount(x, times[y], len(names)) + np.bincount(y, times[x], len(names))
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = links > 0
    return names[some], names[root[some]], links[some].astype(np.int64)


def distinct_vectors(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, k1, k2; keys null if the vector cannot link), and the distinct vectors (node, vector, copies, first_id, k1, k2)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0)
    fine &= F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.when(fine, v).alias("v"))
    rows = rows.select("_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("k1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v")).alias("k2"))
    some = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("_id").alias("first_id"))

    def raw(batches):
        for b in batches:
            values = b.column("v")
            ends = values.offsets.to_numpy() if values.offset == 0 else np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy())))
            flat = values.flatten().to_numpy(zero_copy_only=False)
            base = ends[0]
            packed = [flat[s - base : e - base].tobytes() for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("k1", "k2", "copies", "first_id")} | {"vector": pa.array(packed, pa.binary())})

    kind = rows.schema["_id"].dataType.simpleString()
    nodes = some.mapInArrow(raw, f"k1 bigint, k2 bigint, copies bigint, first_id {kind}, vector binary")
    return rows.select("_id", "k1", "k2"), settle(nodes.withColumn("node", F.monotonically_increasing_id()))


def make_plan(nodes: DataFrame, threshold: float) -> Plan:
    """Sizes from the number of vectors, medians from a bounded sample of them."""
    counts = {r["d"]: r["n"] for r in nodes.groupBy((F.octet_length("vector") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}
    bits = {d: max(0, math.ceil(math.log2(n / CELL))) if n > CELL else 0 for d, n in counts.items()}
    total = max(1, sum(counts.values()))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, total // SAMPLE))) == 0).limit(4 * SAMPLE).select("vector").toArrow()
    cuts = {d: np.zeros(TABLES * k) for d, k in bits.items()}
    for chunk in sample.to_batches():
        for _, v in _by_dim(chunk) if chunk.num_rows else ():
            d = v.shape[1]
            if bits[d]:
                cuts[d] = np.median((v @ directions(d, max(COUNTED, TABLES * bits[d])))[:, : TABLES * bits[d]], axis=0)
    return Plan(bits, cuts, threshold)


def cell_rows(nodes: DataFrame, shared) -> DataFrame:
    """Every vector's stored and probing rows: tbl, dim, cell, stored, node, copies, vector."""

    def run(batches):
        for batch in batches:
            plan, node, copies, raw = shared.value, batch.column("node").to_numpy(), batch.column("copies").to_numpy(), batch.column("vector")
            for rows, v in _by_dim(batch):
                p, dim = plan.project(v), v.shape[1]
                for table in range(TABLES):
                    sign, both = plan.sides(p, dim, table)
                    for stored in (True, False):
                        owner, code = _codes(sign, both & (not stored))
                        for at in range(0, len(owner), 20_000):
                            o, c = rows[owner[at : at + 20_000]], code[at : at + 20_000]
                            yield pa.RecordBatch.from_pydict({
                                "tbl": pa.array(np.full(len(o), table, np.int32)), "dim": pa.array(np.full(len(o), dim, np.int32)), "cell": pa.array(c),
                                "stored": pa.array(np.full(len(o), stored)), "node": pa.array(node[o]), "copies": pa.array(copies[o]), "vector": raw.take(pa.array(o)),
                            })

    return nodes.select("node", "copies", "vector").mapInArrow(run, "tbl int, dim int, cell bigint, stored boolean, node bigint, copies bigint, vector binary")


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root, links) rows: sum links by node; node and root are connected."""
    shared = nodes.sparkSession.sparkContext.broadcast(make_plan(nodes, threshold))
    rows = cell_rows(nodes, shared)
    cell = ["tbl", "dim", "cell"]
    n = lambda side, size: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("stored") == side, 1).otherwise(0)) / size)).cast("int")
    sizes = rows.groupBy(*cell).agg(n(True, STORED_BLOCK).alias("_si"), n(False, PROBE_BLOCK).alias("_sq"))
    # only cells of several blocks need the join
    large = settle(sizes.where("_si > 1 or _sq > 1"))
    split = rows.join(large, cell, "left").withColumns({"_si": F.coalesce("_si", F.lit(1)), "_sq": F.coalesce("_sq", F.lit(1))})
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    all_of = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    split = split.withColumn("_i", F.explode(F.when(F.col("stored"), F.array(own("_si"))).otherwise(all_of("_si"))))
    split = split.withColumn("_q", F.explode(F.when(F.col("stored"), all_of("_sq")).otherwise(F.array(own("_sq"))))).drop("_si", "_sq")

    def run(key, found):
        out = (np.empty(0, np.int64),) * 3
        stored = found["stored"].to_numpy(zero_copy_only=False) if found.num_rows else np.empty(0, bool)
        if stored.any() and not stored.all():
            v = unit(found["vector"].to_pylist())
            out = block_links(shared.value, key[0].as_py(), found["node"].to_numpy(), found["copies"].to_numpy(), stored, v)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("node", "root", "links"), out)})

    return split.groupBy(*cell, "_i", "_q").applyInArrow(run, "node bigint, root bigint, links bigint")


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id and kept of every row of ``df``."""
    rows, nodes = distinct_vectors(df, id, vector)
    found = settle(links(nodes, threshold))
    component = settle(connected_components(found.select("node", "root")))
    linked = found.groupBy("node").agg(F.sum("links").alias("_links"))
    placed = nodes.join(linked, "node", "left").join(component, "node", "left").withColumn("_root", F.coalesce("component", "node"))
    least = placed.groupBy("_root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "_root").select("k1", "k2", "component_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"))
    own = F.when(F.col("k1").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.join(settle(named), ["k1", "k2"], "left").select(
        F.col("_id").alias(id), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept")
    )
