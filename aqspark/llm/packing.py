"""Bounded-space online packing of token sequences.

Each partition keeps ``open_windows`` windows. A document fills windows of its
own as long as it can; what remains goes to the open window it fits best. When
none fits, the fullest is emitted, topped up with the head of the document if
at least ``min_cut`` ids go into it and as many remain. At the end, the open
windows of up to ``merge`` partitions are laid end to end and cut into windows
again, so each such group leaves one partly filled sequence.

The first pass is stored before the leftovers are merged, so a lost executor
cannot change which windows are left over. Defined results: null or empty text
is the single end id; rows with equal ids are packed one by one; an empty table
gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.tokens import text_tokens
from aqspark.session import settle

WINDOW = 2048
OPEN_WINDOWS = 16
MIN_CUT = 32
MERGE = 8
END_ID = 1
#: Sequence ids: partition (or merged group, above this bit) in the high part, a count in the low 32 bits.
MERGED = 1 << 62

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """Open windows of one partition; pieces are (document, start, length, crc, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, min_cut: int) -> None:
        self.window, self.limit, self.min_cut = window, open_windows, min_cut
        self.free: list[int] = []
        self.held: list[list] = []
        self.emitted = 0

    def add(self, doc, ids: bytes):
        """Yield (sequence number, offset, piece) for each window that is emitted."""
        total, at = len(ids) // 4, 0

        def piece(n: int) -> tuple:
            raw = ids[4 * at : 4 * (at + n)]
            return doc, at, n, zlib.crc32(raw), raw, total

        while total - at >= self.window:
            yield from self.emit([piece(self.window)])
            at += self.window
        while at < total:
            rest = total - at
            fits = [(f, k) for k, f in enumerate(self.free) if f >= rest]
            if fits:
                k = min(fits)[1]
            elif len(self.free) < self.limit:
                self.free.append(self.window)
                self.held.append([])
                k = len(self.free) - 1
            else:
                k = min(range(len(self.free)), key=self.free.__getitem__)
                room = self.free[k]
                if min(room, rest - room) >= self.min_cut:
                    self.held[k].append(piece(room))
                    at += room
                yield from self.emit(self.held[k])
                self.free[k], self.held[k] = self.window, []
                continue
            self.held[k].append(piece(rest))
            self.free[k] -= rest
            at = total
            if not self.free[k]:
                yield from self.emit(self.held.pop(k))
                self.free.pop(k)

    def emit(self, pieces: list):
        offset = 0
        for p in pieces:
            yield self.emitted, offset, p
            offset += p[2]
        self.emitted += 1

    def leftovers(self):
        for pieces in self.held:
            yield from self.emit(pieces)


def pack(
    df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", ids: bool = False,
    window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, merge: int = MERGE,
) -> DataFrame:
    """One row for each piece of a document in a sequence: id and the columns of ``PIECE``.

    ``tokenizer`` is the path of a vocabulary file on every executor. With
    ``ids``, a binary column holds the piece's little-endian 32-bit ids.
    """
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def first_pass(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, min_cut)
        id_type = None

        def table(found: list, still_open: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "_id": pa.array([p[0] for _, _, p in found], id_type),
                **{c: pa.array([p[k] for _, _, p in found], pa.int64()) for k, c in ((1, "start"), (2, "length"), (3, "ids_crc32"), (5, "doc_tokens"))},
                "sequence_id": pa.array([part << 32 | n for n, _, _ in found], pa.int64()),
                "offset": pa.array([o for _, o, _ in found], pa.int64()),
                "ids": pa.array([p[4] if ids or still_open else None for _, _, p in found], pa.binary()),
                "_open": pa.array([still_open] * len(found)),
            })

        for batch in batches:
            id_type, found = batch.column(0).type, []
            for doc, tokens in zip(batch.column(0).to_pylist(), text_tokens(batch.column(1), tokenizer)):
                found += packer.add(doc, tokens.tobytes() + END_ID.to_bytes(4, "little"))
                if len(found) >= 5000:
                    yield table(found, False)
                    found = []
            if found:
                yield table(found, False)
        if packer.held:
            yield table(list(packer.leftovers()), True)

    columns = PIECE + ", ids binary"
    stored = settle(rows.mapInArrow(first_pass, f"_id {kind}, {columns}, _open boolean"))

    def merged(key, found):
        found = found.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        base, filled, out = MERGED | key[0].as_py() << 32, 0, []
        for row in found.to_pylist():
            at = 0
            while at < row["length"]:
                n = min(row["length"] - at, window - filled % window)
                raw = row["ids"][4 * at : 4 * (at + n)]
                out.append(row | {"start": row["start"] + at, "length": n, "ids_crc32": zlib.crc32(raw), "ids": raw if ids else None,
                                  "sequence_id": base | filled // window, "offset": filled % window})
                at, filled = at + n, filled + n
        schema = pa.schema([f for f in found.schema if f.name != "_group"])
        return pa.Table.from_pylist([{k: v for k, v in r.items() if k != "_group"} for r in out], schema)

    group = F.shiftright(F.shiftright("sequence_id", 32), merge.bit_length() - 1)
    left = stored.where("_open").drop("_open").withColumn("_group", group)
    joined = left.groupBy("_group").applyInArrow(merged, f"_id {kind}, {columns}")
    out = stored.where("not _open").drop("_open").union(joined).withColumnRenamed("_id", id)
    return out if ids else out.drop("ids")
