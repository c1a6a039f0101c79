"""Helpers shared by the text operators: words, Arrow batches, components.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aqspark.session import settle

WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Texts are handled in slices of at most this many bytes (one text may be longer).
SLICE_BYTES = 16 << 20


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with all its columns in one struct, so that names of later columns clash with none."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "_row") -> DataFrame:
    """The columns of a struct as they were."""
    return df.select(*(F.col(name).getField(c).alias(c) for c in columns))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; none for null."""
    return text.encode().split() if text else []


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of a string array, each within ``limit`` bytes unless it is one text."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def encoded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the index of each word of all texts, and each text's bounds in that list."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not keep.all():  # leading and trailing breaks leave empty strings
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
        flat = flat.filter(pa.array(keep))
        sizes = np.bincount(owner, minlength=len(sizes))
    coded = flat.dictionary_encode()
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), bounds


def map_batches(df: DataFrame, schema: str | StructType, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns (or yields) dicts of columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for columns in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    ``edges`` has two long columns. Large-star and small-star rounds rewrite the
    edge table until each component is a star around its smallest node; each
    round is written to the shared folder, so no round is ever computed twice.
    A node's neighbours are reduced to their minimum before they are joined
    back, and the join may split a node with many neighbours over tasks.
    """
    a, b = edges.columns
    now = settle(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = settle(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
