"""Mixing sources to target weights, in built-in functions only.

The words of each source's documents, laid end to end in a pseudorandom order
of documents, are packed into blocks of a fixed length (a source's last block
may be shorter). Each source gets a number of slots from its target. Every slot
of an output shard draws its source by the slots' shares, so the shard's counts
are multinomial; draws beyond a source's slots go to the sources that were drawn
too seldom, so the totals hold. A source's k-th slot takes block pi(k mod n) of
its n blocks, pi a keyed permutation of that source and pass (swap-or-not: each
round pairs x with key - x and swaps by a keyed bit). Slots and blocks are then
joined by index.

All choices come from ``seed`` and the rows, so reruns agree. Sources are few:
their totals, one row for each, are the only rows that reach the driver.
Defined results: null text has no words; a null source is a source of its own,
placed last; documents without words get no slots; equal rows are placed one
after the other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark.llm.common import WORD_BREAKS, packed
from aqspark.session import settle

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # share of all words that the mix takes
MAX_REPEATS = 2
BLOCK = 64  # words
SHARD_SLOTS = 4096
TASK_SLOTS = 100_000  # slots that one task makes
SPREAD = 1024  # ranges of each source's document order, summed apart
ROUNDS = 10
SEED = 7
PRIME = 2_147_483_647  # keyed bits are read from squares modulo this prime


def keyed(text: str) -> int:
    """A 60-bit number of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def order_key(id: Column) -> Column:
    """The same number of a document's id, as a column."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Source:
    at: int  # place in code-point order, nulls last
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS) -> list[float]:
    """Words for each source: shares of the budget by weight; what a source cannot take goes to the others."""
    pairs = [(repeats * n, weights[k % len(weights)], k) for k, n in enumerate(sizes)]
    left, weight, out = budget * sum(sizes), sum(w for _, w, _ in pairs), [0.0] * len(pairs)
    full = True
    for cap, w, k in sorted(pairs, key=lambda p: (p[0] / p[1], p[2])):
        # from the first source that can take its share on, all can
        full = full and left * w > cap * weight
        out[k] = float(cap) if full else left * w / weight
        if full:
            left, weight = left - cap, weight - w
    return out


def plan_sources(rows: list[tuple[str | None, int]], block: int = BLOCK) -> list[Source]:
    rows = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    out = []
    for at, ((name, size), target) in enumerate(zip(rows, targets([n for _, n in rows]))):
        blocks = -(-size // block)
        slots = min(MAX_REPEATS * blocks, math.floor(target / (size / blocks) + 0.5)) if blocks else 0
        out.append(Source(at, name, size, target, blocks, slots))
    return out


def lookup(values: list, at: Column, kind: str) -> Column:
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), at)


def permuted(k: Column, n: Column, keys: Column) -> Column:
    """k's place under the permutation of 0..n-1 that the array ``keys`` (key, salt of each round) gives."""

    def round_(x: Column, i: Column) -> Column:
        partner = F.pmod(F.element_at(keys, 2 * i + 1) - x, n)
        seen = (F.greatest(x, partner) + F.element_at(keys, 2 * i + 2)) % PRIME
        return F.when((seen * seen % PRIME) % 2 == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), k, round_)


def round_keys(source: Source, turn: int, seed: int = SEED) -> list[int]:
    parts = [keyed(f"{seed}:{source.at}:{turn}:{r}") for r in range(2 * ROUNDS)]
    return [p % max(source.blocks, 1) if r % 2 == 0 else p % PRIME for r, p in enumerate(parts)]


def sized(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """id, source, size and order key of each row."""
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD_BREAKS.replace("[", "[^"))).cast("long")
    return df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), size.alias("_size"), order_key(F.col(f"`{id}`")).alias("_key"))


def placed(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """``rows`` with the source's place ``_at`` and the document's first word ``_start`` in its source.

    Documents of a source are summed in ranges of the order key first, so no
    task gets a whole source.
    """
    names = {s.name: s.at for s in sources}
    known = F.create_map(*(x for n, at in names.items() if n is not None for x in (F.lit(n), F.lit(at)))) if any(n is not None for n in names) else None
    at = F.lit(names.get(None, -1)) if known is None else F.coalesce(F.element_at(known, F.col("_source")), F.lit(names.get(None, -1)))
    rows = rows.withColumns({"_at": at.cast("int"), "_range": F.shiftright("_key", 60 - SPREAD.bit_length() + 1).cast("int")})
    sums = rows.groupBy("_at", "_range").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_at").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_at", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_at", "_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    return rows.join(sums, ["_at", "_range"]).withColumn("_start", start).drop("_base")


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of documents in blocks: _at, block, and the piece's start in its document and length."""
    first, last = F.col("_start"), F.col("_start") + F.col("_size")
    number = F.explode(F.sequence(F.floor(first / block), F.floor((last - 1) / block)))
    cut = rows.where("_size > 0").select("*", number.alias("block"))
    begin = F.greatest(F.col("block") * block, first)
    return cut.withColumns({"piece_start": begin - first, "piece_length": F.least((F.col("block") + 1) * block, last) - begin})


def slots(df: DataFrame, sources: list[Source], seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the mix: shard, _at (source), block."""
    spark, total = df.sparkSession, sum(s.slots for s in sources)
    ends = [sum(s.slots for s in sources[: k + 1]) for k in range(len(sources))]
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1)))
    at = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= drawn))
    # the counts of each shard: one draw for each of its slots
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), at.alias("_at"))
    counts = settle(draws.groupBy("shard", "_at").count())
    before = Window.partitionBy("_at").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    got = {r["_at"]: r["n"] for r in counts.groupBy("_at").agg(F.sum("count").alias("n")).collect()}
    # draws beyond a source's slots, numbered on, fill the sources drawn too seldom
    over, short, base = {}, [], 0
    for s in sources:
        over[s.at] = base
        base += max(0, got.get(s.at, 0) - s.slots)
        short.append(max(0, s.slots - got.get(s.at, 0)))
    short_ends = [sum(short[: k + 1]) for k in range(len(short))]
    own = lambda values, col="_at": lookup(values, F.col(col), "long")
    spread = counts.repartition(max(1, total // TASK_SLOTS), "shard")  # few rows become many
    numbered = spread.select("shard", "_at", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("count") - 1)).alias("_k"))
    extra = F.col("_k") - own([s.slots for s in sources])
    spare = own([over[s.at] for s in sources]) + extra
    taker = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in short_ends)), lambda e: e <= F.col("_spare")))
    moved = numbered.withColumn("_spare", F.when(extra >= 0, spare)).withColumn("_to", F.when(F.col("_spare").isNull(), F.col("_at")).otherwise(taker))
    rank = own([got.get(s.at, 0) for s in sources], "_to") + F.col("_spare") - own([e - n for e, n in zip(short_ends, short)], "_to")
    final = moved.select("shard", F.col("_to").alias("_at"), F.coalesce(rank, F.col("_k")).alias("_k"))
    n = own([max(s.blocks, 1) for s in sources])
    keys = lookup_arrays([[round_keys(s, t, seed) for t in range(MAX_REPEATS)] for s in sources])
    final = final.withColumns({"_n": n, "_keys": F.get(F.get(keys, F.col("_at")), F.floor(F.col("_k") / n).cast("int"))})
    # stored, so that its size is known when it is joined
    return settle(final.select("shard", "_at", permuted(F.col("_k") % F.col("_n"), F.col("_n"), F.col("_keys")).alias("block")))


def lookup_arrays(values: list[list[list[int]]]) -> Column:
    return F.array(*(F.array(*(F.array(*(F.lit(x).cast("long") for x in turn)) for turn in turns)) for turns in values))


@dataclass(frozen=True)
class Mix:
    """Rows with their place, all sources, and the mix: one row for each piece in each shard."""

    rows: DataFrame
    sources: list[Source]
    pieces: DataFrame


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> Mix:
    """The mix of ``df``; ``pieces`` has shard, block, _at, _start, _id, piece_start and piece_length."""
    rows = settle(sized(df, id, text, source))
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("size"))
    sources = plan_sources([(r["_source"], r["size"]) for r in sizes.collect()])
    if not sources:
        empty = rows.withColumns({c: F.lit(0).cast("long") for c in ("shard", "block", "_at", "_start", "piece_start", "piece_length")})
        return Mix(rows.withColumns({"_at": F.lit(0), "_start": F.lit(0).cast("long")}), [], empty.where("false"))
    rows = settle(placed(rows, sources))
    taken = slots(df, sources, seed)
    # no side is broadcast: Spark sizes the blocks of a document as one row, and the slots by their packed files
    return Mix(rows, sources, blocks(rows).hint("merge").join(taken, ["_at", "block"]))


def document_totals(found: Mix, id: str = "doc_id") -> DataFrame:
    """id, size, source_size, target and taken (words in the mix, repeats counted) of every row."""
    # a document with words is known by its source and first word
    per = found.pieces.groupBy("_at", "_start").agg(F.sum("piece_length").alias("taken"))
    rows = found.rows.withColumn("_some", F.col("_size") > 0)
    per = per.withColumn("_some", F.lit(True))
    own = lambda values, kind: lookup(values, F.col("_at"), kind) if values else F.lit(None).cast(kind)
    return rows.join(per, ["_at", "_start", "_some"], "left").select(
        F.col("_id").alias(id), F.col("_size").alias("size"),
        own([s.size for s in found.sources], "long").alias("source_size"),
        own([s.target for s in found.sources], "double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars", seed: int = SEED) -> DataFrame:
    """``df``'s columns with the words that the mix takes of each document; documents not taken are gone.

    A document taken whole once keeps its text; whole several times, its text is
    repeated on new lines; else the pieces follow each other in order. Equal
    rows (same id, source and text) become one row with the pieces of all.
    """
    # the caller's columns stay in one struct, so that their names clash with none here
    rows = packed(df)
    own = lambda c: F.col("_row").getField(c)
    digest = F.xxhash64(F.lit(1), own(text))
    named = rows.select("_row", F.struct(own(id).alias("id"), digest.alias("digest")).alias("_ref"), own(text).alias("_text"), own(source).alias("_from"))
    found = mix(named, "_ref", "_text", "_from", seed)
    piece = F.struct(F.col("piece_start").alias("start"), F.col("piece_length").alias("length"), "shard")
    per = found.pieces.groupBy("_id", "_size", "_source").agg(F.sort_array(F.collect_list(piece)).alias("_pieces"), F.sum("piece_length").alias("_taken"))
    kept = named.dropDuplicates(["_ref", "_from"])
    same = kept["_ref"].eqNullSafe(per["_id"]) & kept["_from"].eqNullSafe(per["_source"])
    rows = kept.join(per, same)
    # bound to one value, as an expression inside a lambda is worked out for each piece
    words = F.array(F.split(F.btrim("_text", F.lit(" \t\n\x0b\x0c\r")), WORD_BREAKS))
    times = (F.col("_taken") / F.col("_size")).cast("int")
    cut = lambda ws: F.flatten(F.transform("_pieces", lambda p: F.slice(ws, (p["start"] + 1).cast("int"), p["length"].cast("int"))))
    joined = F.array_join(F.get(F.transform(words, cut), F.lit(0)), " ")
    starts = F.size(F.array_distinct(F.transform("_pieces", lambda p: p["start"])))
    complete = (F.col("_taken") == times * F.col("_size")) & (starts * times == F.size("_pieces"))
    new = F.when(complete, F.array_join(F.array_repeat("_text", times), "\n")).otherwise(joined)
    rows = rows.select("_row", new.alias("_new"))
    out = {c: own(c) for c in df.columns} | {text: F.col("_new")}
    if n_chars in df.columns:
        out[n_chars] = F.length("_new").cast(df.schema[n_chars].dataType)
    return rows.select(*(e.alias(c) for c, e in out.items()))
