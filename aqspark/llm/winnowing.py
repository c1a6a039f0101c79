"""Benchmark decontamination by winnowing, in built-in functions only.

Every run of ``GRAM`` words has a hash, and of the hashes of each window of
``WINDOW`` words the smallest is its fingerprint. Two equal windows have equal
fingerprints, so each shared span of ``WINDOW`` words or more meets in the join
of fingerprints. A hit is extended to all windows that hold it, and these are
compared word for word with the windows of the items. An item of fewer words is
one window of its own length; fingerprints are taken for each length that the
items have (at most ``WINDOW`` lengths).

The join is on fingerprints first, which only filters, and then on whole
windows, of which a place in a document equals at most one; so a phrase that is
common to many items and documents makes no pairs of them. Texts are told apart
by a 128-bit hash, and copies share one result.

Defined results: null and blank texts have no words and no hits; an item without
words never occurs; rows of one item id are one item; an item with a null id
marks words but isn't counted or listed; every row of ``documents`` gives one
row; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.session import settle

WINDOW = 10
GRAM = 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE_BITS = 31  # a fingerprint and its place share a long: 32 bits of hash, 31 of place


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; null gives an empty text."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    return F.when(plain, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAKS), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def gram_size(length: int) -> int:
    return min(GRAM, length)


def gram_hashes(ws: Column, size: int) -> Column:
    """32-bit hash of the ``size`` words from each place on; needs that many words."""
    rest = lambda i: (F.get(ws, i + k) for k in range(1, size))
    starts = F.slice(ws, F.lit(1), F.size(ws) - (size - 1))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *rest(i)).bitwiseAND(F.lit(0xFFFFFFFF)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def smallest(values: Column, width: int) -> Column:
    """Smallest of each ``width`` neighbours, by doubling what a value speaks for."""
    cut = lambda a: F.slice(a, F.lit(1), F.size(a) - (width - 1))

    def widened(a: Column, span: int) -> Column:
        if span == width:
            return a
        step = min(span, width - span)
        return let(a, lambda x: widened(F.zip_with(x, F.slice(x, F.lit(step + 1), F.size(x)), lambda p, q: F.least(p, q)), span + step))

    return let(widened(values, 1), cut)


def fingerprints(ws: Column, length: int) -> Column:
    """Hash and place of the smallest gram of each window of ``length`` words, equal ones once."""
    size = gram_size(length)
    grams = F.transform(gram_hashes(ws, size), lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
    return F.when(F.size(ws) >= length, F.array_distinct(smallest(grams, length - size + 1)))


def benchmark_windows(items: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(_window, _len, _text, _print) of the distinct windows and (_window, _item) of their items, both stored."""
    ws = items.select(F.col(f"`{id}`").cast("string").alias("_item"), words(F.col(f"`{text}`")).alias("_words")).where(F.size("_words") > 0)
    ws = ws.withColumn("_len", F.least(F.size("_words"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("_words") - F.col("_len") + 1)
    every = settle(
        ws.select("_item", "_len", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("_words", s, F.col("_len")), " "))).alias("_text"))
        .distinct()
    )
    own = F.split("_text", " ")
    prints = F.lit(None).cast("long")
    for n in range(1, WINDOW + 1):
        prints = F.when(F.col("_len") == n, F.array_min(gram_hashes(own, gram_size(n)))).otherwise(prints)
    distinct = every.select("_len", "_text").distinct().select("_len", "_text", prints.alias("_print"))
    windows = settle(distinct.withColumn("_window", F.monotonically_increasing_id()))
    listed = every.where("_item is not null").join(windows, ["_len", "_text"]).select("_window", "_item")
    return windows, settle(listed)


def find(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(_key, _len, _start, _window) of each window in a text of ``docs``, by the text's key, and the items of windows."""
    windows, listed = benchmark_windows(items, id, item_text)
    lengths = sorted(r[0] for r in windows.select("_len").distinct().collect())  # at most WINDOW numbers
    body = F.col(f"`{text}`")
    keyed = docs.where(body.isNotNull()).select(text_key(body).alias("_key"), words(body).alias("_words"))
    if not lengths:
        lengths = [WINDOW]
    per_length = [F.struct(F.lit(n).alias("_len"), fingerprints(F.col("_words"), n).alias("_prints")) for n in lengths]
    prints = keyed.select("_key", F.inline(F.array(*per_length))).select("_key", "_len", F.explode("_prints").alias("_print"))
    prints = prints.select("_key", "_len", F.shiftright("_print", PLACE_BITS).alias("_print"), F.col("_print").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("_at"))
    known = settle(windows.select("_len", "_print").distinct())
    met = settle(
        prints.join(known, ["_len", "_print"], "left_semi")
        .groupBy("_key").agg(F.collect_set(F.struct("_len", "_at")).alias("_met"))
    )

    # the windows around a hit: those of its length that hold its gram
    def around(p: Column) -> Column:
        grams = F.least(p["_len"], F.lit(GRAM))
        first = F.greatest(p["_at"] - (p["_len"] - grams), F.lit(0))
        last = F.least(p["_at"], F.size("_words") - p["_len"])
        return F.transform(F.sequence(first, last), lambda s: F.struct(p["_len"].alias("_len"), s.alias("_start")))

    starts = F.array_distinct(F.flatten(F.transform("_met", around)))
    whole = lambda s: F.struct(s["_len"].alias("_len"), s["_start"].alias("_start"), F.array_join(F.slice("_words", s["_start"] + 1, s["_len"]), " ").alias("_text"))
    texts = docs.where(body.isNotNull()).select(text_key(body).alias("_key"), body.alias("_body")).join(met, "_key")
    texts = texts.select("_key", words(F.col("_body")).alias("_words"), "_met")
    spans = texts.select("_key", F.inline(F.transform(starts, whole)))
    return spans.join(windows.drop("_print"), ["_len", "_text"]).select("_key", "_len", "_start", "_window").distinct(), listed


def covered(spans: Column) -> Column:
    """Number of places that sorted (start, end) spans cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], x["end"]).alias("end")
    )
    return F.aggregate(spans, zero, step, lambda s: s["n"])


def scan(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted ids as strings, comma-joined) and contaminated of every row of ``docs``."""
    hits, listed = find(docs, items, text, item_id, item_text)
    hits = settle(hits)
    places = hits.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_len")).alias("end")))).alias("_spans"))
    found = hits.select("_key", "_window").distinct().join(listed, "_window").select("_key", "_item").distinct()
    found = found.groupBy("_key").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    result = settle(
        places.select("_key", covered(F.col("_spans")).alias("n_hit")).join(found, "_key", "left")
        .select("_key", "n_hit", F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.array_join("_items", ",").alias("items"))
    )
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{id}`").alias("_id"), text_key(body).alias("_key"), F.size(words(body)).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(result, "_key", "left").select(
        F.col("_id").alias(id), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
