"""Language of texts: scripts narrow the candidates, Viterbi labels the words.

A model holds, for each language, log shares of hashed character runs (one to
``LONGEST`` letters, with word ends marked) and the scripts its training texts
are written in. A word is scored in the languages of its script. Over the words
of a text, the best path of labels is found, each change of language costing
``SWITCH``; spans of mixed texts follow from the path. The text's language is
the one that labels most letters; the score is its share of letters.

All rows with a language train; counts are summed by Spark, and only the model
(languages x ``BUCKETS`` numbers, languages being few) reaches the driver.
Defined results: null text and text without letters is ``und`` with score 0, as
is every text if nothing could be learned; ties go to the first language in
code-point order; equal rows give equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.common import encoded_words, map_batches, slices

LONGEST = 4
BUCKETS = 1 << 16
SMOOTH = 0.5
SWITCH = 12.0
MIN_SCRIPT_SHARE = 0.005
UNKNOWN = "und"

# fixed values: first code point of each range and its script (0: none of these)
SCRIPTS = (
    (0x0041, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8),
    (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 13), (0x3100, 0), (0x3130, 12), (0x3190, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14),
    (0xFB00, 1), (0xFB07, 0), (0xFF21, 1), (0xFF5B, 0), (0xFF66, 13), (0xFFA0, 12), (0xFFE0, 0), (0x20000, 14), (0x32000, 0),
)
N_SCRIPTS = 15
_STARTS, _SCRIPT = np.array([s for s, _ in SCRIPTS]), np.array([0, *(k for _, k in SCRIPTS)])
NO_LETTER = regex.compile(r"[^\p{L}\p{M}\n]+|(?<![\p{L}\p{M}])\p{M}+")  # marks count with the letter before them


def letter_words(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words' letters in lower case, each word between two zeros; and each word's letters."""
    # words hold no line feed; one that lower-cases to another length stays one word
    letters = NO_LETTER.sub("", "\n".join(vocabulary).lower()).split("\n") if vocabulary else []
    sizes = np.fromiter(map(len, letters), np.int64, len(letters))
    points = np.frombuffer("".join(f"\0{w}\0" for w in letters).encode("utf-32-le"), np.uint32)
    return points, sizes


def runs(points: np.ndarray, sizes: np.ndarray):
    """(bucket, word) of every run of letters, one array pair for each run length."""
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    has = sizes[owner] > 0
    h = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(points) - n + 1
        if m < 1:
            return
        h = (h[:m] ^ points[n - 1 :].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        inside = (owner[:m] == owner[n - 1 :]) & has[:m]
        if n == 1:
            inside &= points > 0
        at = np.flatnonzero(inside)
        yield (h[at] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), owner[at]


def scripts(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Script of each word's first letter; 0 for words without letters."""
    first = np.cumsum(sizes + 2) - sizes - 1
    return np.where(sizes > 0, _SCRIPT[np.searchsorted(_STARTS, points[np.minimum(first, len(points) - 1)], side="right")], 0) if len(sizes) else sizes


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, log shares
    written: np.ndarray  # scripts x languages, whether the language uses the script

    def word_scores(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log likelihood of each word by language, the best one 0; nothing for words without a known script."""
        total = np.zeros((len(sizes), len(self.languages)))
        for bucket, owner in runs(points, sizes):
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, self.scores[bucket, k], len(sizes))
        allowed = self.written[scripts(points, sizes)]
        known = allowed.any(axis=1) & (sizes > 0)
        total = np.where(allowed, total, -1e6)
        return np.where(known[:, None], total - total.max(axis=1, keepdims=True, initial=-1e9), 0.0)


def best_paths(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of each word on the best path of its text; all texts of a batch advance together."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    labels = np.zeros(len(scores), np.int64)
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return labels
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t
    value = np.zeros((int(live[0]), scores.shape[1]))
    came: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(steps):
        n = live[t]
        now = value[:n]
        top = now.argmax(axis=1)
        best = now[np.arange(n), top] - switch
        change = now < best[:, None]
        came.append((change, top))
        value[:n] = np.where(change, best[:, None], now) + scores[first[:n] + t]
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        labels[first[:n] + t] = state[:n]
        change, top = came[t]
        state[:n] = np.where(change[np.arange(n), state[:n]], top, state[:n])
    return labels


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of the languages of ``df``; rows without text or language do not count."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{lang}`").alias("_lang")).where("_text is not null and _lang is not null")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for at, part in slices(batch.column(0)):
                vocabulary, index, bounds = encoded_words(part)
                points, sizes = letter_words(vocabulary)
                kind, every = scripts(points, sizes), list(runs(points, sizes))
                by_text = names[at : at + len(part)]
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                for name in set(by_text.tolist()):
                    uses = np.bincount(index[(by_text == name)[owner]], minlength=len(vocabulary)).astype(float)
                    counts = found.setdefault(name, np.zeros(BUCKETS + N_SCRIPTS))
                    for bucket, word in every:
                        counts[:BUCKETS] += np.bincount(bucket, uses[word], BUCKETS)
                    counts[BUCKETS:] += np.bincount(kind, uses * sizes, N_SCRIPTS)
        for name, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(name), len(at)), "cell": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})

    cells = rows.mapInArrow(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(cells["lang"]), key=lambda x: x.encode())
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    counts[cells["cell"].to_numpy(np.int64), cells["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64)] = cells["n"]
    letters, used = counts[:BUCKETS] + SMOOTH, counts[BUCKETS:]
    written = used > MIN_SCRIPT_SHARE * np.maximum(used.sum(axis=0), 1)
    written[0] = False
    return Model(languages, np.log(letters / letters.sum(axis=0)), written)


SPANS = "array<struct<first:int,last:int,lang:string>>"
_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))


def identify(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, lang_pred, score and spans (first and last word, language) of every row of ``df``."""
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        known = shared.value
        for at, part in slices(batch.column(1)):
            names, shares, spans = [UNKNOWN] * len(part), np.zeros(len(part)), [[] for _ in range(len(part))]
            if known.languages:
                vocabulary, index, bounds = encoded_words(part)
                points, sizes = letter_words(vocabulary)
                labels = best_paths(known.word_scores(points, sizes)[index], bounds, switch)
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                n = len(known.languages)
                votes = np.bincount(owner * n + labels, sizes[index], len(part) * n).reshape(len(part), n)
                total, best = votes.sum(axis=1), votes.argmax(axis=1)
                shares = np.where(total > 0, votes.max(axis=1) / np.maximum(total, 1), 0.0)
                names = [known.languages[k] if t > 0 else UNKNOWN for k, t in zip(best, total)]
                turn = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
                for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(labels)]):
                    doc = owner[a]
                    if total[doc]:
                        spans[doc].append({"first": a - int(bounds[doc]), "last": b - 1 - int(bounds[doc]), "lang": known.languages[labels[a]]})
            yield {"_id": batch.column(0).slice(at, len(part)), "lang_pred": pa.array(names, pa.string()), "score": pa.array(shares, pa.float64()), "spans": pa.array(spans, _ARROW)}

    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, f"_id {kind}, lang_pred string, score double, spans {SPANS}", run).withColumnRenamed("_id", id)


def held_out(id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text (null: empty) divisible by five."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 5 == 0
