"""Quality rules by distribution divergence, in built-in functions only.

Each text gives two histograms: characters by class, and its letter runs by the
common words of its language (plus all others). Both are compared with the
language's reference by Jensen-Shannon distance (base two, so 0 to 1). The
references are the summed histograms of the rows of that language that pass the
base rules and lie near the sum of all of them. A distance is judged only if the text is long enough for it.

Defined results: null text has no words and fails the base rules; a null or
unlisted language has no reference, so only the base rules count; equal rows
give equal rows; other columns are ignored or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.llm.common import WORD_BREAKS, packed, unpacked
from aqspark.session import settle

MIN_WORDS = 50
MIN_CHARS = 200  # of the text, for the distance of character classes
MIN_LETTER_WORDS = 120  # letter runs, for the distance of common words
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.40
MAX_BOTH = (0.165, 0.22)  # of classes and of common words, where both are exceeded
NEAR_DISTANCE = 0.20  # of classes, for rows that make the reference

# fixed values: frequent words of each language
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
CLASSES = 6  # lower case, white space, upper case, digits, sentence marks, all else


def words(text: Column) -> Column:
    """Array of words; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAKS))


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = df.withColumns({"_words": words(F.col(f"`{text}`")), "_lines": lines})
    out = out.withColumns({"n_words": F.size("_words").cast("long")})
    # a window of three words is known by its hash and the place of its first word
    hashes = F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - 2),
        lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)),
    )
    out = out.withColumn("_hashes", F.when(F.col("n_words") >= 4, hashes))
    windows = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    several = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn("_windows", F.when(several, windows))

    def met_again(x: Column, k: Column) -> Column:
        hash_at = lambda i: F.get("_windows", i)["h"]
        return F.coalesce(x["h"] == hash_at(k - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(k + 1), F.lit(False))

    fields = F.filter("_windows", met_again)
    starts = F.sort_array(F.transform(fields, lambda x: x["p"]))
    # each window covers three words; what the window before covers counts once
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-10).alias("last"))
    covered = F.aggregate(
        starts, first, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).cast("long").alias("n"), p.alias("last")), lambda s: s["n"]
    )
    out = out.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_windows").isNull(), F.lit(0).cast("long")).otherwise(covered),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines", "_hashes", "_windows")


def histograms(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with ``_classes`` and ``_common``, arrays of counts (the latter null without a listed language)."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = df.withColumns({"_s0": whole, "_s1": F.regexp_replace(whole, r"\p{Ll}+", "")})
    for k, pattern in enumerate((r"\s+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?'\"()-]+"), 2):
        out = out.withColumn(f"_s{k}", F.regexp_replace(f"_s{k - 1}", pattern, ""))
    sizes = [F.length(f"_s{k}") for k in range(CLASSES)]
    classes = F.array(*(a - b for a, b in zip(sizes, sizes[1:])), sizes[-1])
    out = out.withColumns({"_classes": classes.cast("array<double>"), "_runs": F.btrim(F.regexp_replace(F.lower(whole), r"[^\p{L}]+", "  "), F.lit(" "))})
    out = out.withColumn("_runs", F.concat(F.lit(" "), "_runs", F.lit(" ")))
    runs, found = F.col("_runs"), F.lit(None).cast("array<double>")
    # two blanks between letter runs, so each has its own
    total = F.when(runs == "  ", F.lit(0)).otherwise(F.length(runs) - F.length(F.replace(runs, F.lit("  "), F.lit(" "))) + 1)
    for code, common in COMMON_WORDS.items():
        counts = [(F.length(runs) - F.length(F.replace(runs, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in common]
        found = F.when(F.col(f"`{lang}`") == code, F.array(*counts).cast("array<double>")).otherwise(found)
    out = out.withColumns({"_common": found, "_n_runs": total.cast("double")})
    rest = F.greatest(F.col("_n_runs") - F.aggregate("_common", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    out = out.withColumn("_common", F.concat("_common", F.array(rest)))
    return out.drop(*(f"_s{k}" for k in range(CLASSES)), "_runs")


def references(features: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Reference histograms by language, from the rows near a first reference made from all rows.

    ``features`` is read twice, so it should be stored.
    """
    first = summed(features, lang)
    near = verdict(features, first, lang).where(F.coalesce("class_distance", F.lit(0.0)) <= NEAR_DISTANCE)
    return first | summed(near, lang)  # a language without rows near its sum keeps that


def summed(features: DataFrame, lang: str) -> dict[str, tuple[list[float], list[float]]]:
    """Summed histograms as shares: at most one row for each listed language reaches the driver."""
    sums = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))).alias(c)
    n_common = len(COMMON_WORDS["en"]) + 1
    rows = (
        features.where(~F.col("base_failed") & F.col(f"`{lang}`").isin(*COMMON_WORDS))
        .groupBy(F.col(f"`{lang}`").alias("lang"))
        .agg(sums("_classes", CLASSES), sums("_common", n_common))
    )
    share = lambda v: [x / max(sum(v), 1.0) for x in v]
    return {r["lang"]: (share(r["_classes"]), share(r["_common"])) for r in rows.collect()}


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram from shares; 0 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(p) + part(q)) / 2

    terms = F.zip_with(counts, reference, lambda c, q: term(c / total, q))
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(0.0))


def verdict(features: DataFrame, known: dict[str, tuple[list[float], list[float]]], lang: str = "lang") -> DataFrame:
    """``features`` with class_distance, word_distance (null where not judged) and kept."""
    judged = {"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")}
    for code, (classes, common) in sorted(known.items()):
        here = F.col(f"`{lang}`") == code
        literal = lambda v: F.array(*map(F.lit, v))
        chars = F.aggregate("_classes", F.lit(0.0), lambda s, x: s + x)
        judged["class_distance"] = F.when(here & (chars >= MIN_CHARS), distance(F.col("_classes"), literal(classes))).otherwise(judged["class_distance"])
        judged["word_distance"] = F.when(here & (F.col("_n_runs") >= MIN_LETTER_WORDS), distance(F.col("_common"), literal(common))).otherwise(judged["word_distance"])
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (by_class > MAX_CLASS_DISTANCE) | (by_word > MAX_WORD_DISTANCE) | ((by_class > MAX_BOTH[0]) & (by_word > MAX_BOTH[1]))
    return features.withColumns(judged).withColumn("kept", ~F.col("base_failed") & ~far)


def features(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return histograms(base_columns(df, text), text, lang)


def score(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, the base columns, both distances and ``kept`` of every row of ``df``."""
    narrow = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    found = settle(features(narrow, "_text", "_lang").drop("_text"))
    return verdict(found, references(found, "_lang"), "_lang").drop("_lang", "_classes", "_common", "_n_runs").withColumnRenamed("_id", id)


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns.

    The verdict follows from text and language alone, so the rejected ones are
    known by a 128-bit hash of both and taken out by an anti join.
    """
    rows = packed(df)
    columns = [F.col("_row").getField(c) for c in (text, lang)]
    parts = [x for c in columns for x in (c.isNull(), c)]
    keys = [F.xxhash64(F.lit(seed), *parts).alias(f"_key{seed}") for seed in (1, 2)]
    narrow = rows.select(columns[0].alias("_text"), columns[1].alias("_lang"), *keys)
    found = settle(features(narrow, "_text", "_lang").drop("_text"))
    rejected = settle(verdict(found, references(found, "_lang"), "_lang").where("not kept").select("_key1", "_key2").distinct())
    return unpacked(rows.select("_row", *keys).join(rejected, ["_key1", "_key2"], "left_anti"), df.columns)
