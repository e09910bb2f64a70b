"""Quality rules, DataFrame functions only.

Base rules count repeated windows, repeated lines, symbols and words. The
verdict compares two histograms of a document with those of its language:
character classes, and common words (with one bin for all other words), by
Jensen-Shannon distance (base 2, 0 to 1). The language references are
counted over all documents that pass the base rules. Distances say little
about short texts, so documents below a least length are not judged by them,
nor are languages with too few words for a reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

# Common words by language (fixed values). Other languages are judged by character classes alone.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
}
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
# Character classes: lower, upper, digits, white space, non-ASCII; all others: one class more.
CLASSES = ["[a-z]+", "[A-Z]+", "[0-9]+", SPACE, r"[^\x00-\x7F]+"]

MIN_WORDS = 50            # documents below are not judged by distances
MIN_REFERENCE = 2000      # words a language needs for a reference
MOST_CHARACTERS = 0.28    # distance of character classes
MOST_WORDS = 0.20         # distance of common words of an endless text
NOISE = 1.05              # over the root of a text's length in words: what its sampling may add to that


def class_counts(d: DataFrame) -> DataFrame:
    """Adds ``chars``, the characters of ``_text`` by class, and ``n_symbols``.
    Class after class is taken out, so each pass reads what the ones before
    have left; each rest is used twice, so it is not evaluated again."""
    lengths = [F.length("_text")]
    rest = "_text"
    for i, runs in enumerate(CLASSES):
        d = d.withColumn(f"_r{i}", F.regexp_replace(rest, runs, ""))
        rest = f"_r{i}"
        lengths.append(F.length(rest))
    counts = [a - b for a, b in zip(lengths, lengths[1:])]
    return d.withColumn("chars", F.array(*counts, lengths[-1])) \
            .withColumn("n_symbols", (lengths[-1] - F.length(F.regexp_replace(rest, SYMBOLS, ""))).cast("long")) \
            .drop(*[f"_r{i}" for i in range(len(CLASSES))])


def base_counts(docs: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` with the words' array ``w`` and the base rules' counts. Each
    array is a column of its own, used twice or more, so that the optimizer
    does not move its expression into a lambda."""
    d = class_counts(docs).withColumn("w", F.filter(F.split("_text", SPACE), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("h", F.when(F.size("wh") >= 8, F.transform(F.sequence(F.lit(1), F.size("wh") - 7), lambda i: F.xxhash64(F.slice("wh", i, 8))))
                     .otherwise(F.expr("cast(array() as array<bigint>)")))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
                     .otherwise(F.expr("cast(array() as array<struct<x:bigint,i:int>>)")))
    s = F.col("s")
    twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]))
    covered = F.aggregate(F.array_sort(F.transform(twice, lambda e: e["i"])), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct(
        (acc["n"] + i + 8 - F.greatest(i, acc["end"])).alias("n"), (i + 8).alias("end")))["n"]
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return d.select(*cols, "w", F.size("w").cast("long").alias("n_words"),
                    (F.length("_text") - F.get("chars", F.lit(CLASSES.index(SPACE)))).cast("long").alias("word_chars"), "n_symbols", "chars",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.when(F.size("s") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words")) \
        .withColumn("base_failed", (n < 20) | (100 * r > 30 * n))


def histograms(d: DataFrame) -> DataFrame:
    """Adds ``common``: counts per common word of the language, and of all other words."""
    lists = F.expr("cast(array() as array<string>)")
    for lang, ws in COMMON.items():
        lists = F.when(F.col("_lang") == lang, F.array(*map(F.lit, ws))).otherwise(lists)
    d = d.withColumn("list", lists).withColumn("in_list", F.filter("w", lambda x: F.array_contains("list", x)))
    counts = F.transform("list", lambda x: F.size("in_list") - F.size(F.array_remove("in_list", x)))
    return d.withColumn("common", F.concat(counts, F.array(F.size("w") - F.size("in_list")))) \
        .withColumn("judged_words", F.size("list") > 0).drop("list", "in_list")


def _shares(counts: Column) -> Column:
    return F.transform(counts, lambda x: x / F.aggregate(counts, F.lit(0).cast("double"), lambda a, y: a + y))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two lists of counts of equal length, each with a sum above 0."""
    def part(a: Column, b: Column) -> Column:  # a * log2(a / mean)
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    each = F.zip_with(_shares(counts), _shares(reference), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Base counts and histograms per row, with doc_id (or the columns ``keep``)."""
    cols = keep or ["doc_id"]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(*[F.col("doc_id").cast("long").alias("doc_id") if c == "doc_id" and keep is None else F.col(c) for c in cols],
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.coalesce(lang, F.lit("")).alias("_lang"))
    return histograms(base_counts(d, [*cols, "_text", "_lang"])).drop("w", "_text")


def references(m: DataFrame) -> DataFrame:
    """Per language, the summed histograms of all documents that pass the base rules: one row a language."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(max(map(len, COMMON.values())) + 1)]
    r = m.where(~F.col("base_failed")).groupBy("_lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    return r.select("_lang", "ref_words", F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("ref_chars"),
                    F.filter(F.array(*[f"w{i}" for i in range(max(map(len, COMMON.values())) + 1)]), lambda x: x.isNotNull()).alias("ref_common"))


def judge(docs: DataFrame, *, keep: list[str] | None = None, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE,
          most_characters: float = MOST_CHARACTERS, most_words: float = MOST_WORDS, noise: float = NOISE) -> DataFrame:
    """Per row: doc_id (or the columns ``keep``), the base counts, base_failed,
    char_distance and word_distance (null where not judged) and kept.

    One row per input row, in any order. Null and empty texts have no words
    and fail the base rules; repeated rows and equal ids are judged each by
    its own text; a null or missing language is a language of its own,
    without common words; other columns are ignored. The measures are written
    once, as the references and the verdicts both read them.
    """
    m = staged(measured(docs, keep), "measures")
    cols = keep or ["doc_id"]
    judged = F.col("n_words") >= min_words
    ref = references(m).where((F.col("ref_words") >= min_reference))
    j = m.join(ref, "_lang", "left")
    with_words = judged & F.col("judged_words") & F.col("ref_words").isNotNull()
    d = j.withColumn("char_distance", F.when(judged & F.col("ref_words").isNotNull(), distance(F.col("chars"), F.col("ref_chars")))) \
         .withColumn("word_distance", F.when(with_words, distance(F.col("common"), F.col("ref_common"))))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= most_characters) & (F.coalesce("word_distance", F.lit(0.0)) <= most_words + noise / F.sqrt("n_words"))
    return d.select(*cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "char_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))


def passing(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. The
    verdict depends on text and language alone, so what is rejected is joined
    back by their fingerprints: few columns of the rejected rows, no copy of the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    mine = docs.withColumn("_ll_key", F.xxhash64(text)).withColumn("_ll_more", F.xxhash64(lang, text, F.lit(1)))
    bad = judge(mine, keep=["_ll_key", "_ll_more"], **limits).where("not kept").select("_ll_key", "_ll_more").distinct()
    return mine.join(bad, ["_ll_key", "_ll_more"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
