"""Benchmark decontamination: a prefix-filtered set join, DataFrame functions only.

A window is ``width`` consecutive words of a benchmark item (a shorter item is
one window). As a set of word shingles it lies wholly inside a document only
if its rarest shingle does, so that one shingle is its necessary prefix:

1. the documents' shingles are met with the items' shingles (the only pass
   over all words); the matches give the shingles' document counts, which
   order them by rarity, and hold all candidates;
2. each window is joined by its rarest shingle alone; the shingle's place in
   the window gives the place where the window would start in the document,
   and windows that would begin before the first or end after the last word
   are dropped (positional and length bounds);
3. the words at that place are compared with the window's, exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of the items is sent to every task up to so many rows and so many bytes of text.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def shingles(w: Column, q: int) -> Column:
    """Hashes of q consecutive words, in order of place. ``w`` must be a
    column, not an expression: the lambda would evaluate that for each place."""
    at = F.sequence(F.lit(1), F.size(w) - (q - 1))
    return F.when(F.size(w) >= q, F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(q)]))) \
        .otherwise(F.expr("cast(array() as array<bigint>)"))


def item_windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: window, words, n; window -> item_id)."""
    w = items.select(F.col("item_id").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("words"))
    each = each.withColumn("window", F.md5(F.concat_ws(" ", "words")))
    return (each.groupBy("window").agg(F.first("words").alias("words")).withColumn("n", F.size("words")),
            each.select("window", "item_id").distinct())


def sent(text: Column) -> tuple[Column, Column]:
    """What a table weighs: its rows and the bytes of their text."""
    return F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))


def sending(rows: int, size: int) -> Callable[[DataFrame], DataFrame]:
    """The broadcast hint for a table of this weight, or no hint."""
    return F.broadcast if rows <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES else (lambda x: x)


def contaminated(docs: DataFrame, items: DataFrame, *, width: int = 13, shingle: int = 3, keep_key: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of an
    item's window), items (ids of the items with occurring windows, as sorted
    strings).

    One row per input row. Null and empty texts have no words; null and empty
    items, and an empty ``items``, hit nothing; items with equal texts are
    all named; a null item_id counts as an item named "" ; repeated rows and
    rows with equal or null ids are judged each by its own text; other
    columns are ignored. The items' tables are broadcast only where their rows
    and bytes allow it (the windows and the item ids each by its own count), else
    joined by a shuffle that adaptive execution may split.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("text"))  # with doc_id: the document
    windows, of_item = (staged(x, "windows") for x in item_windows(items, width))
    lengths, *size = windows.agg(F.collect_set(F.least("n", F.lit(shingle))), *sent(F.concat_ws(" ", "words"))).first()  # at most `shingle` lengths
    small = sending(*size)
    small_ids = sending(*of_item.agg(*sent(F.concat_ws(" ", "window", F.col("item_id").cast("string")))).first())

    hits, pieces = None, None
    for q in sorted(lengths):
        mine = windows.where(F.least("n", F.lit(shingle)) == q)
        here = mine.select("window", "n", F.posexplode(shingles(F.col("words"), q)).alias("offset", "shingle")).withColumn("q", F.lit(q))
        # the outer form: for the plain one the optimizer adds a filter on the array's size,
        # pushes it below the words' column and so evaluates that for each place
        found = (base.select("doc_id", "key", words(F.col("text")).alias("w"))
                 .select("doc_id", "key", shingles(F.col("w"), q).alias("sh"))
                 .select("doc_id", "key", F.size("sh").alias("places"), F.posexplode_outer("sh").alias("at", "shingle"))
                 .join(small(here.select("shingle").distinct()), "shingle", "left_semi").withColumn("q", F.lit(q)))
        hits, pieces = (found, here) if hits is None else (hits.unionByName(found), pieces.unionByName(here))
    out = base.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    shown = ["key"] if keep_key else []
    if hits is None:
        return out.select("doc_id", *shown, "n_words", F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"))
    hits = staged(hits, "hits")

    rarity = hits.groupBy("q", "shingle").agg(F.approx_count_distinct(F.struct("doc_id", "key")).alias("docs"))
    rank = Window.partitionBy("window").orderBy("docs", "shingle", "offset")
    # a window with a shingle that no document holds occurs nowhere
    prefix = (pieces.join(small(rarity), ["q", "shingle"], "left").withColumn("rank", F.row_number().over(rank))
              .where("rank = 1 and docs is not null").select("q", "shingle", "window", "n", "offset"))
    places = (hits.join(small(prefix), ["q", "shingle"])
              .withColumn("start", F.col("at") - F.col("offset"))
              .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("places") + F.col("q") - 1))
              .groupBy("doc_id", "key", "window", "n").agg(F.collect_set("start").alias("starts")))
    per_doc = places.join(small(windows.select("window", "words")), "window") \
        .groupBy("doc_id", "key").agg(F.collect_list(F.struct("window", "words", "n", "starts")).alias("candidates"))

    w = F.col("w")
    true = F.filter(
        F.transform("candidates", lambda c: F.struct(
            c["window"].alias("window"), c["n"].alias("n"),
            F.filter(c["starts"], lambda s: (s + c["n"] <= F.size(w)) & (F.slice(w, s + 1, c["n"]) == c["words"])).alias("starts"))),
        lambda c: F.size(c["starts"]) > 0)
    spans = F.array_sort(F.flatten(F.transform("true", lambda c: F.transform(c["starts"], lambda s: F.struct(s.alias("a"), (s + c["n"]).alias("b"))))))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end")))["n"]
    verified = (base.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(
        per_doc.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "key", "candidates", F.col("doc_id").isNull().alias("none")), ["id", "key"])
        .where(F.col("doc_id").isNull() == F.col("none")).dropDuplicates(["doc_id", "key"])
        .select("doc_id", "key", words(F.col("text")).alias("w"), "candidates")
        .select("doc_id", "key", true.alias("true"))
        .select("doc_id", "key", covered.cast("long").alias("n_hit"), F.transform("true", lambda c: c["window"]).alias("windows")))
    verified = staged(verified, "verified")
    named = (verified.select("doc_id", "key", F.explode("windows").alias("window")).join(small_ids(of_item), "window")
             .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")))
    found = verified.select("doc_id", "key", "n_hit").alias("v").join(
        named.alias("n"), F.col("v.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("v.key") == F.col("n.key")), "left").select("v.*", "items")
    return out.alias("o").join(found.alias("f"), F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o.key") == F.col("f.key")), "left").select(
        "o.doc_id", *[f"o.{c}" for c in shown], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds contaminated: at least one word in twenty is hit."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return with_verdict(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.
    Only the contaminated documents' (doc_id, text hash) are joined back."""
    bad = with_verdict(contaminated(docs, items, keep_key=True, **options)).where("contaminated") \
        .select(F.col("doc_id").alias("_ll_bad"), F.col("key").alias("_ll_text")).distinct()
    mine = docs.withColumn("_ll_id", F.col("doc_id").cast("long")).withColumn("_ll_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return mine.join(bad, F.col("_ll_id").eqNullSafe(F.col("_ll_bad")) & (F.col("_ll_key") == F.col("_ll_text")), "left_anti") \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
