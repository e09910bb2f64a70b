"""Tabular side: label rows, feature tables and their joins (P11-P13, D5,
J1-J3, A5, A6).

Per-user "first row" operators use ``min_by`` aggregates rather than a
``row_number`` window: the aggregate is combined map-side, so a user with a
third of all rows is reduced in every map task instead of being sorted in
one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.encode import PAD


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def coerce_numeric(col, kind: str = "numerical") -> Column:
    """Bad or null -> 0, then int64 (categorical, truncating) or float32.

    Text must be a plain decimal number (spaces around it allowed): suffixes
    and hex forms that a cast would take count as bad. NaN, infinities and
    values beyond the target type become 0."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.trim(c.cast("string"))
    d = F.when(text.rlike(NUMBER), text.try_cast("double"))
    kept = d.try_cast("bigint") if kind == "categorical" else F.when(F.abs(d) < F.lit(3.4028235e38), d.cast("float"))
    return F.coalesce(kept, F.lit(0).cast("bigint" if kind == "categorical" else "float"))


def feature_vector(cat_cols: Sequence[str], num_cols: Sequence[str]) -> Column:
    """Categorical codes followed by numericals, as ARRAY<FLOAT>."""
    parts = [coerce_numeric(c, "categorical").cast("float") for c in cat_cols]
    parts += [coerce_numeric(c, "numerical") for c in num_cols]
    return F.array(*parts)


def columns_like(df: DataFrame, needle: str) -> list[str]:
    """Column names containing ``needle`` (schema-only, no data read)."""
    return [c for c in df.columns if needle in c]


def first_row_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The first row of each key in ``order_col`` order (file order)."""
    others = [c for c in df.columns if c not in (key,)]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return picked.select(key, *[F.col("_r")[c].alias(c) for c in others])


def first_label(labels: DataFrame, key: str = "user_id", order_col: str = "row_id",
                label: str = "label") -> DataFrame:
    """A5: first non-null label per key in file order (pandas ``first``)."""
    return (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
            .groupBy(key).agg(F.min_by(F.col(label), F.col(order_col)).alias(label)))


def labels_with_features(labels: DataFrame, features: DataFrame, key: str = "user_id") -> DataFrame:
    """Label rows LEFT JOIN tabular features (fan-out by repeated labels).

    Null keys never match (the pipeline drops null users up front)."""
    return labels.join(features, key, "left")


def label_sequences(labels: DataFrame, windows: DataFrame, key: str = "user_id",
                    tokens: str = "tokens", pad=PAD) -> DataFrame:
    """Every label row gets its user's (bounded) sequence window; a user
    without one gets ``[]`` and an empty sequence becomes ``[pad]``."""
    etype = windows.schema[tokens].dataType.elementType.simpleString()
    j = labels.join(windows.select(key, tokens), key, "left")
    seq = F.coalesce(F.col(tokens), F.array().cast(f"array<{etype}>"))
    return j.withColumn(tokens, F.when(F.size(seq) == 0, F.array(F.lit(pad).cast(etype))).otherwise(seq))


def label_first_features(labels: DataFrame, table: DataFrame, key: str = "user_id",
                         order_col: str = "row_id") -> DataFrame:
    """Each label row with the first tabular row of its user, where the
    tabular rows are the fine-tune table itself (D5 then an inner join)."""
    firsts = first_row_per_key(table, key, order_col)
    cols = [c for c in firsts.columns if c not in labels.columns or c == key]
    return labels.join(firsts.select(*cols), key, "inner")


def feature_catalog(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """One row with the column lists, exact cardinality per
    categorical column (nulls excluded) and ``max + 1`` per column (codes at
    or above the cardinality would overflow an embedding table)."""
    aggs = []
    for c in cat_cols:
        aggs.append(F.count_distinct(F.col(c)).alias(f"_n_{c}"))
        aggs.append((F.max(F.col(c)) + 1).alias(f"_m_{c}"))
    row = df.agg(*aggs)
    keys = F.array(*[F.lit(c) for c in cat_cols])
    return row.select(
        F.array(*[F.lit(c) for c in num_cols]).alias("numerical_cols"),
        keys.alias("categorical_cols"),
        F.map_from_arrays(keys, F.array(*[F.col(f"_n_{c}") for c in cat_cols])).alias("cat_cardinalities"),
        F.map_from_arrays(keys, F.array(*[F.col(f"_m_{c}").cast("bigint") for c in cat_cols])).alias("cat_max_plus_one"),
    )


BITMAP_CODES = 32768  # the codes one bitmap aggregate holds


def feature_catalog_sketched(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], lg_k: int = 14) -> DataFrame:
    """A6/S8 for wide tables: like ``feature_catalog``, in one pass that combines
    fixed-size states (several exact distinct counts in one aggregate copy
    every row once per column). Integer codes 0 .. 32,767 are counted exactly
    by a bitmap of 4 KB; a column with any other code is estimated by a HyperLogLog
    sketch (``2**lg_k`` registers, relative error about 0.83 / sqrt(2**lg_k),
    0.65 % at 14). ``is_exact`` tells which. Nulls are not counted; a column
    of nulls has cardinality 0 and no maximum."""
    aggs = []
    for c in cat_cols:
        code = F.col(c).cast("bigint")
        bits = F.bitmap_construct_agg(F.when(code.between(0, BITMAP_CODES - 1), F.bitmap_bit_position(code + 1)))
        aggs += [F.min(code).alias(f"_lo_{c}"), F.max(code).alias(f"_hi_{c}"), F.bitmap_count(bits).alias(f"_b_{c}"),
                 F.hll_sketch_estimate(F.hll_sketch_agg(code, F.lit(lg_k))).alias(f"_h_{c}")]
    row = df.agg(*aggs)
    keys = F.array(*[F.lit(c) for c in cat_cols])
    exact = {c: F.coalesce((F.col(f"_lo_{c}") >= 0) & (F.col(f"_hi_{c}") < BITMAP_CODES), F.lit(True)) for c in cat_cols}
    count = [F.when(exact[c], F.col(f"_b_{c}")).otherwise(F.col(f"_h_{c}")).cast("bigint") for c in cat_cols]
    return row.select(
        F.array(*[F.lit(c) for c in num_cols]).alias("numerical_cols"),
        keys.alias("categorical_cols"),
        F.map_from_arrays(keys, F.array(*count)).alias("cat_cardinalities"),
        F.map_from_arrays(keys, F.array(*[F.col(f"_hi_{c}") + 1 for c in cat_cols])).alias("cat_max_plus_one"),
        F.map_from_arrays(keys, F.array(*exact.values())).alias("is_exact"),
    )
