"""Column expressions that turn one transaction into attribute tokens.

All of these are native Catalyst expressions (CASE chains, string concat,
date parts), so they stay inside whole-stage codegen and work unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal tokens.
# Amount bin edges (21 edges, lower-inclusive, index = number of edges <= |x|):
AMOUNT_EDGES = [0, 1, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000,
                1500, 2000, 3000, 5000, 10000, float("inf")]
# Six amount ranges, upper-inclusive on |x|: <=10, <=50, <=100, <=500, <=1000, else.
AMOUNT_RANGES_6 = ["0-10", "10-50", "50-100", "100-500", "500-1000", "1000+"]
AMOUNT_RANGE_6_UPPER = [10, 50, 100, 500, 1000]
# Three amount ranges, lower-inclusive, no abs: <100, <500, else.
AMOUNT_RANGES_3 = ["0-100", "100-500", "500+"]
AMOUNT_RANGE_3_UPPER = [100, 500]
# Weekday names, Monday first (weekday() == 0 is Monday).
WEEKDAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# Token spellings.
INFLOW, OUTFLOW = "<INFLOW>", "<OUTFLOW>"
SEP = "[SEP]"
PAD, UNK = "[PAD]", "[UNK]"
AMOUNT, MONTH, DAY, WEEKDAY = "<AMOUNT_", "<MONTH_", "<DAY_", "<WEEKDAY_"
# Pre-tokenizer: a run of word characters, or a run of other non-space characters.
WORD_PATTERN = r"(?U)\w+|[^\w\s]+"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_missing(amount) -> Column:
    a = _c(amount)
    return a.isNull() | F.isnan(a)


def sign_token(amount) -> Column:
    """``<INFLOW>`` when amount >= 0, else ``<OUTFLOW>`` (NaN and null -> OUTFLOW,
    as in the reference where ``NaN >= 0`` is false; Spark orders NaN above
    every number, hence the explicit guard)."""
    a = _c(amount)
    return F.when(~is_missing(a) & (a >= 0), F.lit(INFLOW)).otherwise(F.lit(OUTFLOW))


def amount_bin_index(amount) -> Column:
    """Number of edges <= |amount| (np.digitize semantics): 1..20 for finite
    input, 21 for +inf and NaN, null for null. A CASE chain, not a UDF."""
    a = F.abs(_c(amount))
    # Test from the top edge down so the largest edge <= |x| decides.
    chain = None
    for i in range(len(AMOUNT_EDGES), 0, -1):
        cond = a >= F.lit(AMOUNT_EDGES[i - 1])
        chain = F.when(cond, F.lit(i)) if chain is None else chain.when(cond, F.lit(i))
    return F.when(_c(amount).isNull(), F.lit(None).cast("int")) \
        .when(F.isnan(_c(amount)), F.lit(len(AMOUNT_EDGES))) \
        .otherwise(chain.otherwise(F.lit(0)))


def amount_bin_token(amount) -> Column:
    """``<AMOUNT_i>``; null/NaN -> ``[UNK]``, +inf -> the top finite bin 20."""
    a = _c(amount)
    idx = F.least(amount_bin_index(a), F.lit(len(AMOUNT_EDGES) - 1))
    return F.when(is_missing(a), F.lit(UNK)).otherwise(F.concat(F.lit(AMOUNT), idx.cast("string"), F.lit(">")))


def amount_range_6(amount) -> Column:
    """Six ranges on |amount|, upper-inclusive; NaN/null fall in ``1000+``."""
    a = F.abs(_c(amount))
    chain = None
    for upper, name in zip(AMOUNT_RANGE_6_UPPER, AMOUNT_RANGES_6):
        cond = a <= F.lit(float(upper))
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    return chain.otherwise(F.lit(AMOUNT_RANGES_6[-1]))


def amount_range_3(amount) -> Column:
    """Three ranges, lower-inclusive, no abs (negatives -> ``0-100``)."""
    a = _c(amount)
    chain = None
    for upper, name in zip(AMOUNT_RANGE_3_UPPER, AMOUNT_RANGES_3):
        cond = a < F.lit(float(upper))
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    return chain.otherwise(F.lit(AMOUNT_RANGES_3[-1]))


def _date_token(prefix: str, part: Column) -> Column:
    """The part's token; ``[UNK]`` for a null date, as for a null amount."""
    return F.coalesce(F.concat(F.lit(prefix), part.cast("string"), F.lit(">")), F.lit(UNK))


def month_token(date) -> Column:
    return _date_token(MONTH, F.month(_c(date)))


def day_token(date) -> Column:
    return _date_token(DAY, F.dayofmonth(_c(date)))


def weekday_token(date) -> Column:
    """``<WEEKDAY_w>``, Monday = 0."""
    return _date_token(WEEKDAY, F.weekday(_c(date)))


def weekday_name(date) -> Column:
    """Lower-case English weekday name, locale independent."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.element_at(names, F.weekday(_c(date)) + 1)


def origin_token(origin) -> Column:
    return F.concat(F.lit("<"), _c(origin), F.lit(">"))


def pretokenize(text) -> Column:
    """Split text into word runs and punctuation runs (``Netflix.com`` ->
    ``Netflix . com``); null -> empty array."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0)


def attribute_tokens(amount, date) -> Column:
    """sign, amount bin, month, day, weekday tokens of one transaction."""
    return F.array(sign_token(amount), amount_bin_token(amount), month_token(date),
                   day_token(date), weekday_token(date))


def transaction_tokens(amount, date, description) -> Column:
    """Token list of one transaction: five attribute tokens, then the
    description's pre-tokenized words (a null description adds none)."""
    return F.concat(attribute_tokens(amount, date), pretokenize(description))


def spaced_transaction_string(origin, amount, date, description) -> Column:
    """``<card> <OUTFLOW> <AMOUNT_10-50> <MONTH_3> <DAY_7> <WEEKDAY_1> Uber Trip [SEP]``.

    Every part is made non-null first because concat_ws silently skips nulls.
    """
    parts = [
        origin_token(F.coalesce(_c(origin), F.lit(""))),
        sign_token(amount),
        F.concat(F.lit(AMOUNT), amount_range_6(amount), F.lit(">")),
        month_token(date), day_token(date), weekday_token(date),
        F.coalesce(_c(description), F.lit("")),
        F.lit(SEP),
    ]
    return F.concat_ws(" ", *parts)


def tagged_transaction_string(type_, amount, hour, day, month, day_week, merchant) -> Column:
    """``<out><amount:0-100><hour:10><day:5><month:7><day_week:sunday>netflix.com``."""
    def s(x):
        return F.coalesce(_c(x).cast("string"), F.lit(""))

    return F.concat(
        F.lit("<"), s(type_), F.lit(">"),
        F.lit("<amount:"), amount_range_3(amount), F.lit(">"),
        F.lit("<hour:"), s(hour), F.lit(">"),
        F.lit("<day:"), s(day), F.lit(">"),
        F.lit("<month:"), s(month), F.lit(">"),
        F.lit("<day_week:"), s(day_week), F.lit(">"),
        s(merchant),
    )


def format_tokens(tokens, ids) -> Column:
    """``token(id)`` pairs joined by a space."""
    pairs = F.zip_with(_c(tokens), _c(ids),
                       lambda t, i: F.concat(t, F.lit("("), i.cast("string"), F.lit(")")))
    return F.array_join(pairs, " ")
