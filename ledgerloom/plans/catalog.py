"""Registered queries (Spark side) and their DuckDB oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole
given tables. Arrays are rendered as strings so the driver's value hash does
not depend on list formatting; every computed column is aliased identically
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import encode as E
from ledgerloom.operators import sequence as S
from ledgerloom.plans import pipelines as PL
from ledgerloom.operators.ranking import global_index
from ledgerloom.session import hold, written
from ledgerloom.plans import sql_fragments as Q
from ledgerloom.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def joined(col: str, sep: str = " "):
    return F.array_join(F.col(col), sep)


# ---------------------------------------------------------------------------
# Sources (S1) and projections

@query("read_transactions", f"SELECT * FROM ({Q.TXE})")
def read_transactions(spark, sf):
    return T.transactions_from_events(spark, sf)


@query("sign_token", f"SELECT tx_id, amount, {Q.sign('amount')} AS sign FROM ({Q.TXE})")
def q_sign_token(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select("tx_id", "amount", E.sign_token("amount").alias("sign"))


@query("amount_bin_21", f"""SELECT user_id, date, l_orderkey, l_linenumber, l_partkey, amount,
  {Q.bin_index('amount')} AS bin, {Q.bin_token('amount')} AS token FROM ({Q.TXR})""")
def q_amount_bin(spark, sf):
    tx = T.transactions_from_lineitem(spark, sf)
    return tx.select("user_id", "date", "l_orderkey", "l_linenumber", "l_partkey", "amount",
                     E.amount_bin_index("amount").alias("bin"), E.amount_bin_token("amount").alias("token"))


@query("amount_range_6", f"SELECT tx_id, amount, {Q.range6('amount')} AS amount_range FROM ({Q.TXE})")
def q_range6(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select("tx_id", "amount", E.amount_range_6("amount").alias("amount_range"))


@query("amount_range_3", f"SELECT tx_id, amount, {Q.range3('amount')} AS amount_range FROM ({Q.TXE})")
def q_range3(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select("tx_id", "amount", E.amount_range_3("amount").alias("amount_range"))


@query("date_tokens", f"""SELECT l_orderkey, l_linenumber, {Q.month_tok('date')} AS month_token, {Q.day_tok('date')} AS day_token,
  {Q.weekday_tok('date')} AS weekday_token FROM ({Q.TXR})""")
def q_date_tokens(spark, sf):
    """P5 on the line items, whose dates fall in all months."""
    tx = T.transactions_from_lineitem(spark, sf)
    return tx.select("l_orderkey", "l_linenumber", E.month_token("date").alias("month_token"), E.day_token("date").alias("day_token"),
                     E.weekday_token("date").alias("weekday_token"))


@query("hour_dayname", f"""SELECT tx_id, CAST(hour(date) AS INTEGER) AS hour,
  {Q.weekday_name('date')} AS day_week FROM ({Q.TXE})""")
def q_hour_dayname(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select("tx_id", F.hour("date").alias("hour"), E.weekday_name("date").alias("day_week"))


@query("tx_string_spaced", f"""SELECT tx_id, {Q.spaced('origin', 'amount', 'date', 'description')} AS tx
FROM ({Q.TXE})""")
def q_tx_spaced(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select("tx_id", E.spaced_transaction_string("origin", "amount", "date", "description").alias("tx"))


_SPLIT_E = Q.split_date(Q.TXE)


@query("tx_string_tagged", f"""SELECT tx_id,
  {Q.tagged('type', 'amount', 'hour', 'day', 'month', 'day_week', 'merchant')} AS tx FROM ({_SPLIT_E})""")
def q_tx_tagged(spark, sf):
    sd = T.split_date_transactions(T.transactions_from_events(spark, sf))
    return sd.select("tx_id", E.tagged_transaction_string("type", "amount", "hour", "day", "month", "day_week",
                                                          "merchant").alias("tx"))


@query("tx_tokens", f"""SELECT user_id, date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  array_to_string({Q.tx_tokens('amount', 'date', 'description')}, ' ') AS tokens FROM ({Q.TXR})""")
def q_tx_tokens(spark, sf):
    tx = T.transactions_from_lineitem(spark, sf)
    return tx.select("user_id", "date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     F.array_join(E.transaction_tokens("amount", "date", "description"), " ").alias("tokens"))


@query("normalise_transactions", f"""SELECT tx_id, user_id, date, date_trunc('second', date) AS date_seconds,
  round(amount / 7, 2) AS amount, trim(description) AS description FROM ({Q.TXE}) WHERE user_id IS NOT NULL""")
def q_normalise(spark, sf):
    """P18, on amounts of many decimals (a seventh of the events')."""
    from ledgerloom.sources.io import normalise_transactions
    tx = T.transactions_from_events(spark, sf).withColumn("amount", F.col("amount") / 7)
    return normalise_transactions(tx).select("tx_id", "user_id", "date", "date_seconds", "amount", "description")


# ---------------------------------------------------------------------------
# Sequences (A1-A4) and windows over them

def _txe_token_events(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select("user_id", "date", "tx_id",
                     E.transaction_tokens("amount", "date", "description").alias("toks"))


def txe_sequences(spark, sf, chunk_len=S.DEFAULT_CHUNK_LEN):
    return S.assemble_sequences(_txe_token_events(spark, sf), "user_id", ["date", "tx_id"], "toks",
                                sep=E.SEP, chunk_len=chunk_len)


_TXE_FULL = f"""SELECT user_id, flatten(list(list_concat(toks, ['[SEP]']) ORDER BY date, tx_id)) AS f0
FROM (SELECT user_id, date, tx_id, {Q.tx_tokens('amount', 'date', 'description')} AS toks FROM ({Q.TXE}))
WHERE user_id IS NOT NULL GROUP BY user_id"""
_TXE_SEQ = f"SELECT user_id, f0[1:len(f0)-1] AS seq FROM ({_TXE_FULL})"


@query("user_sequences", Q.chunked(_TXE_SEQ, "user_id", S.DEFAULT_CHUNK_LEN))
def q_user_sequences(spark, sf):
    seqs = txe_sequences(spark, sf)
    return seqs.select("user_id", "chunk", "offset", "seq_len", joined("tokens").alias("tokens"))


def _txr_token_events(spark, sf):
    tx = T.transactions_from_lineitem(spark, sf)
    return tx.select("user_id", *T.TXR_ORDER,
                     E.transaction_tokens("amount", "date", "description").alias("toks"))


_TXR_FULL = f"""SELECT user_id, flatten(list(list_concat(toks, ['[SEP]']) ORDER BY {Q.TXR_ORDER})) AS f0
FROM (SELECT user_id, {Q.TXR_ORDER}, {Q.tx_tokens('amount', 'date', 'description')} AS toks FROM ({Q.TXR}))
WHERE user_id IS NOT NULL GROUP BY user_id"""
_TXR_SEQ = f"SELECT user_id, f0[1:len(f0)-1] AS seq FROM ({_TXR_FULL})"


@query("sequence_sep_between", Q.chunked(_TXR_SEQ, "user_id", 64))
def q_sep_between(spark, sf):
    """A2 on TXR with small chunks, so long users span several rows."""
    seqs = S.assemble_sequences(_txr_token_events(spark, sf), "user_id", T.TXR_ORDER, "toks",
                                sep=E.SEP, chunk_len=64)
    return seqs.select("user_id", "chunk", "offset", "seq_len", joined("tokens").alias("tokens"))


@query("sequence_sos_eot", Q.chunked(f"""SELECT client_id, list_concat(['<SOS>'], f0[1:len(f0)-1], ['<EOS>']) AS seq FROM (
  SELECT client_id, flatten(list([{Q.tagged('type', 'amount', 'hour', 'day', 'month', 'day_week', 'merchant')}, '<EOT>']
    ORDER BY date, tx_id)) AS f0 FROM ({_SPLIT_E}) WHERE client_id IS NOT NULL GROUP BY client_id)""",
    "client_id", 64, "''").replace("AS tokens", "AS sequence"))
def q_sos_eot(spark, sf):
    """A3: tagged sequences, in chunks of 64 transactions and tags."""
    sd = T.split_date_transactions(T.transactions_from_events(spark, sf))
    return PL.tagged_sequences(sd, chunk_len=64).select("client_id", "chunk", "offset", "seq_len", "sequence")


@query("sequence_spaced", Q.chunked(f"""SELECT user_id,
  list({Q.spaced('origin', 'amount', 'date', 'description')} ORDER BY date, tx_id) AS seq
FROM ({Q.TXE}) WHERE user_id IS NOT NULL GROUP BY user_id""", "user_id", 50).replace("AS tokens", "AS transaction_history"))
def q_spaced(spark, sf):
    """A4: history strings, in chunks of 50 transactions."""
    return PL.history_strings(T.transactions_from_events(spark, sf), chunk_len=50).select(
        "user_id", "chunk", "offset", "seq_len", "transaction_history")


@query("next_token_pairs", f"""SELECT user_id, array_to_string(h[1:len(h)-1], ' ') AS x,
  array_to_string(h[2:len(h)], ' ') AS y FROM (SELECT user_id, seq[1:513] AS h FROM ({_TXE_SEQ}))""")
def q_next_token_pairs(spark, sf):
    h = S.head_tokens(txe_sequences(spark, sf), "user_id", 513, S.DEFAULT_CHUNK_LEN)
    p = S.next_token_pairs(h)
    return p.select("user_id", joined("x").alias("x"), joined("y").alias("y"))


@query("truncate_head", f"""SELECT user_id, CAST(len(seq) AS BIGINT) AS seq_len,
  array_to_string(seq[1:512], ' ') AS tokens FROM ({_TXE_SEQ})""")
def q_truncate_head(spark, sf):
    h = S.head_tokens(txe_sequences(spark, sf), "user_id", 512, S.DEFAULT_CHUNK_LEN)
    return h.select("user_id", "seq_len", joined("tokens").alias("tokens"))


@query("truncate_tail", f"""SELECT user_id, CAST(len(seq) AS BIGINT) AS seq_len,
  array_to_string(seq[greatest(len(seq) - 100, 0) + 1:], ' ') AS tokens FROM ({_TXR_SEQ})""")
def q_truncate_tail(spark, sf):
    """W3 before the assembly: an event has five tokens or more, so a task sends
    at most 17 events of a user."""
    t = S.edge_tokens(_txr_token_events(spark, sf), "user_id", T.TXR_ORDER, "toks", 100, sep=E.SEP, least_items=5)
    return t.select("user_id", "seq_len", joined("tokens").alias("tokens"))


@query("truncate_oldest", f"""SELECT user_id, CAST(len(seq) AS BIGINT) AS seq_len,
  array_to_string(seq[1:60], ' ') AS tokens FROM ({_TXR_SEQ})""")
def q_truncate_oldest(spark, sf):
    """W2 before the assembly."""
    t = S.edge_tokens(_txr_token_events(spark, sf), "user_id", T.TXR_ORDER, "toks", 60, newest=False, sep=E.SEP, least_items=5)
    return t.select("user_id", "seq_len", joined("tokens").alias("tokens"))


@query("holdout_tail", f"""SELECT user_id, CAST(len(seq) - 5 AS BIGINT) AS input_len,
  array_to_string(seq[greatest(len(seq) - 5 - 20, 0) + 1 : len(seq) - 5], ' ') AS input_tail,
  array_to_string(seq[len(seq) - 4:], ' ') AS actual
FROM ({_TXE_SEQ}) WHERE len(seq) > 15""")
def q_holdout_tail(spark, sf):
    seqs = txe_sequences(spark, sf)
    inp, actual = S.holdout(seqs.where(F.col("seq_len") > 15), "user_id", 5)
    shown = S.tail_tokens(inp, "user_id", 20)
    return (shown.join(actual, "user_id")
            .select("user_id", F.col("seq_len").alias("input_len"), joined("tokens").alias("input_tail"),
                    joined("actual").alias("actual")))


@query("long_enough", f"""SELECT user_id, CAST(len(seq) AS BIGINT) AS seq_len FROM ({_TXE_SEQ})
WHERE len(seq) > 15""")
def q_long_enough(spark, sf):
    seqs = txe_sequences(spark, sf)
    return seqs.where((F.col("chunk") == 0) & (F.col("seq_len") > 5 + 10)).select("user_id", "seq_len")


@query("sorted_transactions", f"""SELECT user_id, tx_id, date, amount,
  CAST(row_number() OVER (ORDER BY user_id, date, tx_id) - 1 AS BIGINT) AS row_idx FROM ({Q.TXE})""")
def q_sorted(spark, sf):
    tx = T.transactions_from_events(spark, sf).select("user_id", "tx_id", "date", "amount")
    return global_index(tx, ["user_id", "date", "tx_id"], name="row_idx")


# ---------------------------------------------------------------------------
# Tabular side: D5, A5, J1-J3, P11, P12, A6, A7

from ledgerloom.operators import features as FT  # noqa: E402
from ledgerloom.operators import metrics as M  # noqa: E402
from ledgerloom.operators import split as SP  # noqa: E402
from ledgerloom.operators import vocab as V  # noqa: E402

_FT_TABLE = f"SELECT l.*, f.* EXCLUDE (user_id) FROM ({Q.LAB}) l LEFT JOIN ({Q.FEAT}) f USING (user_id)"


def finetune_table(spark, sf):
    return FT.labels_with_features(T.label_rows(spark, sf), T.customer_features(spark, sf))


@query("labels_join_features", f"SELECT * FROM ({_FT_TABLE})")
def q_labels_join_features(spark, sf):
    return finetune_table(spark, sf)


@query("first_row_per_user", f"""SELECT * FROM ({_FT_TABLE})
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY row_id) = 1""")
def q_first_row(spark, sf):
    return FT.first_row_per_key(finetune_table(spark, sf), "user_id", "row_id")


@query("first_label", f"""SELECT user_id, arg_min(label, row_id) AS label FROM ({Q.LAB})
WHERE label IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id""")
def q_first_label(spark, sf):
    return FT.first_label(T.label_rows(spark, sf))


_FV_SQL = ", ".join([f"CAST(trunc(coalesce({c}, 0)) AS FLOAT) AS f{i}" for i, c in enumerate(T.FEAT_CATEGORICAL)] +
                    [f"CAST(coalesce({c}, 0) AS FLOAT) AS f{i + len(T.FEAT_CATEGORICAL)}"
                     for i, c in enumerate(T.FEAT_NUMERICAL)])


@query("label_first_features", f"""SELECT l.row_id, l.user_id, l.label, {_FV_SQL}
FROM ({Q.LAB}) l JOIN (SELECT * FROM ({_FT_TABLE})
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY row_id) = 1) t USING (user_id)""")
def q_label_first_features(spark, sf):
    j = FT.label_first_features(T.label_rows(spark, sf), finetune_table(spark, sf))
    fv = FT.feature_vector(T.FEAT_CATEGORICAL, T.FEAT_NUMERICAL)
    n = len(T.FEAT_CATEGORICAL) + len(T.FEAT_NUMERICAL)
    return j.select("row_id", "user_id", "label", *[fv[i].alias(f"f{i}") for i in range(n)])


@query("feature_vector", f"SELECT user_id, {_FV_SQL} FROM ({Q.FEAT})")
def q_feature_vector(spark, sf):
    fv = FT.feature_vector(T.FEAT_CATEGORICAL, T.FEAT_NUMERICAL)
    n = len(T.FEAT_CATEGORICAL) + len(T.FEAT_NUMERICAL)
    return T.customer_features(spark, sf).select("user_id", *[fv[i].alias(f"f{i}") for i in range(n)])


def _coerce_sql(x: str, kind: str) -> str:
    d = (f"(CASE WHEN TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) IS NULL OR isnan(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE))"
         f" OR isinf(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) END)")
    return f"CAST(trunc({d}) AS BIGINT)" if kind == "categorical" else f"CAST({d} AS FLOAT)"


@query("coerce_numeric", f"""SELECT event_id, {_coerce_sql('props', 'numerical')} AS props_num,
  {_coerce_sql('value', 'categorical')} AS value_code, {_coerce_sql("substr(props, 7, 2)", 'categorical')} AS k_code
FROM events""")
def q_coerce(spark, sf):
    ev = T.table(spark, sf, "events")
    return ev.select("event_id", FT.coerce_numeric("props", "numerical").alias("props_num"),
                     FT.coerce_numeric("value", "categorical").alias("value_code"),
                     FT.coerce_numeric(F.substring("props", 7, 2), "categorical").alias("k_code"))


@query("feature_catalog", f"""SELECT 'num_acctbal,num_orders,num_spend' AS numerical_cols,
  'cat_nation,cat_segment' AS categorical_cols,
  'cat_nation:' || count(DISTINCT cat_nation) || ',cat_segment:' || count(DISTINCT cat_segment) AS cat_cardinalities,
  'cat_nation:' || (max(cat_nation) + 1) || ',cat_segment:' || (max(cat_segment) + 1) AS cat_max_plus_one
FROM ({Q.FEAT})""")
def q_feature_catalog(spark, sf):
    cat = FT.feature_catalog(T.customer_features(spark, sf), T.FEAT_NUMERICAL, T.FEAT_CATEGORICAL)

    def render(m):
        return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"),
                                                                                e["value"].cast("string"))), ",")
    return cat.select(F.array_join("numerical_cols", ",").alias("numerical_cols"),
                      F.array_join("categorical_cols", ",").alias("categorical_cols"),
                      render(F.col("cat_cardinalities")).alias("cat_cardinalities"),
                      render(F.col("cat_max_plus_one")).alias("cat_max_plus_one"))


_CODES = ["o_custkey", "l_linenumber", "l_suppkey", "p_size", "l_partkey"]
_CODED = """SELECT o_custkey, l_linenumber, l_suppkey, p_size, l_partkey FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


@query("feature_catalog_wide", " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS cardinality, CAST(max({c}) + 1 AS BIGINT) AS max_plus_one, true AS is_exact FROM ({_CODED})"
                                                  for c in _CODES))
def q_feature_catalog_wide(spark, sf):
    """A6 in one pass over the coded columns of the line items (bitmaps; codes
    beyond 32,767, at larger scales, are estimated and marked)."""
    li, o, p = (T.table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    cat = FT.feature_catalog_sketched(rows, [], _CODES)
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col("cat_cardinalities")[c].alias("cardinality"), F.col("cat_max_plus_one")[c].alias("max_plus_one"),
                              F.col("is_exact")[c].alias("is_exact")) for c in _CODES])
    return cat.select(F.explode(each).alias("e")).select("e.*")


# ---------------------------------------------------------------------------
# Vocabulary: U1, J4, J5, B9 and the label -> sequence join J2

def _txe_words(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    return tx.select(F.explode(E.pretokenize("description")).alias("word"))


def txe_vocab(spark, sf):
    return V.word_vocabulary(spark, _txe_words(spark, sf), "binned")


# The catalogs, written out so that the oracle does not lean on the operator.
_MDW_SQL = """list_transform(range(1, 13), lambda m: '<MONTH_' || m || '>'), list_transform(range(1, 32), lambda d: '<DAY_' || d || '>'),
  list_transform(range(7), lambda w: '<WEEKDAY_' || w || '>'), ['[SEP]']"""
_SPECIALS_SQL = f"""flatten([['[PAD]', '[UNK]', '<INFLOW>', '<OUTFLOW>'], list_transform(range(21), lambda a: '<AMOUNT_' || a || '>'), {_MDW_SQL}])"""
_SPACED_SQL = f"""flatten([['[PAD]', '[UNK]', '<account>', '<card>', '<INFLOW>', '<OUTFLOW>', '<AMOUNT_0-10>', '<AMOUNT_10-50>',
  '<AMOUNT_50-100>', '<AMOUNT_100-500>', '<AMOUNT_500-1000>', '<AMOUNT_1000+>'], {_MDW_SQL}])"""
_TAGGED_SQL = "['<PAD>', '<SOS>', '<EOS>', '<EOT>', '<UNK>']"
_TXE_VOCAB = f"""SELECT token, CAST(id AS INTEGER) AS id FROM (
  SELECT unnest({_SPECIALS_SQL}) AS token, generate_subscripts({_SPECIALS_SQL}, 1) - 1 AS id
  UNION ALL
  SELECT w AS token, 75 + row_number() OVER (ORDER BY w) AS id
  FROM (SELECT DISTINCT unnest({Q.words('description')}) AS w FROM ({Q.TXE}))
  WHERE w NOT IN (SELECT unnest({_SPECIALS_SQL})))"""


@query("word_vocabulary", f"SELECT token, id FROM ({_TXE_VOCAB})")
def q_word_vocab(spark, sf):
    return txe_vocab(spark, sf).select("token", "id")


def _catalog_usage_sql(tokens: str, text: str) -> str:
    """How many texts hold each special token of a catalog."""
    return f"""SELECT v.token, v.id, CAST(count(CASE WHEN contains(t.txt, v.token) THEN 1 END) AS BIGINT) AS n_texts
FROM (SELECT unnest({tokens}) AS token, CAST(generate_subscripts({tokens}, 1) - 1 AS INTEGER) AS id) v, ({text}) t GROUP BY v.token, v.id"""


def _catalog_usage(texts, variant, held=lambda t: F.contains("txt", F.lit(t))):
    toks = V.special_token_list(variant)  # a fixed list
    counts = texts.agg(*[F.count(F.when(held(t), 1)).alias(f"n{i}") for i, t in enumerate(toks)])
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("id"), F.col(f"n{i}").alias("n_texts")) for i, t in enumerate(toks)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("special_catalog_spaced", _catalog_usage_sql(_SPACED_SQL, f"SELECT {Q.spaced('origin', 'amount', 'date', 'description')} AS txt FROM ({Q.TXE})"))
def q_catalog_spaced(spark, sf):
    """U1, spaced form: its catalog, with the number of transactions that hold each token."""
    tx = T.transactions_from_events(spark, sf)
    return _catalog_usage(tx.select(E.spaced_transaction_string("origin", "amount", "date", "description").alias("txt")), "spaced")


@query("special_catalog_tagged", _catalog_usage_sql(_TAGGED_SQL, f"""SELECT '<SOS>' || string_agg({Q.tagged('type', 'amount', 'hour', 'day', 'month', 'day_week', 'merchant')}, '<EOT>') || '<EOS>' AS txt
FROM ({_SPLIT_E}) WHERE client_id IS NOT NULL GROUP BY client_id, date_trunc('day', date)"""))
def q_catalog_tagged(spark, sf):
    """U1, tagged form: its catalog, with the number of client days that hold each token."""
    sd = T.split_date_transactions(T.transactions_from_events(spark, sf)).where(F.col("client_id").isNotNull())
    tx = sd.withColumn("s", E.tagged_transaction_string("type", "amount", "hour", "day", "month", "day_week", "merchant"))
    # a day's text is "<SOS>", its strings with "<EOT>" between and "<EOS>": each string is searched where it lies, no day is gathered
    toks = V.special_token_list("tagged")
    days = tx.groupBy("client_id", F.date_trunc("day", "date").alias("d")).agg(
        F.count("s").alias("n"), *[F.max(F.contains("s", F.lit(t))).alias(t) for t in toks])
    least = {"<SOS>": 1, "<EOS>": 1, "<EOT>": 2}  # strings that make it part of the text

    def held(t):
        return F.col(f"`{t}`") | (F.col("n") >= least[t]) if t in least else F.col(f"`{t}`")
    return _catalog_usage(days, "tagged", held)


@query("special_token_usage", f"""SELECT v.token, v.id, CAST(count(t.tok) AS BIGINT) AS n_used
FROM (SELECT unnest({_SPECIALS_SQL}) AS token, CAST(generate_subscripts({_SPECIALS_SQL}, 1) - 1 AS INTEGER) AS id) v
LEFT JOIN (SELECT unnest(seq) AS tok FROM ({_TXE_SEQ})) t ON t.tok = v.token
GROUP BY v.token, v.id""")
def q_special_usage(spark, sf):
    sp = V.special_tokens(spark, "binned")
    used = S.tokens_long(txe_sequences(spark, sf), "user_id").groupBy("token").agg(F.count(F.lit(1)).alias("n_used"))
    # the special catalog has a fixed size (76 rows): broadcast is bounded
    return used.join(F.broadcast(sp), "token", "right").select(
        "token", "id", F.coalesce(F.col("n_used"), F.lit(0)).alias("n_used"))


_TXE_IDS = f"""SELECT s.user_id, list(coalesce(v.id, 1) ORDER BY s.pos) AS ids
FROM (SELECT user_id, unnest(seq) AS tok, generate_subscripts(seq, 1) AS pos FROM ({_TXE_SEQ})) s
LEFT JOIN ({_TXE_VOCAB}) v ON v.token = s.tok GROUP BY s.user_id"""


def txe_id_sequences(spark, sf, chunk_len=S.DEFAULT_CHUNK_LEN):
    seqs = txe_sequences(spark, sf, chunk_len)
    vocab = hold(txe_vocab(spark, sf))
    return V.tokens_to_ids(seqs, vocab, "tokens", ["user_id", "chunk", "offset", "seq_len"])


@query("token_to_id", Q.chunked(f"SELECT user_id, ids AS seq FROM ({_TXE_IDS})", "user_id", 200, "','").replace("AS tokens", "AS ids"))
def q_token_to_id(spark, sf):
    ids = txe_id_sequences(spark, sf, 200)
    return ids.select("user_id", "chunk", "offset", "seq_len", F.array_join("ids", ",").alias("ids"))


@query("id_to_token", f"""WITH u AS (SELECT i.user_id, list(v.token ORDER BY i.pos) AS seq
  FROM (SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM ({_TXE_IDS})) i
  JOIN ({_TXE_VOCAB}) v ON v.id = i.id GROUP BY i.user_id)
SELECT user_id, CAST(g.k AS INTEGER) AS chunk, array_to_string(seq[g.k * 200 + 1 : (g.k + 1) * 200], ' ') AS tokens,
  array_to_string(seq[g.k * 200 + 1 : (g.k + 1) * 200], '') AS decoded
FROM u, unnest(generate_series(0, (len(seq) - 1) // 200)) AS g(k)""")
def q_id_to_token(spark, sf):
    vocab = hold(txe_vocab(spark, sf))
    ids = V.tokens_to_ids(txe_sequences(spark, sf, 200), vocab, "tokens", ["user_id", "chunk"])
    back = V.ids_to_tokens(ids, vocab, "ids", ["user_id", "chunk"])
    return back.select("user_id", "chunk", joined("tokens").alias("tokens"), V.decode("tokens").alias("decoded"))


@query("label_sequence", f"""SELECT l.row_id, l.user_id, l.label,
  CASE WHEN s.h IS NULL OR len(s.h) = 0 THEN '[PAD]' ELSE array_to_string(s.h, ' ') END AS tokens
FROM ({Q.LAB}) l LEFT JOIN (SELECT user_id, seq[1:512] AS h FROM ({_TXE_SEQ})) s USING (user_id)""")
def q_label_sequence(spark, sf):
    win = S.head_tokens(txe_sequences(spark, sf), "user_id", 512, S.DEFAULT_CHUNK_LEN)
    j = FT.label_sequences(T.label_rows(spark, sf), win)
    return j.select("row_id", "user_id", "label", joined("tokens").alias("tokens"))


@query("label_sequence_as_of", f"""WITH ev AS (SELECT user_id, {Q.TXR_ORDER}, list_concat({Q.tx_tokens('amount', 'date', 'description')}, ['[SEP]']) AS toks FROM ({Q.TXR})),
j AS (SELECT o.o_orderkey AS row_id, flatten(list(toks ORDER BY {Q.TXR_ORDER})) AS f0
  FROM orders o JOIN ev ON ev.user_id = o.o_custkey AND ev.date <= o.o_orderdate GROUP BY o.o_orderkey)
SELECT l.row_id, l.user_id, l.label, coalesce(array_to_string(f0[greatest(len(f0) - 1 - 128, 0) + 1:len(f0) - 1], ' '), '') AS tokens
FROM ({Q.LAB}) l LEFT JOIN j USING (row_id)""")
def q_label_sequence_as_of(spark, sf):
    """J2 with a time cut: the last 128 tokens of the user's transactions up to the order's own date."""
    labels = T.label_rows(spark, sf)
    dates = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"),
                                                F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), F.col("o_orderdate").alias("as_of"))
    out = S.label_sequences_as_of(_txr_token_events(spark, sf), dates.select(*labels.columns, "as_of"), "user_id", T.TXR_ORDER, "toks",
                                  "row_id", "as_of", 128, sep=E.SEP, chunk_len=64)
    return out.select("row_id", "user_id", "label", joined("tokens").alias("tokens"))


@query("corpus_counts", f"""SELECT (SELECT count(*) FROM ({_TXE_SEQ})) AS n_users,
  (SELECT CAST(sum(len(seq)) AS BIGINT) FROM ({_TXE_SEQ})) AS n_tokens,
  (SELECT count(*) FROM ({_TXE_VOCAB})) AS vocab_size,
  (SELECT count(*) FROM ({Q.LAB})) AS n_label_rows,
  (SELECT count(DISTINCT user_id) FROM ({Q.LAB})) AS n_label_users""")
def q_corpus_counts(spark, sf):
    seqs = txe_sequences(spark, sf)
    a = seqs.agg(F.count_distinct("user_id").alias("n_users"), F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"))
    b = txe_vocab(spark, sf).agg(F.count(F.lit(1)).alias("vocab_size"))
    c = T.label_rows(spark, sf).agg(F.count(F.lit(1)).alias("n_label_rows"),
                                    F.count_distinct("user_id").alias("n_label_users"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).select(  # one row each
        "n_users", "n_tokens", "vocab_size", "n_label_rows", "n_label_users")


# ---------------------------------------------------------------------------
# Splits, shuffles, batches: O2, O4, O5, W6-W8, A8

@query("stratified_split", f"""WITH l AS ({Q.LAB}),
c AS (SELECT label, count(*) AS n FROM l GROUP BY label),
t AS (SELECT CAST(ceil(sum(n) * 0.2) AS BIGINT) AS nt, sum(n) AS tot FROM c),
q0 AS (SELECT c.label, floor(t.nt * c.n / t.tot) AS base, t.nt * c.n / t.tot - floor(t.nt * c.n / t.tot) AS frac,
       t.nt FROM c, t),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, label) <= nt - sum(base) OVER ()
      THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT l.*, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) - 1 AS rk FROM l)
SELECT r.row_id, r.user_id, r.label, r.rk < q.quota AS is_test FROM r JOIN q USING (label)""")
def q_stratified(spark, sf):
    return SP.stratified_split(T.label_rows(spark, sf)).select("row_id", "user_id", "label", "is_test")


@query("group_split", f"""SELECT row_id, user_id, label,
  ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS is_test FROM ({Q.LAB})""")
def q_group_split(spark, sf):
    return SP.group_split(T.label_rows(spark, sf)).select("row_id", "user_id", "label", "is_test")


@query("assign_batches", f"""SELECT user_id, CAST(position AS BIGINT) AS position,
  CAST(position // 16 AS BIGINT) AS batch_id FROM (
  SELECT user_id, row_number() OVER (ORDER BY md5('42|0|' || user_id), user_id) - 1 AS position
  FROM ({_TXE_SEQ}))""")
def q_assign_batches(spark, sf):
    users = txe_sequences(spark, sf).where(F.col("chunk") == 0).select("user_id")
    return SP.assign_batches(users, "user_id", 16, seed=42, epoch=0).select("user_id", "position", "batch_id")


@query("shuffle_order", f"""SELECT user_id, md5('7|3|' || user_id) AS shuffle_key,
  CAST(row_number() OVER (ORDER BY md5('7|3|' || user_id), user_id) - 1 AS BIGINT) AS position
FROM (SELECT DISTINCT user_id FROM ({Q.LAB}))""")
def q_shuffle_order(spark, sf):
    users = T.label_rows(spark, sf).select("user_id").distinct()
    out = users.withColumn("shuffle_key", SP.hash_order(7, "user_id", 3))
    return global_index(out, ["shuffle_key", "user_id"], name="position")


def txe_padded(spark, sf):
    ids = txe_id_sequences(spark, sf).withColumnRenamed("ids", "tokens")
    return PL.pretrain_batches(ids, PL.PretrainConfig())


@query("pad_batches", f"""WITH b AS (SELECT user_id, ids[1:513] AS h,
    (row_number() OVER (ORDER BY md5('42|0|' || user_id), user_id) - 1) // 16 AS batch_id FROM ({_TXE_IDS})),
xy AS (SELECT user_id, batch_id, h[1:len(h)-1] AS x, h[2:len(h)] AS y FROM b),
m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS batch_len FROM xy)
SELECT user_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(batch_len AS INTEGER) AS batch_len,
  array_to_string(list_concat(x, list_transform(range(batch_len - len(x)), lambda i: 0)), ',') AS x,
  array_to_string(list_concat(y, list_transform(range(batch_len - len(y)), lambda i: -1)), ',') AS y
FROM m""")
def q_pad_batches(spark, sf):
    p = txe_padded(spark, sf)
    return p.select("user_id", "batch_id", "batch_len", F.array_join("x", ",").alias("x"),
                    F.array_join("y", ",").alias("y"))


_USERS = f"SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS position FROM (SELECT DISTINCT user_id FROM ({Q.LAB}))"


def _permuted_sql(epoch: int, seed: int) -> str:
    """The swap-or-not rounds, one nested query each, from their stated constants."""
    q = f"SELECT user_id, position, position AS x, n FROM u, (SELECT count(*) AS n FROM u)"
    for key, factor, shift in SP.round_constants(seed, epoch):
        q = f"""SELECT user_id, position, CASE WHEN ((greatest(x, y) * {factor} + {shift}) % 2147483647 >> 13) % 2 = 1 THEN y ELSE x END AS x, n
FROM (SELECT *, ((({key} % n - x) % n) + n) % n AS y FROM ({q}))"""
    return f"SELECT user_id, position, {epoch} AS epoch, CAST(x AS BIGINT) AS shuffled, CAST(x // 16 AS BIGINT) AS batch_id FROM ({q})"


@query("epoch_batches", f"WITH u AS ({_USERS}) {_permuted_sql(0, 42)} UNION ALL {_permuted_sql(1, 42)}")
def q_epoch_batches(spark, sf):
    """W7 + W8 for two epochs: users are numbered once and written; every epoch's
    batch id is an expression of the stored number."""
    users = T.label_rows(spark, sf).select("user_id").distinct()
    _, numbered = written(global_index(users, ["user_id"], name="position").select("user_id", "position"), "positions", kept=True)
    return SP.epoch_batches(numbered, 16, seed=42, epochs=2)


def _lengths(spark, sf):
    """(user_id, length) of the line items' sequences, cut at 513 tokens."""
    return (_txr_token_events(spark, sf).where(F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(F.least(F.sum(F.size("toks") + 1) - 1, F.lit(513)).cast("int").alias("length")))


_LENGTHS = f"SELECT user_id, CAST(least(len(seq), 513) AS INTEGER) AS length FROM ({_TXR_SEQ})"
_PACKED = f"""l AS ({_LENGTHS}), bl AS (SELECT length, count(*) AS n FROM l GROUP BY length),
cut AS (SELECT length, n, CAST(floor((sum(n) OVER (ORDER BY length) - n) * 16 / sum(n) OVER ()) AS INTEGER) AS bucket FROM bl),
per AS (SELECT bucket, sum(n) AS rows_, greatest(8192 // max(length), 1) AS batch_rows FROM cut GROUP BY bucket),
pre AS (SELECT *, coalesce(sum(ceil(rows_ / batch_rows)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_batch FROM per),
r AS (SELECT l.user_id, l.length, c.bucket, row_number() OVER (PARTITION BY c.bucket ORDER BY md5('42|0|' || l.user_id), l.user_id) - 1 AS place FROM l JOIN cut c USING (length)),
packed AS (SELECT user_id, length, r.bucket, CAST(first_batch + place // batch_rows AS BIGINT) AS batch_id FROM r JOIN pre USING (bucket))"""


@query("packed_batches", f"WITH {_PACKED} SELECT * FROM packed")
def q_packed_batches(spark, sf):
    """W6 by length: batches of like lengths within a budget of padded tokens."""
    return SP.packed_batches(_lengths(spark, sf), "user_id").select("user_id", "length", "bucket", "batch_id")


@query("padding_report", f"""WITH {_PACKED}, plain AS (
  SELECT length, (row_number() OVER (ORDER BY md5('42|0|' || user_id), user_id) - 1) // 16 AS batch_id FROM l),
one AS (SELECT 'packed' AS form, batch_id, sum(length) AS t, max(length) * count(*) AS p FROM packed GROUP BY batch_id
  UNION ALL SELECT 'fixed' AS form, batch_id, sum(length) AS t, max(length) * count(*) AS p FROM plain GROUP BY batch_id)
SELECT form, count(*) AS n_batches, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(p) AS BIGINT) AS padded_tokens, round(1 - sum(t) / sum(p), 9) AS padding FROM one GROUP BY form""")
def q_padding_report(spark, sf):
    """Padding of packed batches beside that of batches of 16 in shuffled order."""
    rows = hold(_lengths(spark, sf))
    packed = SP.padding_share(SP.packed_batches(rows, "user_id")).withColumn("form", F.lit("packed"))
    fixed = SP.padding_share(SP.assign_batches(rows, "user_id", 16)).withColumn("form", F.lit("fixed"))
    return packed.unionByName(fixed).select("form", "n_batches", "tokens", "padded_tokens", F.round("padding", 9).alias("padding"))


@query("mean_of_batch_means", f"""SELECT round(avg(bm), 9) AS mean_of_batch_means, count(*) AS n_batches FROM (
  SELECT batch_id, avg(CAST(len(seq) AS DOUBLE)) AS bm FROM (
    SELECT seq, (row_number() OVER (ORDER BY md5('42|0|' || user_id), user_id) - 1) // 16 AS batch_id
    FROM ({_TXE_SEQ})) GROUP BY batch_id)""")
def q_mean_of_batch_means(spark, sf):
    users = txe_sequences(spark, sf).where(F.col("chunk") == 0).select("user_id", F.col("seq_len").cast("double"))
    b = SP.assign_batches(users, "user_id", 16, seed=42, epoch=0)
    r = M.mean_of_batch_means(b, "seq_len")
    return r.select(F.round("mean_of_batch_means", 9).alias("mean_of_batch_means"), "n_batches")


@query("sample_k", f"""SELECT user_id, seq_len FROM (SELECT user_id, CAST(len(seq) AS BIGINT) AS seq_len,
  md5('42|' || user_id) AS h FROM ({_TXE_SEQ})) ORDER BY h, user_id LIMIT 3""")
def q_sample_k(spark, sf):
    users = txe_sequences(spark, sf).where(F.col("chunk") == 0).select("user_id", "seq_len")
    return SP.sample_k(users, "user_id", 3, seed=42)


# ---------------------------------------------------------------------------
# Scores and metrics: P14, A10, A11, A13, M7 on a data-derived logit

_SCORES = f"""SELECT l.row_id, l.user_id, l.label, f.num_acctbal / 1000.0 - 4.5 AS logit
FROM ({Q.LAB}) l JOIN ({Q.FEAT}) f USING (user_id)"""


def score_rows(spark, sf):
    lab = T.label_rows(spark, sf)
    f = T.customer_features(spark, sf)
    return lab.join(f, "user_id").select("row_id", "user_id", "label",
                                         (F.col("num_acctbal") / 1000.0 - 4.5).alias("logit"))


@query("sigmoid_score", f"SELECT row_id, round(1.0 / (1.0 + exp(-logit)), 9) AS p FROM ({_SCORES})")
def q_sigmoid(spark, sf):
    return score_rows(spark, sf).select("row_id", F.round(M.sigmoid("logit"), 9).alias("p"))


@query("bce_logits", f"""SELECT round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 9) AS bce
FROM ({_SCORES})""")
def q_bce(spark, sf):
    return M.bce_with_logits(score_rows(spark, sf)).select(F.round("bce", 9).alias("bce"))


@query("class_cross_entropy", f"""SELECT round(avg(ln(exp(z0 - m) + exp(z1 - m)) + m
  - CASE WHEN label = 1 THEN z1 ELSE z0 END), 9) AS class_cross_entropy
FROM (SELECT label, -logit / 2 AS z0, logit / 2 AS z1, greatest(-logit / 2, logit / 2) AS m FROM ({_SCORES}))""")
def q_class_ce(spark, sf):
    s = score_rows(spark, sf).withColumn("z", F.array(-F.col("logit") / 2, F.col("logit") / 2))
    return s.agg(F.round(F.avg(M.class_cross_entropy_terms("z", "label")), 9).alias("class_cross_entropy"))


_AUC_SQL = f"""WITH s AS (SELECT logit AS score, label FROM ({_SCORES})),
g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos,
      sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::DOUBLE AS neg FROM s GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM g)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


@query("roc_auc", _AUC_SQL)
def q_roc_auc(spark, sf):
    s = score_rows(spark, sf).select(F.col("logit").alias("score"), "label")
    return M.roc_auc(s).select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query("evaluate_scores", f"""SELECT count(*) AS n,
  round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 9) AS bce,
  round(avg(CASE WHEN (1.0 / (1.0 + exp(-logit)) >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
  (SELECT auc FROM ({_AUC_SQL})) AS auc FROM ({_SCORES})""")
def q_evaluate(spark, sf):
    r = M.evaluate_scores(score_rows(spark, sf))
    return r.select("n", F.round("bce", 9).alias("bce"), F.round("accuracy", 9).alias("accuracy"),
                    F.round("auc", 9).alias("auc"))


# ---------------------------------------------------------------------------
# Corpus-scale tokenizer: B1-B9

from ledgerloom.operators import bpe as B  # noqa: E402


def txr_descriptions(spark, sf):
    """The distinct descriptions of the line items' transactions (their
    orders give only the user, so they are not joined)."""
    li = T.table(spark, sf, "lineitem").select("l_partkey").distinct()
    p = T.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("description"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("description").distinct()


@query("pretokenize", f"""SELECT description, array_to_string({Q.words('description')}, ' ') AS words
FROM (SELECT DISTINCT description FROM ({Q.TXR}))""")
def q_pretokenize(spark, sf):
    d = txr_descriptions(spark, sf)
    return d.select("description", F.array_join(B.pretokenize("description"), " ").alias("words"))


_UWORD = r"[\p{L}\p{N}\p{M}_]"


@query("word_histogram", f"""SELECT w AS word, count(*) AS cnt FROM (
  SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_UWORD}+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]+')) AS w FROM documents)
GROUP BY w""")
def q_word_histogram(spark, sf):
    return B.word_histogram(T.table(spark, sf, "documents"), "text")


_SPACED_SPECIALS = V.special_token_list("spaced")


@query("special_aware_split", f"""SELECT tx_id, array_to_string(regexp_extract_all(
  {Q.spaced('origin', 'amount', 'date', 'description')},
  '<account>|<card>|<INFLOW>|<OUTFLOW>|<AMOUNT_(?:0-10|10-50|50-100|100-500|500-1000|1000\\+)>|<MONTH_(?:1[0-2]|[1-9])>|<DAY_(?:[12][0-9]|3[01]|[1-9])>|<WEEKDAY_[0-6]>|\\[(?:PAD|UNK|SEP)\\]|\\w+|[^\\w\\s]+'), ' ') AS words
FROM ({Q.TXE})""")
def q_special_split(spark, sf):
    tx = T.transactions_from_events(spark, sf)
    s = E.spaced_transaction_string("origin", "amount", "date", "description")
    return tx.select("tx_id", F.array_join(B.pretokenize(s, _SPACED_SPECIALS), " ").alias("words"))


_DESC_HIST = f"""SELECT w AS word, count(*) AS cnt FROM (
  SELECT unnest({Q.words('description')}) AS w FROM (SELECT DISTINCT description FROM ({Q.TXR})))
GROUP BY w"""


def txr_description_histogram(spark, sf):
    d = txr_descriptions(spark, sf)
    return B.word_histogram(d, "description")


@query("bpe_pair_counts", f"""WITH h AS ({_DESC_HIST}),
c AS (SELECT cnt, regexp_extract_all(word, '.') AS ch FROM h)
SELECT ch[i] AS "left", ch[i + 1] AS "right", CAST(sum(cnt) AS BIGINT) AS cnt
FROM c, unnest(generate_series(1, len(ch) - 1)) AS g(i) GROUP BY ch[i], ch[i + 1]""")
def q_pair_counts(spark, sf):
    h = txr_description_histogram(spark, sf)
    return B.pair_counts(h.select("cnt", B.char_symbols("word").alias("sym")))


def _bpe_sql(hist: str, specials: str, size: int) -> str:
    """Greedy byte-pair training, one merge a step, over a (word, cnt) histogram:
    ``st`` (step, words with their symbols, vocabulary, merged pair), and
    ``fin``, its last state."""
    return f"""RECURSIVE h AS MATERIALIZED ({hist}),
st AS (SELECT 0 AS step, (SELECT list({{'word': word, 'cnt': cnt, 'sym': regexp_extract_all(word, '.')}}) FROM h) AS words,
  list_concat({specials}, (SELECT list(DISTINCT ch ORDER BY ch) FROM (SELECT unnest(regexp_extract_all(word, '.')) AS ch FROM h))) AS vocab,
  {{'l': NULL::VARCHAR, 'r': NULL::VARCHAR}} AS b
UNION ALL
SELECT step + 1, list_transform(words, lambda w: {{'word': w.word, 'cnt': w.cnt, 'sym': list_reduce(list_transform(w.sym, lambda x: [x]), lambda a, x:
    CASE WHEN a[-1] = n.b.l AND x[1] = n.b.r THEN list_append(a[1:len(a) - 1], n.b.l || n.b.r) ELSE list_concat(a, x) END)}}),
  CASE WHEN list_contains(vocab, n.b.l || n.b.r) THEN vocab ELSE list_append(vocab, n.b.l || n.b.r) END, n.b
FROM st, LATERAL (SELECT arg_min({{'l': l, 'r': r}}, (-c, list_position(vocab, l), list_position(vocab, r))) AS b FROM (
  SELECT l, r, sum(cnt) AS c FROM (SELECT w.cnt AS cnt, unnest(w.sym[1:len(w.sym) - 1]) AS l, unnest(w.sym[2:]) AS r FROM (SELECT unnest(words) AS w))
  WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY l, r)) n
WHERE len(vocab) < {size} AND n.b IS NOT NULL),
fin AS (SELECT words, vocab FROM st WHERE step = (SELECT max(step) FROM st)),
lex AS (SELECT w.word AS word, w.sym AS sym FROM (SELECT unnest(words) AS w FROM fin))"""


_MERGES = """SELECT CAST(step - 1 AS INTEGER) AS rank, b.l AS "left", b.r AS "right", b.l || b.r AS merged FROM st WHERE step > 0"""


def _encode_sql(texts: str, keys: str, text: str, pattern: str, specials: str) -> str:
    """(keys, pieces) of texts, specials whole, over ``lex``."""
    return f"""SELECT {keys}, flatten(list(CASE WHEN list_contains({specials}, w) THEN [w] ELSE sym END ORDER BY i)) AS pieces FROM (
  SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {keys}, regexp_extract_all(coalesce({text}, ''), '{pattern}') AS ws FROM ({texts})))
  LEFT JOIN lex ON lex.word = w GROUP BY {keys}"""


_IDS = "array_to_string(list_transform(pieces, lambda x: list_position(vocab, x) - 1), ',')"
_PLAIN = r"\w+|[^\w\s]+"


def txr_bpe(spark, sf, vocab_size=10000):
    """The tokenizer of the binned form: trained on distinct descriptions only."""
    return B.train_bpe(spark, txr_description_histogram(spark, sf), vocab_size, V.special_token_list("binned"))


@query("bpe_merges", f"WITH {_bpe_sql(_DESC_HIST, _SPECIALS_SQL, 10000)} {_MERGES}")
def q_bpe_merges(spark, sf):
    """The learned merge list (rank, left, right, merged); checked
    against the tokenizers library in tests/test_bpe.py."""
    return txr_bpe(spark, sf).merges


@query("bpe_merges_documents")
def q_bpe_merges_documents(spark, sf):
    """B5 at length: about 2,100 merges over all words of the documents, equal
    to the tokenizers library's (tests/test_bpe_train.py)."""
    words = B.word_histogram(T.table(spark, sf, "documents"), "text")
    return B.train_bpe(spark, words, 2200, ["[PAD]", "[UNK]"]).merges


@query("bpe_vocabulary", f"""WITH {_bpe_sql(_DESC_HIST, _SPECIALS_SQL, 10000)}
SELECT token, CAST(i - 1 AS INTEGER) AS id, list_contains({_SPECIALS_SQL}, token) AS is_special
FROM (SELECT unnest(vocab) AS token, generate_subscripts(vocab, 1) AS i FROM fin)""")
def q_bpe_vocab(spark, sf):
    """The learned vocabulary with special flags."""
    return txr_bpe(spark, sf).vocab


def _encoded_descriptions(spark, sf):
    d = txr_descriptions(spark, sf)
    d = hold(d)
    return d, B.encode_texts(d, ["description"], "description", B.train_bpe(
        spark, B.word_histogram(d, "description"), 10000, V.special_token_list("binned")))


@query("bpe_encode", f"""WITH {_bpe_sql(_DESC_HIST, _SPECIALS_SQL, 10000)},
e AS ({_encode_sql(f"SELECT DISTINCT description FROM ({Q.TXR})", "description", "description", _PLAIN, "[]::VARCHAR[]")})
SELECT description, array_to_string(pieces, ' ') AS pieces, {_IDS} AS ids FROM e, fin""")
def q_bpe_encode(spark, sf):
    """Every distinct description as BPE pieces and ids."""
    _, enc = _encoded_descriptions(spark, sf)
    return enc.select("description", joined("pieces").alias("pieces"), F.array_join("ids", ",").alias("ids"))


@query("decode_tokens", f"""SELECT description, regexp_replace(description, '\\s', '', 'g') AS decoded
FROM (SELECT DISTINCT description FROM ({Q.TXR}))""")
def q_decode(spark, sf):
    """Decoding concatenates pieces, so spaces are lost."""
    d, enc = _encoded_descriptions(spark, sf)
    return d.join(enc, "description", "left").select(
        "description", F.coalesce(V.decode("pieces"), F.lit("")).alias("decoded"))


# ---------------------------------------------------------------------------
# Next-token statistics: M1-M3, A9, A12

from ledgerloom.operators import ngram as NG  # noqa: E402

def _ng(corpus: str) -> str:
    return f"""s AS ({_TXE_SEQ}),
pos AS (SELECT user_id, i AS pos, seq[i] AS token, CASE WHEN i > 1 THEN seq[i - 1] END AS c1,
        CASE WHEN i > 2 THEN seq[i - 2] END AS c2 FROM ({corpus}), unnest(generate_series(1, len(seq))) AS g(i)),
uni AS (SELECT token, count(*) AS cnt FROM pos GROUP BY token),
tot AS (SELECT sum(cnt) AS N, count(*) AS V FROM uni),
p0 AS (SELECT token, cnt, (cnt + CAST(1 AS DOUBLE) / V) / (N + CAST(1 AS DOUBLE)) AS p0 FROM uni, tot),
bi AS (SELECT c1, token, count(*) AS cnt FROM pos WHERE c1 IS NOT NULL GROUP BY c1, token),
ctx1 AS (SELECT c1, sum(cnt) AS ctx_cnt FROM bi GROUP BY c1),
p1 AS (SELECT b.c1, b.token, b.cnt, (b.cnt + p0.p0) / (x.ctx_cnt + CAST(1 AS DOUBLE)) AS p1
       FROM bi b JOIN ctx1 x USING (c1) JOIN p0 USING (token)),
tri AS (SELECT c2, c1, token, count(*) AS cnt FROM pos WHERE c2 IS NOT NULL GROUP BY c2, c1, token),
ctx2 AS (SELECT c2, c1, sum(cnt) AS ctx_cnt FROM tri GROUP BY c2, c1),
p2 AS (SELECT t.c2, t.c1, t.token, t.cnt, (t.cnt + p1.p1) / (x.ctx_cnt + CAST(1 AS DOUBLE)) AS p2
       FROM tri t JOIN ctx2 x USING (c2, c1) JOIN p1 USING (c1, token))"""


_NG = _ng("s")
# without the tails that predictions are held against
_NG_TRAIN = _ng("SELECT user_id, CASE WHEN len(seq) > 15 THEN seq[1:len(seq) - 5] ELSE seq END AS seq FROM s")


def txe_ngram(spark, sf, seqs=None):
    seqs = txe_sequences(spark, sf) if seqs is None else seqs
    pos = NG.positions_with_context(seqs, "user_id")
    return pos, NG.ngram_model(pos)


def txe_predictions(spark, sf, k=5):
    """Greedy next-token predictions after holding out the last k tokens of
    every sequence longer than k + 10 (the reference's predict script)."""
    seqs = txe_sequences(spark, sf)
    _, m = txe_ngram(spark, sf, NG.training_part(seqs, "user_id", k, k + 10))
    ctx, actual = NG.holdout_contexts(seqs.where(F.col("seq_len") > k + 10), "user_id", k)
    return NG.greedy_next_tokens(ctx, "user_id", NG.argmax_tables(m), k), actual


@query("ngram_counts", f"""WITH {_NG}
SELECT 0 AS "order", '' AS ctx, token, cnt FROM uni
UNION ALL SELECT 1, c1, token, cnt FROM bi
UNION ALL SELECT 2, c2 || ' ' || c1, token, cnt FROM tri""")
def q_ngram_counts(spark, sf):
    pos = NG.positions_with_context(txe_sequences(spark, sf), "user_id")
    c = NG.ngram_counts(pos)
    return (c["uni"].select(F.lit(0).alias("order"), F.lit("").alias("ctx"), "token", "cnt")
            .unionByName(c["bi"].select(F.lit(1).alias("order"), F.col("c1").alias("ctx"), "token", "cnt"))
            .unionByName(c["tri"].select(F.lit(2).alias("order"), F.concat_ws(" ", "c2", "c1").alias("ctx"),
                                         "token", "cnt")))


@query("next_token_probs", f"""WITH {_NG}
SELECT c2, c1, token, round(p2, 9) AS p FROM p2""")
def q_next_token_probs(spark, sf):
    _, m = txe_ngram(spark, sf)
    return m["p2"].select("c2", "c1", "token", F.round("p2", 9).alias("p"))


@query("cross_entropy", f"""WITH {_NG}
SELECT round(avg(-ln(CASE WHEN pos.c2 IS NOT NULL THEN p2.p2 WHEN pos.c1 IS NOT NULL THEN p1.p1 ELSE p0.p0 END)), 9)
  AS cross_entropy, count(*) AS n_tokens
FROM pos LEFT JOIN p2 USING (c2, c1, token) LEFT JOIN p1 USING (c1, token) LEFT JOIN p0 USING (token)""")
def q_cross_entropy(spark, sf):
    _, m = txe_ngram(spark, sf)
    r = NG.corpus_cross_entropy(m, m)
    return r.select(F.round("cross_entropy", 9).alias("cross_entropy"), "n_tokens")


_ARGMAX = """a2 AS (SELECT c2, c1, arg_min(token, (-p2, token)) AS next_token FROM p2 GROUP BY c2, c1),
a1 AS (SELECT c1, arg_min(token, (-p1, token)) AS next_token FROM p1 GROUP BY c1),
a0 AS (SELECT arg_min(token, (-p0, token)) AS next_token FROM p0)"""


@query("argmax_token", f"""WITH {_NG}, {_ARGMAX}
SELECT c1, next_token FROM a1""")
def q_argmax(spark, sf):
    _, m = txe_ngram(spark, sf)
    return NG.argmax_tables(m)["a1"]


def _greedy_sql(k: int) -> str:
    steps = ["""st0 AS (SELECT user_id, CASE WHEN len(inp) >= 2 THEN inp[len(inp) - 1] END AS t, inp[len(inp)] AS u,
  []::VARCHAR[] AS predicted FROM (SELECT user_id, seq[1:len(seq) - 5] AS inp FROM s WHERE len(seq) > 15))"""]
    for i in range(1, k + 1):
        steps.append(f"""st{i} AS (SELECT p.user_id, p.u AS t, coalesce(a2.next_token, a1.next_token, a0.next_token) AS u,
  list_append(p.predicted, coalesce(a2.next_token, a1.next_token, a0.next_token)) AS predicted
  FROM st{i - 1} p LEFT JOIN a2 ON a2.c2 = p.t AND a2.c1 = p.u LEFT JOIN a1 ON a1.c1 = p.u, a0)""")
    return ",\n".join(steps)


@query("greedy_next_tokens", f"""WITH {_NG_TRAIN}, {_ARGMAX}, {_greedy_sql(5)}
SELECT user_id, array_to_string(predicted, ' ') AS predicted FROM st5""")
def q_greedy(spark, sf):
    pred, _ = txe_predictions(spark, sf)
    return pred.select("user_id", joined("predicted").alias("predicted"))


@query("next_token_accuracy", f"""WITH {_NG_TRAIN}, {_ARGMAX}, {_greedy_sql(5)},
act AS (SELECT user_id, seq[len(seq) - 4:] AS actual FROM s WHERE len(seq) > 15)
SELECT CAST(i AS INTEGER) AS position, round(avg(CASE WHEN st5.predicted[i] = act.actual[i] THEN 1.0 ELSE 0.0 END), 9)
  AS accuracy, count(*) AS n
FROM st5 JOIN act USING (user_id), unnest(generate_series(1, 5)) AS g(i) GROUP BY i""")
def q_accuracy(spark, sf):
    pred, actual = txe_predictions(spark, sf)
    acc = NG.next_token_accuracy(pred, actual, "user_id")
    return acc.select(F.col("position").cast("int").alias("position"), F.round("accuracy", 9).alias("accuracy"), "n")


@query("format_tokens", f"""WITH {_NG_TRAIN}, {_ARGMAX}, {_greedy_sql(5)},
v AS ({_TXE_VOCAB})
SELECT st5.user_id, string_agg(st5.tok || '(' || coalesce(CAST(v.id AS VARCHAR), '1') || ')', ' ' ORDER BY st5.i)
  AS rendered
FROM (SELECT user_id, unnest(predicted) AS tok, generate_subscripts(predicted, 1) AS i FROM st5) st5
LEFT JOIN v ON v.token = st5.tok GROUP BY st5.user_id""")
def q_format_tokens(spark, sf):
    """P17 on the greedy predictions: ``token(id)`` pairs joined by spaces."""
    pred, _ = txe_predictions(spark, sf)
    ids = V.tokens_to_ids(pred, txe_vocab(spark, sf), "predicted", ["user_id"])
    return pred.join(ids, "user_id").select("user_id", E.format_tokens("predicted", "ids").alias("rendered"))


# ---------------------------------------------------------------------------
# Vectors: J6, A14, P15, P16, M4

from ledgerloom.operators import embed as EM  # noqa: E402

_TXE_ID_LONG = f"""SELECT user_id, CAST(generate_subscripts(ids, 1) - 1 AS BIGINT) AS pos, unnest(ids) AS token_id
FROM ({_TXE_IDS})"""


def txe_ids_long(spark, sf):
    ids = txe_id_sequences(spark, sf).withColumnRenamed("ids", "tokens")
    return S.tokens_long(ids, "user_id").withColumnRenamed("token", "token_id")


@query("embedding_lookup", f"""SELECT l.user_id, l.pos, l.token_id, e.vec_id, e.embedding[1] AS e0
FROM ({_TXE_ID_LONG}) l LEFT JOIN embeddings e ON e.vec_id = l.token_id""")
def q_embedding_lookup(spark, sf):
    v = EM.embedding_lookup(txe_ids_long(spark, sf), T.table(spark, sf, "embeddings"))
    return v.select("user_id", "pos", "token_id", "vec_id", F.col("embedding")[0].alias("e0"))


_TXE_VECS = f"""SELECT l.user_id, l.pos, e.embedding FROM ({_TXE_ID_LONG}) l
JOIN embeddings e ON e.vec_id = l.token_id"""


@query("pool_mean", f"""SELECT user_id, CAST(d - 1 AS INTEGER) AS dim, round(avg(v::DOUBLE), 6) AS value FROM (
  SELECT user_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM ({_TXE_VECS}))
GROUP BY user_id, d""")
def q_pool_mean(spark, sf):
    p = EM.pool_mean(txe_ids_long(spark, sf), T.table(spark, sf, "embeddings"), "user_id")
    return p.select("user_id", "dim", F.round("value", 6).alias("value"))


@query("pool_last", f"""SELECT user_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
  unnest(embedding) AS value FROM (SELECT user_id, arg_max(embedding, pos) AS embedding FROM ({_TXE_VECS})
  GROUP BY user_id)""")
def q_pool_last(spark, sf):
    return EM.pool_last(txe_ids_long(spark, sf), T.table(spark, sf, "embeddings"), "user_id")


# Fixed parameters of the periodic encoding (a rule, not learned here):
# frequency f[i][j] = 0.5 * (j + 1) / (i + 1), bias b[i][j] = 0.1 * j.
_PER_COLS = ["x_acctbal", "x_orders", "x_spend"]
_PER_FREQ = 4
_F = [[0.5 * (j + 1) / (i + 1) for j in range(_PER_FREQ)] for i in range(len(_PER_COLS))]
_B = [[0.1 * j for j in range(_PER_FREQ)] for i in range(len(_PER_COLS))]
_SCALED = f"""SELECT user_id, num_acctbal / 1000.0 AS x_acctbal, num_orders / 10.0 AS x_orders,
  num_spend / 100000.0 AS x_spend FROM ({Q.FEAT})"""


def scaled_features(spark, sf):
    f = T.customer_features(spark, sf)
    return f.select("user_id", (F.col("num_acctbal") / 1000.0).alias("x_acctbal"),
                    (F.col("num_orders") / 10.0).alias("x_orders"), (F.col("num_spend") / 100000.0).alias("x_spend"))


_PER_SQL = " UNION ALL ".join(
    f"SELECT user_id, {i * _PER_FREQ + j} AS k, round(sin({c} * {_F[i][j]!r} + {_B[i][j]!r}), 9) AS value FROM x"
    for i, c in enumerate(_PER_COLS) for j in range(_PER_FREQ))


@query("periodic_features", f"WITH x AS ({_SCALED}) {_PER_SQL}")
def q_periodic(spark, sf):
    x = scaled_features(spark, sf)
    arr = EM.periodic_features(_PER_COLS, _PER_FREQ, _F, _B)
    return x.select("user_id", F.posexplode(arr).alias("k", "value")) \
            .select("user_id", "k", F.round("value", 9).alias("value"))


@query("cross_features", f"""SELECT user_id, x_acctbal * x_acctbal AS c00, x_acctbal * x_orders AS c01,
  x_acctbal * x_spend AS c02, x_orders * x_orders AS c11, x_orders * x_spend AS c12, x_spend * x_spend AS c22
FROM ({_SCALED})""")
def q_cross(spark, sf):
    x = scaled_features(spark, sf)
    arr = EM.cross_features(_PER_COLS)
    names = ["c00", "c01", "c02", "c11", "c12", "c22"]
    return x.select("user_id", *[arr[i].alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------------------
# Classifiers: M4-M8 (closed-form here; the Spark ML pipelines are tested in
# tests/test_models.py)

from ledgerloom.operators import models as ML  # noqa: E402


@query("user_embedding_projection", f"""SELECT user_id, CAST(d AS INTEGER) AS dim,
  round(avg(CASE WHEN substr(md5(tok), d + 1, 1) >= '8' THEN 1.0 ELSE -1.0 END), 9) AS value
FROM (SELECT user_id, unnest(seq) AS tok FROM ({_TXE_SEQ})), unnest(range(16)) AS g(d) GROUP BY user_id, d""")
def q_user_projection(spark, sf):
    """M4: the mean random projection of all tokens of each user."""
    p = EM.projected_users(S.tokens_long(txe_sequences(spark, sf), "user_id"), "user_id")
    return p.select("user_id", "dim", F.round("value", 9).alias("value"))


def docq_frame(spark, sf):
    # dealt by document: its tokens are counted, weighed and added up where its text lies
    d = T.labelled_documents(spark, sf).repartition("user_id")
    d = d.withColumn("tokens", F.transform(B.pretokenize("text"), lambda w: F.lower(w)))
    return SP.group_split(d, "user_id")


_BAYES = f"""d AS (SELECT doc_id AS user_id, quality AS label, text, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS is_test
  FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT user_id, lower(w) AS token, count(*) AS cnt FROM (
  SELECT user_id, unnest(regexp_extract_all(coalesce(text, ''), '{_UWORD}+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]+')) AS w FROM d) GROUP BY user_id, lower(w)),
tr AS (SELECT user_id, label FROM d WHERE label IS NOT NULL AND NOT is_test),
c AS (SELECT token, sum(CASE WHEN label = 1 THEN cnt ELSE 0 END) AS c1, sum(CASE WHEN label = 1 THEN 0 ELSE cnt END) AS c0
  FROM t JOIN tr USING (user_id) GROUP BY token),
tot AS (SELECT sum(c1) AS n1, sum(c0) AS n0, count(*) AS V FROM c),
w AS (SELECT token, ln((c1 + 1)::DOUBLE / (n1 + V)) - ln((c0 + 1)::DOUBLE / (n0 + V)) AS w FROM c, tot),
pri AS (SELECT ln((sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) + 1)::DOUBLE / (sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) + 1)) AS prior FROM tr),
sc AS (SELECT user_id, sum(cnt * w) AS s FROM t JOIN w USING (token) GROUP BY user_id),
scored AS (SELECT d.user_id, d.label, d.is_test, round(prior + coalesce(s, 0), 6) AS logit FROM d LEFT JOIN sc USING (user_id), pri)"""


def docq_scores(spark, sf):
    d = docq_frame(spark, sf)
    bag = d.select("user_id", F.explode("tokens").alias("token")).groupBy("user_id", "token").agg(F.count(F.lit(1)).alias("cnt"))
    out = ML.bag_classifier(d.select("user_id", "label", "is_test"), bag, "user_id")
    return out.select("user_id", "label", "is_test", F.round("logit", 6).alias("logit"))


@query("seq_classifier_scores", f"WITH {_BAYES} SELECT * FROM scored")
def q_seq_scores(spark, sf):
    """M5: token counts -> naive Bayes, learned from the labelled training
    documents; a logit for every document."""
    return docq_scores(spark, sf)


_TEST_AUC = """g AS (SELECT logit, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::DOUBLE AS neg
  FROM scored WHERE is_test AND label IS NOT NULL GROUP BY logit),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY logit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b)"""


@query("seq_classifier_auc", f"WITH {_BAYES}, {_TEST_AUC} SELECT * FROM a")
def q_seq_auc(spark, sf):
    """M5 + A13: exact test AUC of the sequence-only classifier."""
    s = docq_scores(spark, sf).where(F.col("is_test") & F.col("label").isNotNull())
    return M.roc_auc(s.select(F.col("logit").alias("score"), "label")).select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query("seq_classifier_report", f"""WITH {_BAYES}, {_TEST_AUC}
SELECT count(*) AS n, round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS bce,
  round(avg(CASE WHEN (logit >= 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, (SELECT auc FROM a) AS auc
FROM scored WHERE is_test AND label IS NOT NULL""")
def q_seq_report(spark, sf):
    """M7: the fitted classifier on its test split."""
    s = hold(docq_scores(spark, sf).where(F.col("is_test") & F.col("label").isNotNull()))
    r = M.evaluate_scores(s)
    return r.select("n", F.round("bce", 6).alias("bce"), F.round("accuracy", 9).alias("accuracy"), F.round("auc", 9).alias("auc"))


def fusion_users(spark, sf):
    """One row per user with training labels counted by class, and the user's
    token counts over its whole history."""
    lab = SP.group_split(T.label_rows(spark, sf), "user_id")
    train = lab.where(~F.col("is_test")).groupBy("user_id").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    x = scaled_features(spark, sf)
    crs = x.select("user_id", *[EM.cross_features(_PER_COLS)[i].alias(f"crs{i}") for i in range(6)])
    users = T.customer_features(spark, sf).join(crs, "user_id").join(train, "user_id", "left") \
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pos", "neg")})
    tx = T.transactions_from_lineitem(spark, sf)
    bag = tx.where("user_id is not null").select("user_id", F.explode(E.transaction_tokens("amount", "date", "description")).alias("token")) \
        .groupBy("user_id", "token").agg(F.count(F.lit(1)).alias("cnt"))
    return lab, users, bag


_CRS = [f"crs{i}" for i in range(6)]
_FUSION_NUM = [*T.FEAT_NUMERICAL, *_CRS]


def _gauss_sql(c: str) -> str:
    return f"(ln(v0{c} / v1{c}) - ({c} - m1{c}) * ({c} - m1{c}) / v1{c} + ({c} - m0{c}) * ({c} - m0{c}) / v0{c}) / 2"


_MOMENTS = ", ".join(f"sum({s} * {c}::DOUBLE) / sum({s}) AS m{k}{c}, sum({s} * {c}::DOUBLE * {c}::DOUBLE) / sum({s}) - pow(sum({s} * {c}::DOUBLE) / sum({s}), 2) + 1e-9 AS v{k}{c}"
                     for c in _FUSION_NUM for s, k in (("pos", 1), ("neg", 0)))


def _nb_sql(counts: str) -> str:
    return f"""SELECT token, ln((pos + 1)::DOUBLE / (n1 + V)) - ln((neg + 1)::DOUBLE / (n0 + V)) AS w
  FROM {counts}, (SELECT sum(pos) AS n1, sum(neg) AS n0, count(*) AS V FROM {counts})"""


@query("fusion_classifier_scores", f"""WITH lab AS (SELECT row_id, user_id, label, ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS is_test FROM ({Q.LAB})),
tr AS (SELECT user_id, sum(label) AS pos, sum(1 - label) AS neg FROM lab WHERE NOT is_test GROUP BY user_id),
f AS (SELECT * FROM ({Q.FEAT})), x AS ({_SCALED}),
u AS (SELECT f.*, x_acctbal * x_acctbal AS crs0, x_acctbal * x_orders AS crs1, x_acctbal * x_spend AS crs2, x_orders * x_orders AS crs3,
  x_orders * x_spend AS crs4, x_spend * x_spend AS crs5, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg
  FROM f JOIN x USING (user_id) LEFT JOIN tr USING (user_id)),
bag AS (SELECT user_id, token, count(*) AS cnt FROM (SELECT user_id, unnest({Q.tx_tokens('amount', 'date', 'description')}) AS token FROM ({Q.TXR}) WHERE user_id IS NOT NULL) GROUP BY user_id, token),
ct AS (SELECT token, sum(cnt * pos) AS pos, sum(cnt * neg) AS neg FROM bag JOIN u USING (user_id) WHERE pos + neg > 0 GROUP BY token),
cn AS (SELECT cat_nation AS token, sum(pos) AS pos, sum(neg) AS neg FROM u GROUP BY cat_nation HAVING sum(pos + neg) > 0),
cs AS (SELECT cat_segment AS token, sum(pos) AS pos, sum(neg) AS neg FROM u GROUP BY cat_segment HAVING sum(pos + neg) > 0),
wt AS ({_nb_sql('ct')}), wn AS ({_nb_sql('cn')}), ws AS ({_nb_sql('cs')}),
st AS (SELECT user_id, sum(cnt * w) AS s FROM bag JOIN wt USING (token) GROUP BY user_id),
mo AS (SELECT {_MOMENTS}, ln((sum(pos) + 1)::DOUBLE / (sum(neg) + 1)) AS prior FROM u),
sc AS (SELECT u.user_id, round(prior + coalesce(st.s, 0) + coalesce(wn.w, 0) + coalesce(ws.w, 0) + {' + '.join(_gauss_sql(c) for c in _FUSION_NUM)}, 4) AS logit
  FROM u LEFT JOIN st USING (user_id) LEFT JOIN wn ON wn.token = cat_nation LEFT JOIN ws ON ws.token = cat_segment, mo)
SELECT row_id, user_id, label, is_test, logit FROM lab LEFT JOIN sc USING (user_id)""")
def q_fusion(spark, sf):
    """M6: all tokens of a user, categories, numericals and crossed features;
    a logit for every label row."""
    lab, users, bag = fusion_users(spark, sf)
    scored = ML.fusion_bayes(users, bag, "user_id", T.FEAT_CATEGORICAL, _FUSION_NUM)
    return lab.join(scored, "user_id", "left").select("row_id", "user_id", "label", "is_test", F.round("logit", 4).alias("logit"))


def _acctbal_scorer():
    import numpy as np

    def fn(b):
        return 1.0 / (1.0 + np.exp(-(b["num_acctbal"].astype("float64") / 1000.0 - 4.5)))
    return fn


@query("batch_scoring", f"""SELECT user_id, num_acctbal, round(1.0 / (1.0 + exp(-(num_acctbal / 1000.0 - 4.5))), 9) AS score
FROM ({Q.FEAT})""")
def q_batch_scoring(spark, sf):
    """M8: a scoring function loaded once per task, applied per Arrow batch."""
    f = T.customer_features(spark, sf).select("user_id", "num_acctbal")
    out = ML.score_with(f, _acctbal_scorer)
    return out.select("user_id", "num_acctbal", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------------------
# D1 and O3

@query("distinct_descriptions", f"""SELECT DISTINCT description FROM ({Q.TXR}) WHERE description IS NOT NULL""")
def q_distinct_descriptions(spark, sf):
    """The tokenizer corpus of the binned form."""
    return txr_descriptions(spark, sf).where(F.col("description").isNotNull())


@query("first_batch", f"""WITH b AS (SELECT user_id, ids[1:513] AS h,
    (row_number() OVER (ORDER BY md5('42|0|' || user_id), user_id) - 1) // 16 AS batch_id FROM ({_TXE_IDS}))
SELECT user_id, CAST(len(h) - 1 AS INTEGER) AS x_len, CAST(max(len(h) - 1) OVER () AS INTEGER) AS batch_len
FROM b WHERE batch_id = 0""")
def q_first_batch(spark, sf):
    """O3: shapes of the first padded batch (rows, real length, padded length)."""
    p = txe_padded(spark, sf).where(F.col("batch_id") == 0)
    return p.select("user_id", F.col("batch_len").cast("int").alias("batch_len"),
                    F.size(F.filter("y", lambda v: v != -1)).cast("int").alias("x_len"))


# ---------------------------------------------------------------------------
# B5 for the string pipelines: the tokenizer trained on whole history
# strings (spaced form, vocab 10000) and on tagged sequences (vocab 1000,
# specials <PAD> <SOS> <EOS> <EOT> <UNK>). Tags are not protected while
# training, as in the reference.

def history_corpus(spark, sf):
    return PL.history_strings(T.transactions_from_events(spark, sf))


def tagged_corpus(spark, sf):
    return PL.tagged_sequences(T.split_date_transactions(T.transactions_from_events(spark, sf)))


def history_bpe(spark, sf, corpus):
    return B.train_bpe(spark, B.word_histogram(corpus, "transaction_history"), 10000, V.special_token_list("spaced"))


def tagged_bpe(spark, sf, corpus):
    return B.train_bpe(spark, B.chunked_word_histogram(corpus, "client_id", "sequence"), 1000, V.special_token_list("tagged"))


_HISTORY = Q.chunked(f"""SELECT user_id, list({Q.spaced('origin', 'amount', 'date', 'description')} ORDER BY date, tx_id) AS seq
FROM ({Q.TXE}) WHERE user_id IS NOT NULL GROUP BY user_id""", "user_id", S.DEFAULT_CHUNK_LEN)
_HISTORY_HIST = f"SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(tokens, '{_PLAIN}')) AS w FROM ({_HISTORY})) GROUP BY w"
_TAGGED_SEQ = f"""SELECT client_id, list_concat(['<SOS>'], f0[1:len(f0)-1], ['<EOS>']) AS seq FROM (
  SELECT client_id, flatten(list([{Q.tagged('type', 'amount', 'hour', 'day', 'month', 'day_week', 'merchant')}, '<EOT>']
    ORDER BY date, tx_id)) AS f0 FROM ({_SPLIT_E}) WHERE client_id IS NOT NULL GROUP BY client_id)"""
_TAGGED_HIST = f"SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(array_to_string(seq, ''), '{_PLAIN}')) AS w FROM ({_TAGGED_SEQ})) GROUP BY w"
_SPACED_PATTERN = r"<account>|<card>|<INFLOW>|<OUTFLOW>|<AMOUNT_(?:0-10|10-50|50-100|100-500|500-1000|1000\+)>|<MONTH_(?:1[0-2]|[1-9])>|<DAY_(?:[12][0-9]|3[01]|[1-9])>|<WEEKDAY_[0-6]>|\[(?:PAD|UNK|SEP)\]|" + _PLAIN


@query("bpe_merges_history", f"WITH {_bpe_sql(_HISTORY_HIST, _SPACED_SQL, 10000)} {_MERGES}")
def q_bpe_history(spark, sf):
    """B5 on the spaced history strings (vocab 10000)."""
    return history_bpe(spark, sf, hold(history_corpus(spark, sf))).merges


@query("bpe_merges_tagged", f"WITH {_bpe_sql(_TAGGED_HIST, _TAGGED_SQL, 1000)} {_MERGES}")
def q_bpe_tagged(spark, sf):
    """B5 on the tagged <SOS>...<EOS> sequences (vocab 1000)."""
    return tagged_bpe(spark, sf, hold(tagged_corpus(spark, sf))).merges


@query("bpe_encode_history", f"""WITH {_bpe_sql(_HISTORY_HIST, _SPACED_SQL, 10000)},
e AS ({_encode_sql(_HISTORY, "user_id, chunk", "tokens", _SPACED_PATTERN, _SPACED_SQL)})
SELECT user_id, chunk, {_IDS} AS ids FROM e, fin""")
def q_encode_history(spark, sf):
    """Every chunk of the history strings as ids, specials whole (their
    chunks end at a space, so a chunk's ids are its part of the whole's)."""
    corpus = hold(history_corpus(spark, sf))
    enc = B.encode_texts(corpus, ["user_id", "chunk"], "transaction_history", history_bpe(spark, sf, corpus), V.special_token_list("spaced"))
    return enc.select("user_id", "chunk", F.array_join("ids", ",").alias("ids"))


@query("bpe_encode_tagged", f"""WITH {_bpe_sql(_TAGGED_HIST, _TAGGED_SQL, 1000)},
e AS ({_encode_sql(Q.chunked(_TAGGED_SEQ, "client_id", S.DEFAULT_CHUNK_LEN, "''"), "client_id, chunk", "tokens", "<PAD>|<SOS>|<EOS>|<EOT>|<UNK>|" + _PLAIN, _TAGGED_SQL)})
SELECT client_id, chunk, {_IDS} AS ids FROM e, fin""")
def q_encode_tagged(spark, sf):
    """The tagged sequences as ids, specials whole, <UNK> for each unknown
    character (a chunk ends at a special or begins with one)."""
    corpus = hold(tagged_corpus(spark, sf))
    enc = B.encode_texts(corpus, ["client_id", "chunk"], "sequence", tagged_bpe(spark, sf, corpus), V.special_token_list("tagged"), unk="<UNK>")
    return enc.select("client_id", "chunk", F.array_join("ids", ",").alias("ids"))


_TXE_HIST = f"SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({Q.words('description')}) AS w FROM (SELECT DISTINCT description FROM ({Q.TXE}))) GROUP BY w"


@query("user_bpe_sequences", f"""WITH {_bpe_sql(_TXE_HIST, _SPECIALS_SQL, 10000)},
e AS ({_encode_sql(f"SELECT DISTINCT description FROM ({Q.TXE})", "description", "description", _PLAIN, "[]::VARCHAR[]")}),
f AS (SELECT user_id, flatten(list(list_concat([{Q.sign('amount')}, {Q.bin_token('amount')}, {Q.month_tok('date')}, {Q.day_tok('date')}, {Q.weekday_tok('date')}],
    coalesce(pieces, []), ['[SEP]']) ORDER BY date, tx_id)) AS f0 FROM ({Q.TXE}) x LEFT JOIN e USING (description) WHERE user_id IS NOT NULL GROUP BY user_id),
u AS (SELECT user_id, list_transform(f0[1:len(f0) - 1], lambda x: list_position(vocab, x) - 1) AS seq FROM f, fin)
SELECT user_id, CAST(g.k AS INTEGER) AS chunk, CAST(g.k * {S.DEFAULT_CHUNK_LEN} AS BIGINT) AS "offset", CAST(len(seq) AS BIGINT) AS seq_len,
  array_to_string(seq[g.k * {S.DEFAULT_CHUNK_LEN} + 1 : (g.k + 1) * {S.DEFAULT_CHUNK_LEN}], ',') AS ids
FROM u, unnest(generate_series(0, (len(seq) - 1) // {S.DEFAULT_CHUNK_LEN})) AS g(k)""")
def q_user_bpe(spark, sf):
    """A1 + B6, the pretraining input: each user's id sequence (attribute ids,
    description pieces, [SEP] between transactions), in chunks."""
    tx = T.transactions_from_events(spark, sf)
    cfg = PL.PretrainConfig()
    model = PL.train_description_tokenizer(spark, tx, cfg)
    seqs = PL.id_sequences(tx, model, cfg)
    return seqs.select("user_id", "chunk", "offset", "seq_len", F.array_join("tokens", ",").alias("ids"))


@query("finetune_batches", f"""WITH b AS (SELECT row_id, CAST((row_number() OVER (ORDER BY md5('42|0|' || row_id), row_id) - 1) // 32 AS BIGINT) AS batch_id FROM ({Q.LAB})),
r AS (SELECT l.row_id, l.user_id, l.label, CASE WHEN s.h IS NULL OR len(s.h) = 0 THEN ['[PAD]'] ELSE s.h END AS h
  FROM ({Q.LAB}) l LEFT JOIN (SELECT user_id, seq[1:512] AS h FROM ({_TXE_SEQ})) s USING (user_id)),
m AS (SELECT r.*, batch_id, max(len(h)) OVER (PARTITION BY batch_id) AS batch_len FROM r JOIN b USING (row_id))
SELECT row_id, user_id, label, batch_id, CAST(batch_len AS INTEGER) AS batch_len, CAST(len(h) AS INTEGER) AS n_real,
  md5(array_to_string(list_concat(h, list_transform(range(batch_len - len(h)), lambda i: '[PAD]')), ' ')) AS tokens_md5 FROM m""")
def q_finetune_batches(spark, sf):
    """W6 for fine-tuning: padded sequences with their label, by seeded batch."""
    win = S.head_tokens(txe_sequences(spark, sf), "user_id", 512, S.DEFAULT_CHUNK_LEN)
    rows = FT.label_sequences(T.label_rows(spark, sf), win).withColumn("n_real", F.size("tokens"))
    p = PL.finetune_batches(rows)
    return p.select("row_id", "user_id", "label", "batch_id", "batch_len", "n_real", F.md5(joined("tokens")).alias("tokens_md5"))


# ---------------------------------------------------------------------------
# Sinks and sources: written to the shared folder, read back, compared in full

import uuid  # noqa: E402

from ledgerloom.sources import io as IO  # noqa: E402
from ledgerloom.session import kept_folder  # noqa: E402


@query("csv_round_trip", f"SELECT * FROM ({_FT_TABLE})")
def q_csv_round_trip(spark, sf):
    """S3 + S7: the fine-tune table as CSV, read with its declared schema."""
    table = finetune_table(spark, sf)
    path = kept_folder(spark, "finetune")
    IO.write_table(table, path, "csv")
    return IO.read_finetune_table(spark, path, table.schema)


@query("history_csv_split", "SELECT CAST(doc_id AS VARCHAR) AS user_id, text AS transaction_history FROM documents WHERE text <> ''")
def q_history_csv_split(spark, sf):
    """Texts with line breaks in quotes as CSV, files read by several tasks."""
    rows = T.table(spark, sf, "documents").where(F.col("text") != "").select(F.col("doc_id").cast("string").alias("user_id"), F.col("text").alias("transaction_history"))
    path = kept_folder(spark, "histories")
    IO.write_table(rows, path, "csv")
    return IO.read_csv_split(spark, path, IO.HISTORY_SCHEMA)


@query("stored_sequence_join", ORACLE["label_sequence"])
def q_stored_sequence_join(spark, sf):
    """S5 + S6 + J2: windows stored in buckets by user; the labels are dealt to
    the buckets and the stored side is read where it lies."""
    win = S.head_tokens(txe_sequences(spark, sf), "user_id", 512, S.DEFAULT_CHUNK_LEN)
    name, path = f"ledgerloom_sequences_{uuid.uuid4().hex}", kept_folder(spark, "sequences")
    IO.write_bucketed(win.select("user_id", "tokens"), name, path, "user_id", 16)
    j = IO.join_bucketed(T.label_rows(spark, sf), spark, name, "user_id")
    return j.select("row_id", "user_id", "label", F.coalesce(F.when(F.size("tokens") > 0, joined("tokens")), F.lit("[PAD]")).alias("tokens"))


@query("stored_model_probs", ORACLE["next_token_probs"])
def q_stored_model_probs(spark, sf):
    """The next-token model saved and loaded."""
    _, m = txe_ngram(spark, sf)
    path = kept_folder(spark, "model")
    NG.save_model(m, path)
    return NG.load_model(spark, path)["p2"].select("c2", "c1", "token", F.round("p2", 9).alias("p"))


@query("stored_config_batches", f"""SELECT user_id, md5('42|1|' || user_id) AS shuffle_key, 16 AS batch_size FROM ({_USERS})""")
def q_stored_config(spark, sf):
    """A run config saved and loaded, its seed and batch size used."""
    path = kept_folder(spark, "config")
    IO.save_config(spark, PL.PretrainConfig(), path)
    cfg = IO.load_config(spark, PL.PretrainConfig, path)
    users = T.label_rows(spark, sf).select("user_id").distinct()
    return users.select("user_id", SP.hash_order(cfg.seed, "user_id", 1).alias("shuffle_key"), F.lit(cfg.batch_size).alias("batch_size"))


@query("sequences_of_known_users", f"""SELECT user_id, count(*) AS n_events FROM (
  SELECT CASE WHEN substr(md5(CAST(tx_id AS VARCHAR)), 1, 1) <> '0' THEN user_id END AS user_id FROM ({Q.TXE})) WHERE user_id IS NOT NULL GROUP BY user_id""")
def q_known_users(spark, sf):
    """D3: a sixteenth of the events has no user; those are in no sequence."""
    tx = T.transactions_from_events(spark, sf)
    lost = F.substring(F.md5(F.col("tx_id").cast("string")), 1, 1) == "0"
    ev = tx.select(F.when(~lost, F.col("user_id")).alias("user_id"), "date", "tx_id", F.array(F.lit("x")).alias("toks"))
    seqs = S.assemble_sequences(ev, "user_id", ["date", "tx_id"], "toks")
    return seqs.where(F.col("chunk") == 0).select("user_id", F.col("seq_len").alias("n_events"))


# ---------------------------------------------------------------------------
# Learned token vectors (M4)

from ledgerloom.operators import vectors as VC  # noqa: E402

_COOC = f"""t AS (SELECT user_id, unnest(seq) AS tok, generate_subscripts(seq, 1) AS pos FROM ({_TXR_SEQ})),
co AS (SELECT a.tok AS "left", b.tok AS "right", count(*) AS cnt FROM t a JOIN t b ON a.user_id = b.user_id AND b.pos - a.pos IN (1, 2) GROUP BY a.tok, b.tok),
sy AS (SELECT a, b, sum(cnt) AS cnt FROM (SELECT "left" AS a, "right" AS b, cnt FROM co UNION ALL SELECT "right", "left", cnt FROM co) GROUP BY a, b),
m AS (SELECT a, sum(cnt) AS m FROM sy GROUP BY a)"""


def _txr_chunks(spark, sf):
    return S.assemble_sequences(_txr_token_events(spark, sf), "user_id", T.TXR_ORDER, "toks", sep=E.SEP, chunk_len=64)


@query("token_cooccurrences", f'WITH {_COOC} SELECT "left", "right", CAST(cnt AS BIGINT) AS cnt FROM co')
def q_cooccurrences(spark, sf):
    return VC.cooccurrences(_txr_chunks(spark, sf), "user_id", 2)


@query("token_ppmi", f"""WITH {_COOC}, v AS (SELECT sy.a, sy.b, ln(sy.cnt::DOUBLE * (SELECT sum(cnt) FROM sy) / (x.m::DOUBLE * y.m)) AS value
FROM sy JOIN m x ON x.a = sy.a JOIN m y ON y.a = sy.b) SELECT a, b, round(value, 9) AS value FROM v WHERE value > 0""")
def q_ppmi(spark, sf):
    return VC.ppmi(VC.cooccurrences(_txr_chunks(spark, sf), "user_id", 2)).select("a", "b", F.round("value", 9).alias("value"))


def txr_token_vectors(spark, sf, seqs):
    return VC.token_vectors(VC.ppmi(VC.cooccurrences(seqs, "user_id", 2)), rank=16)


@query("token_vectors")
def q_token_vectors(spark, sf):
    """M4: a vector for each token, learned from the sequences (tests hold it
    against a dense factorisation)."""
    return txr_token_vectors(spark, sf, _txr_chunks(spark, sf))


@query("user_token_vectors")
def q_user_token_vectors(spark, sf):
    """M4: users as the mean of their tokens' learned vectors."""
    seqs = _txr_chunks(spark, sf)
    return VC.pooled(seqs, "user_id", txr_token_vectors(spark, sf, seqs))
