"""DuckDB SQL fragments for the oracle side of the driver check.

These mirror, in plain SQL, what the Spark operators compute, so the driver
can run both over the same parquet tables.
"""

from __future__ import annotations

TXE = """SELECT user_id, event_id AS tx_id, ts AS date,
  CASE WHEN event_type IN ('purchase','error') THEN -value ELSE value END AS amount,
  CASE WHEN event_type IN ('purchase','click') THEN 'card' ELSE 'account' END AS origin,
  concat(event_type, '.com') AS description
FROM events"""

TXR = """SELECT o.o_custkey AS user_id, l.l_shipdate AS date,
  CASE WHEN l.l_returnflag='R' THEN l.l_extendedprice ELSE -l.l_extendedprice END / 100 AS amount,
  CASE WHEN l.l_linestatus='F' THEN 'card' ELSE 'account' END AS origin,
  p.p_name AS description,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey"""

TXR_ORDER = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

LAB = """SELECT o_orderkey AS row_id, o_custkey AS user_id,
  CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS label
FROM orders"""

FEAT = """SELECT c.c_custkey AS user_id, c.c_acctbal AS num_acctbal, count(o.o_orderkey) AS num_orders,
  round(coalesce(sum(o.o_totalprice),0),2) AS num_spend, c.c_nationkey AS cat_nation,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
    WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS cat_segment
FROM customer c LEFT JOIN orders o ON o.o_custkey=c.c_custkey
GROUP BY c.c_custkey, c.c_acctbal, c.c_nationkey, c.c_mktsegment"""

WORDS_RE = r"'\w+|[^\w\s]+'"

# The reference's 21 edges, written out here so that the oracle does not lean on the engine's constant.
_EDGES = "[0.0, 1.0, 5.0, 10.0, 20.0, 30.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0, 750.0, 1000.0, 1500.0, 2000.0, 3000.0, 5000.0, 10000.0, 'inf'::DOUBLE]"


def sign(a: str) -> str:
    return f"(CASE WHEN {a} >= 0 AND NOT isnan({a}) THEN '<INFLOW>' ELSE '<OUTFLOW>' END)"


def bin_index(a: str) -> str:
    return (f"(CASE WHEN {a} IS NULL THEN NULL WHEN isnan({a}) THEN 21 "
            f"ELSE CAST(len(list_filter({_EDGES}, lambda e: abs({a}) >= e)) AS INTEGER) END)")


def bin_token(a: str) -> str:
    return (f"(CASE WHEN {a} IS NULL OR isnan({a}) THEN '[UNK]' "
            f"ELSE '<AMOUNT_' || least({bin_index(a)}, 20) || '>' END)")


def range6(a: str) -> str:
    return (f"(CASE WHEN abs({a}) <= 10 THEN '0-10' WHEN abs({a}) <= 50 THEN '10-50' "
            f"WHEN abs({a}) <= 100 THEN '50-100' WHEN abs({a}) <= 500 THEN '100-500' "
            f"WHEN abs({a}) <= 1000 THEN '500-1000' ELSE '1000+' END)")


def range3(a: str) -> str:
    return f"(CASE WHEN {a} < 100 THEN '0-100' WHEN {a} < 500 THEN '100-500' ELSE '500+' END)"


def month_tok(d: str) -> str:
    return f"coalesce('<MONTH_' || month({d}) || '>', '[UNK]')"


def day_tok(d: str) -> str:
    return f"coalesce('<DAY_' || dayofmonth({d}) || '>', '[UNK]')"


def weekday_tok(d: str) -> str:
    return f"coalesce('<WEEKDAY_' || (isodow({d}) - 1) || '>', '[UNK]')"


def weekday_name(d: str) -> str:
    return ("(['monday','tuesday','wednesday','thursday','friday','saturday','sunday']"
            f"[isodow({d})])")


def words(s: str) -> str:
    return f"regexp_extract_all(coalesce({s}, ''), {WORDS_RE})"


def tx_tokens(a: str, d: str, s: str) -> str:
    return (f"list_concat([{sign(a)}, {bin_token(a)}, {month_tok(d)}, {day_tok(d)}, {weekday_tok(d)}], "
            f"{words(s)})")


def spaced(origin: str, a: str, d: str, s: str) -> str:
    return (f"concat_ws(' ', '<' || coalesce({origin}, '') || '>', {sign(a)}, '<AMOUNT_' || {range6(a)} || '>', "
            f"{month_tok(d)}, {day_tok(d)}, {weekday_tok(d)}, coalesce({s}, ''), '[SEP]')")


def tagged(type_: str, a: str, hour: str, day: str, month: str, dw: str, merchant: str) -> str:
    return (f"('<' || {type_} || '><amount:' || {range3(a)} || '><hour:' || {hour} || '><day:' || {day} "
            f"|| '><month:' || {month} || '><day_week:' || {dw} || '>' || {merchant})")


def split_date(tx: str) -> str:
    """Split-date form of a signed transaction view."""
    return f"""SELECT user_id AS client_id, tx_id, date, abs(amount) AS amount, hour(date) AS hour,
  dayofmonth(date) AS day, month(date) AS month, {weekday_name('date')} AS day_week,
  lower(description) AS merchant, CASE WHEN amount >= 0 THEN 'in' ELSE 'out' END AS type
FROM ({tx})"""


def chunked(full_cte: str, key: str, chunk_len: int, joiner: str = "' '") -> str:
    """Cut each ``full`` list of CTE ``u(key, full)`` into chunk rows."""
    L = chunk_len
    return f"""WITH u AS ({full_cte})
SELECT {key}, CAST(g.k AS INTEGER) AS chunk, CAST(g.k * {L} AS BIGINT) AS "offset",
  CAST(len(seq) AS BIGINT) AS seq_len,
  array_to_string(seq[g.k * {L} + 1 : (g.k + 1) * {L}], {joiner}) AS tokens
FROM u, unnest(generate_series(0, (len(seq) - 1) // {L})) AS g(k)"""
