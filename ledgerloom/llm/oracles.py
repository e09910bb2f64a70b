"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"


def _words(text: str, separators: str = WHITE) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda w: w <> '')"


_LOWER = f"translate(coalesce(text, ''), '{UP}', '{LOW}')"

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM d, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

PASSAGES = f"""WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
wn AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(generate_series(1, len(w) - 49)) AS g(i)),
mn AS (SELECT k, min(doc_id) AS m FROM wn GROUP BY k),
rm AS (SELECT DISTINCT doc_id, i + j AS p FROM wn JOIN mn USING (k), unnest(range(50)) AS q(j) WHERE m < doc_id),
ws AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kp AS (SELECT ws.doc_id, count(rm.p) AS n_removed, string_agg(word, ' ' ORDER BY ws.p) FILTER (WHERE rm.p IS NULL) AS kept
  FROM ws LEFT JOIN rm ON rm.doc_id = ws.doc_id AND rm.p = ws.p GROUP BY ws.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kp USING (doc_id)"""

_ITEM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCHMARK = f"""WITH d AS (SELECT doc_id, {_words(_LOWER, _ITEM)} AS w FROM documents),
b AS (SELECT item_id, {_words(_LOWER, _ITEM)} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS k, least(len(w), 13) AS n
  FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS g(i) WHERE len(w) > 0),
hits AS (SELECT doc_id, i, n, item_id FROM (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM iw) s, unnest(generate_series(1, len(w) - n + 1)) AS g(i)) JOIN iw USING (k, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(generate_series(i, i + n - 1)) AS q(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

# The common words and limits, as the operator documents them.
_LISTS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it as was with be by on not he this are",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
_LIST = "CASE lang " + " ".join(f"WHEN '{k}' THEN string_split('{v}', ' ')" for k, v in _LISTS.items()) + " ELSE [] END"


def _class(runs: str) -> str:
    return f"length(x) - length(regexp_replace(x, '{runs}', '', 'g'))"


_FIVE = [_class(c) for c in ("[a-z]+", "[A-Z]+", "[0-9]+", WHITE, r"[^\x00-\x7F]+")]


def _distance(p: str, q: str) -> str:
    part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    pi, qi = f"({p}[i]::DOUBLE / list_sum({p}))", f"({q}[i]::DOUBLE / list_sum({q}))"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part.format(a=pi, b=qi)} + {part.format(a=qi, b=pi)}) / 2)), 0))"


def _reference(column: str) -> str:
    return f"""SELECT lang, list(s ORDER BY i) AS {column} FROM (SELECT lang, i, sum(v) AS s FROM (
  SELECT lang, unnest({column}) AS v, generate_subscripts({column}, 1) AS i FROM m WHERE NOT base_failed) GROUP BY lang, i) GROUP BY lang"""


RULES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS lang, {_words("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
wn AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM t, unnest(generate_series(1, len(w) - 7)) AS g(i)),
rp AS (SELECT doc_id, i FROM wn QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rp, unnest(range(8)) AS q(j) GROUP BY doc_id),
b AS (SELECT doc_id, x, lang, w, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(x, '{WHITE}', '', 'g')) AS word_chars,
  {_class('[#*$%&|<>]+')} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, {_LIST} AS lst
  FROM t LEFT JOIN rw USING (doc_id)),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [{', '.join(_FIVE)}] AS five,
  list_transform(lst, lambda k: len(list_filter(w, lambda v: v = k))) AS inl FROM b),
m AS (SELECT * EXCLUDE (five, inl), list_append(five, length(x) - list_sum(five)) AS chars, list_append(inl, n_words - coalesce(list_sum(inl), 0)) AS common FROM c),
rc AS ({_reference('chars')}), ro AS ({_reference('common')}),
rn AS (SELECT lang, sum(n_words) AS n FROM m WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= 2000),
j AS (SELECT m.*, CASE WHEN n_words >= 50 AND rn.n IS NOT NULL THEN {_distance('m.chars', 'rc.chars')} ELSE 0 END AS dc,
  CASE WHEN n_words >= 50 AND rn.n IS NOT NULL AND len(lst) > 0 THEN {_distance('m.common', 'ro.common')} ELSE 0 END AS dw
  FROM m LEFT JOIN rc USING (lang) LEFT JOIN ro USING (lang) LEFT JOIN rn USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dc <= 0.28 AND dw <= 0.2 + 1.05 / sqrt(n_words) AS kept FROM j"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         (('0x' || substr(x || '00', CAST(i * 5 // 4 AS INT) + 1, 3))::INT >> (12 - 5 - (i * 5) % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM s"""


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


def _hash_part(key: str, k: int) -> str:
    """The k-th group of 8 hex digits of a key's sha256, as a number."""
    return f"CAST(('0x' || substr(sha256({key}), {8 * k + 1}, 8)) AS BIGINT)"


# CRC-32 byte by byte, of each different feature once.
IMPORTANCE = f"""WITH d AS (SELECT doc_id, {_words(_LOWER, _ITEM)} AS w FROM documents),
b AS (SELECT {_words(_LOWER, _ITEM)} AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
df AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS f FROM d, k, unnest(generate_series(1, len(w) - k + 1)) AS g(i)),
bf AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM b, k, unnest(generate_series(1, len(w) - k + 1)) AS g(i)),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
t AS MATERIALIZED (SELECT {_crc_table()}::BIGINT[] AS tab),
c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
  lambda a, e: xor(a >> 8, tab[xor(a & 255, e) + 1]))) % 10000 AS bucket FROM x, t),
s AS (SELECT bucket, count(*) AS s FROM df JOIN c USING (f) GROUP BY bucket),
tt AS (SELECT bucket, count(*) AS t FROM bf JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM tt)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN tt USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN c USING (f) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_hash_part("'42:' || doc_id", 0)}::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS drawn FROM z WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM z LEFT JOIN r USING (doc_id)"""

_FIM = ", ".join(f"""{_hash_part("'1:' || doc_id", k)} AS h{k + 1}""" for k in range(4))
MIDDLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, {_FIM} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM p"""

ORACLE = {"op1_near_dedup": NEAR, "op2_substring_dedup": PASSAGES, "op5_warc": WARC, "op7_quality_rules": RULES, "op8_decontaminate": BENCHMARK,
          "op11_importance_resample": IMPORTANCE, "op13_fill_middle": MIDDLE}
