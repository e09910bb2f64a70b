"""Secret scan: fixed patterns, and strings that a tokenizer cannot shorten.

A vocabulary learned from natural text packs about four characters of a word
into one token, but hardly two of a random string. Runs of secret-like
characters whose characters per token fall below a limit are reported as
kind ``random``; of other runs, each stretch that does (the words of a path
or a name do not hide the key behind them). Known digests or identifiers
(content hashes of usual lengths in hex, UUIDs, strings behind a digest label
that have that digest's own length in hex or base64) and what a pattern has
reported already are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
LEAST_RUN = 20
SEPARATORS = "/_=.-"
PART = re.compile(r"[A-Za-z0-9+]+")  # between separators
LEAST_PART = 0.8   # characters of a stretch that are no separators
MOST_DROP = 6.0    # a stretch ends before tokens that are so many characters above the limit together
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}
DIGEST_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = tuple(2 * n for n in DIGEST_BYTES.values())  # in hex
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST_LABEL = re.compile(r"(md5|sha-?(?:1|224|256|384|512))[:=-]?$", re.I | re.A)


def written(n: int) -> str:
    """A pattern of a digest of ``n`` bytes: hex in one case, or base64 of
    either alphabet, padded or not."""
    pad = -n % 3
    return rf"(?:[0-9a-f]{{{2 * n}}}|[0-9A-F]{{{2 * n}}}|[A-Za-z0-9+/_-]{{{-(-8 * n // 6)}}}(?:{'=' * pad})?)(?![A-Za-z0-9+/_=-])"


WRITTEN = {label: re.compile(written(n)) for label, n in DIGEST_BYTES.items()}
SELF_LABELLED = re.compile("|".join(rf"{'sha-?' + label[3:] if label != 'md5' else label}[:=-]{written(n)}" for label, n in DIGEST_BYTES.items()), re.I | re.A)
INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}(?![A-Za-z0-9])|(?i:{SELF_LABELLED.pattern}))", re.A)

OUT = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def vocabulary(path: str) -> bytes:
    """A tiktoken rank file (base64 token and rank per line, below 1 MB); it
    travels inside the task closure."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(ranks_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost without overlap per kind."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if max(map(len, text.split()), default=0) >= LEAST["hex"]:  # a run holds no white space
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def known_identifier(text: str, start: int, end: int) -> bool:
    """Is this string a digest or an identifier rather than a secret?"""
    s = text[start:end]
    label = DIGEST_LABEL.search(text[max(0, start - 8):start])
    return bool(len(s) in DIGEST_LENGTHS and DIGEST_HEX.fullmatch(s) or UUID.fullmatch(s) or SELF_LABELLED.fullmatch(s)
                or label and WRITTEN[label[1].lower().replace("-", "")].fullmatch(s))


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a range without the taken ones (in order of start)."""
    for a, b in taken:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def identifiers(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Digests and identifiers inside a run."""
    found = [m.span() for m in INSIDE.finditer(text, start, end)]
    return sorted(found + [m.span() for m in PART.finditer(text, start, end) if len(m[0]) >= LEAST_RUN and known_identifier(text, *m.span())])


def stretches(text: str, start: int, end: int, encoding, most_chars_per_token: float) -> list[tuple[int, int]]:
    """The stretches of a run that hold few characters per token, separators
    not counted, widened to whole parts where these do."""
    tokens, parts = [], []  # (start, end, part), (start, end, characters over the limit)
    for m in PART.finditer(text, start, end):
        at = m.start()
        ids = encoding.encode_ordinary(m[0])
        for i in ids:
            n = len(encoding.decode_single_token_bytes(i))
            tokens.append((at, at + n, len(parts)))
            at += n
        parts.append((*m.span(), len(m[0]) - most_chars_per_token * len(ids)))
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(tokens):
        total, best, last, k = 0.0, 0.0, -1, i
        while k < len(tokens) and total >= 0 and total > best - MOST_DROP:
            total += most_chars_per_token - (tokens[k][1] - tokens[k][0])
            if total > best:
                best, last = total, k
            k += 1
        if last < 0:
            i += 1
            continue
        (a, _, first), (_, b, final) = tokens[i], tokens[last]
        a = parts[first][0] if parts[first][2] <= 0 else a
        b = parts[final][1] if parts[final][2] <= 0 else b
        own = sum(min(b, q) - max(a, p) for p, q, _ in parts[first:final + 1])
        if b - a >= LEAST_RUN and own >= LEAST_PART * (b - a):
            b = b if text[b:end].strip("=") else end
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        i = last + 1
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], encoding, most_chars_per_token: float) -> list[tuple[int, int, str]]:
    if max(map(len, text.split()), default=0) < LEAST_RUN:
        return []
    out = []
    taken = [(a, b) for a, b, _ in base]
    for m in RUN.finditer(text):
        run = m.start(), m.start() + len(m[0].rstrip("."))
        if known_identifier(text, *run):
            continue
        for start, end in outside(*run, taken):
            start += start > run[0] and text[start] in SEPARATORS
            end -= end < run[1] and text[end - 1] in SEPARATORS
            if end - start < LEAST_RUN or not PART.search(text, start, end) or known_identifier(text, start, end):
                continue
            if (end - start) / len(encoding.encode_ordinary(text[start:end])) <= most_chars_per_token:
                out.append((start, end, "random"))
                continue
            for a, b in outside(start, end, identifiers(text, start, end)):
                out += [(p, q, "random") for p, q in stretches(text, a, b, encoding, most_chars_per_token)]
    return out


def find(text: str, encoding, most_chars_per_token: float) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, encoding, most_chars_per_token), key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with the union of the spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        if start > at or not out:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def _line(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, ranks: bytes, pattern: str, *, most_chars_per_token: float = 2.3, digest: bool = False) -> DataFrame:
    """Secrets in every whole ``text``: doc_id and the spans (kind, start, end
    in code points, end exclusive) by start and kind.

    One row per input row, whatever its id; null and empty texts have no
    spans; repeated rows are judged alike; other columns are ignored.
    ``ranks`` is a tiktoken rank file, ``pattern`` its split pattern. Narrow:
    no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            found = [find(t.as_py() or "", encoding, most_chars_per_token) for t in batch.column(1)]
            ids = batch.column(0).cast(pa.int64())
            if not digest:
                cols = [ids, pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in found],
                                      pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "spans"])
                continue
            count = [[sum(k == kind for *_, k in s) for s in found] for kind in KINDS[:3]]
            sha = [hashlib.sha256(_line(x for x in s if x[2] != "random").encode()).hexdigest() for s in found]
            cols = [ids, *(pa.array(c, pa.int64()) for c in count), pa.array(sha, pa.string()), pa.array([_line(s) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, DIGEST if digest else OUT)


def redact(docs: DataFrame, ranks: bytes, pattern: str, *, most_chars_per_token: float = 2.3, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark`` and, where
    there is such a column, ``n_chars`` counted anew for changed texts. All
    rows and columns stay."""
    cols = docs.columns
    at = cols.index("text")
    n = cols.index("n_chars") if "n_chars" in cols else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t and redacted(t, find(t, encoding, most_chars_per_token), mark) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.column(at).type)
            if n is not None:
                arrays[n] = pa.array([c if a == b else len(b) for a, b, c in zip(texts, new, batch.column(n).to_pylist())], batch.column(n).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
