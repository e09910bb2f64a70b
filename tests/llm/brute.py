"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def near(rows, q, percent=80):
    """[(doc_id, set size, component id)] by row."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k:k + q]) for k in range(max(len(w) - q + 1, 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        f = find(i)
        if d is not None:
            least[f] = min(least.get(f, d), d)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def word_passages(rows, width=50):
    last = 1 << 63
    texts = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for o, _, w in texts:
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            least[g] = min(least.get(g, o), o)
    out = []
    for o, i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < o:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def byte_passages(rows, width=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + width] for _, b in texts for k in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def benchmark(rows, items, width=13):
    windows = {}
    for item, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    named |= got
        out.append((d, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rules(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))


ALNUM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _while(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def base_secrets(text):
    """(n_assign, n_access, n_hex, digest of the base spans), read character by character."""
    text = text or ""
    low = text.translate(LOW)
    spans = []
    at = 0
    while at < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, at):
                continue
            p = at + len(word)
            p += text[p:p + 1] in ('"', "'") and p < len(text)
            p = _while(text, p, " ")
            if text[p:p + 1] not in (":", "="):
                continue
            p = _while(text, p + 1, " ")
            p += text[p:p + 1] in ('"', "'") and p < len(text)
            end = _while(text, p, ALNUM | set("+/_.=-"))
            if end > p:
                if end - p >= 6:
                    spans.append((at, 0, end, "assign"))
                break
            end = None
        at = end or at + 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = _while(text, at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end == at + 4:
            at += 1
            continue
        if end - at >= 20:
            spans.append((at, 1, end, "access"))
        at = end
    at = 0
    while at < len(text):
        end = _while(text, at, set("0123456789abcdef"))
        if end - at >= 24:
            spans.append((at, 2, end, "hex"))
        at = max(end, at + 1)
    line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
    return (*[sum(s[1] == k for s in spans) for k in range(3)], sha(line))
