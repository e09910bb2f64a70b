"""Fill-in-the-middle transformation.

A text is cut into units by one ``fullmatch`` of ``(unit)*`` with the regex
library, which keeps every repetition of the group: ``match.ends(1)`` is the
list of all units' ends, so its length is the number of units and both cuts
are looked up in it. A text longer than ``BLOCK`` code points is matched in
possessive runs of at most ``RUN`` units each, one after another, which gives the
same units; only the numbers of units of the runs are kept, and the runs that
hold a cut are matched once more, so memory is bounded by ``RUN``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
BLOCK = RUN = 1 << 18

OUT = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"
DIGEST = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class Units:
    """Cuts texts into units matched from left to right."""

    def __init__(self, unit: str = CODE_POINT):
        import regex

        self.whole = regex.compile(f"((?>{unit}))*")
        self.run = regex.compile(f"((?>{unit})){{1,{RUN}}}+")

    def __call__(self, text: str) -> Cuts:
        if len(text) <= BLOCK:
            match = self.whole.fullmatch(text)
            if match is None:
                raise ValueError("the text is not made of units")
            return Cuts(self, text, match.ends(1), [])
        at, runs = 0, [(0, 0)]
        while at < len(text):
            match = self.run.match(text, at)
            if match is None:
                raise ValueError("the text is not made of units")
            at = match.end()
            runs.append((runs[-1][0] + len(match.ends(1)), at))
        return Cuts(self, text, [], runs)


class Cuts:
    """The number ``n`` of units of a text and the offset after its first ``k``."""

    def __init__(self, units: Units, text: str, ends: list[int], runs: list[tuple[int, int]]):
        self.units, self.text, self.ends, self.runs = units, text, ends, runs
        self.n = runs[-1][0] if runs else len(ends)

    def offset(self, k: int) -> int:
        if k == 0:
            return 0
        if not self.runs:
            return self.ends[k - 1]
        before, at = next(run for run in reversed(self.runs) if run[0] < k)
        return self.units.run.match(self.text, at).ends(1)[k - 1 - before]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from sha256(``seed:id``); a null id is the empty string."""
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexes[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(units: Units, text: str, doc_id: int | None, *, seed: int = 1, rate: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix size, middle size, output) of one text; sizes in code points."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    cuts = units(text)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return cuts.n, "plain", None, None, text
    lo, hi = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
    a, b = cuts.offset(lo), cuts.offset(hi)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return cuts.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return cuts.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text an output was made from: its pieces hold no mark, so the first
    mark of each kind ends the piece before it."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first):].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, *, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = CODE_POINT, digest: bool = False) -> DataFrame:
    """Rearrange every whole ``text`` of ``docs`` for fill-in-the-middle training:
    ``rate`` per cent of the documents, ``spm`` per cent of these with the
    suffix first; draws come from the id alone.

    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points, null if plain), output and restored (the text
    rebuilt from output and form), or the SHA-256 of these two with ``digest``.
    One row per input row: repeated rows give equal rows, null and empty texts
    are plain and empty, a null id draws from the empty string, texts with a
    mark in them stay plain; other columns are ignored. Narrow: no shuffle.
    """
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("doc_id"))
    names = ["n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digest else ["output", "restored"])]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                made = []
                for text, doc_id in zip(part.column(0), part.column(1)):
                    n, form, a, b, output = transform(units, text.as_py() or "", doc_id.as_py(), seed=seed, rate=rate, spm=spm)
                    back = restore(output, form)
                    made.append((n, form, a, b, *((sha(output), sha(back)) if digest else (output, back))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(list(c), k) for c, k in zip(zip(*made), kinds))], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id long, {DIGEST if digest else OUT}")
