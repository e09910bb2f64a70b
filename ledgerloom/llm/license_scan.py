"""License scan by conditional compression.

A text compresses far better when the compressor already knows its wording.
Around every cue word a candidate block is compressed by zstandard alone and
with each license template as raw dictionary; templates are ranked by the
bytes they save. Every one that saves enough is then compared word by word:
it is confirmed if few words are missing, added or changed, and none of those
that tell licenses apart (names and versions); the rank only decides between
equals. Relatives that open with the same words are told apart by the clauses
that follow: a sentence that several licenses share names their family
(``BSD``) until a clause tells which license it is.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# License wordings (fixed values): short notices and standard header paragraphs.
GNU = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
       "the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
GNU_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation{}.")
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0-or-later": (GNU.format("program", ":", "Affero ", ",", "3"),),
    "All-Rights-Reserved": ("All rights reserved.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-2.0-only": (
        GNU_ONLY.format("; version 2 of the License"),
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by "
        "the Free Software Foundation.",),
    "GPL-2.0-or-later": (GNU.format("program", ";", "", ";", "2"),),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0-only": (
        GNU_ONLY.format(", version 3"),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by "
        "the Free Software Foundation.",),
    "GPL-3.0-or-later": (GNU.format("program", ":", "", ",", "3"),),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.0-or-later": (GNU.format("library", ";", "Library ", ";", "2"),),
    "LGPL-2.1-or-later": (GNU.format("library", ";", "Lesser ", ";", "2.1"),),
    "LGPL-3.0-or-later": (GNU.format("program", ":", "Lesser ", ",", "3"),),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# Clauses behind a wording that tell its relatives apart (fixed values): the clause, the license where it stands within so many
# words (the first listed first), None where the wording is no notice of its own then. Short notices have none.
CLAUSES: dict[str, tuple[tuple[str, str | None, int], ...]] = {
    "BSD": (
        ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "BSD-4-Clause", 400),
        ("may be used to endorse or promote products derived from this software without specific prior written permission", "BSD-3-Clause", 400),
        ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", "BSD-2-Clause", 400),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "BSD-1-Clause", 400),),
    "GPL-2.0-only": (("any later version", None, 15),),
    "GPL-3.0-only": (("any later version", None, 15),),
    "MIT": (("The Software shall be used for Good, not Evil", "JSON", 150),),
    "MIT-0": (("subject to the following conditions", None, 8),),
}
# what a tag may name: the licenses above but for a family and a reservation of rights
TAG = "SPDX-License-Identifier: "
TAGGED = sorted({*TEMPLATES, *(name for clauses in CLAUSES.values() for _, name, _ in clauses if name)} - {"All-Rights-Reserved", "BSD"})
TAG_GOES_ON = re.compile(r"[A-Za-z0-9+-]|\.[A-Za-z0-9]")  # behind a name: it is a longer one
CUE = re.compile(r"licen[sc]e|all rights reserved|permission|redistribut|public domain|free software", re.I | re.A)
WORD = re.compile(r"[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*")
COMMENT = ("dnl", "rem")  # words that begin a comment line
# what tells licenses apart, over a wording's plain words: in a text these words stand together, unchanged
TELLING = re.compile(r"\b(?:gnu (?:\w+ )?general public license|(?:apache|mozilla public|mit) license|creative commons(?: [a-z]+)+ [0-9.]+|cc by(?: [a-z]+)* [0-9.]+"
                     r"|(?<=version )[0-9.]+|(?<=^spdx license identifier ).+|(?<=\bv )[0-9.]+|subject to the following conditions)\b")

LEAST_SAVING = 0.40       # bytes that a template must save, as a share of its own compressed size
MOST_SHORT = 20           # words of a short notice
MOST_DIFFERENT = 0.10     # words missing, added or changed, as a share of the template's
OUT = "doc_id long, found array<struct<license:string,start:int,end:int,saving:int,different:int>>"


def plain(word: str) -> str:
    """In lower case; 2.0 and v2 are 2, licence is license."""
    w = re.sub(r"^v(?=[0-9])", "", word.lower().replace("licence", "license"))
    return re.sub(r"(?:\.0)+$", "", w) if w[0].isdigit() else w


def telling(words: list[str]) -> list[tuple[int, int]]:
    """(first, end) of the words that tell licenses apart."""
    text = " ".join(words)
    return [(text[:m.start()].count(" "), text[:m.end()].count(" ") + 1) for m in TELLING.finditer(text)]


class Scanner:
    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES):
        import zstandard

        # one-shot frames without a checksum or size: the bytes left are the content's
        bare = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=bare)
        self.wordings = []
        tags = {name: (TAG + name,) for name in TAGGED} if templates is TEMPLATES else {}
        for name, texts in [*templates.items(), *tags.items()]:
            for t in texts:
                known = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.wordings.append((name, t, [plain(w) for w in WORD.findall(t)], zstandard.ZstdCompressor(dict_data=known, compression_params=bare)))
        self.telling = [telling(words) for _, _, words, _ in self.wordings]
        self.frame = len(self.alone.compress(b""))
        self.own = [len(self.alone.compress(t.encode())) - self.frame for _, t, _, _ in self.wordings]

    def candidates(self, text: str, cue: int) -> list[tuple[int, int]]:
        """(bytes saved, wording) of the block around a cue, best first."""
        saved, sizes = [], {}
        for k, (_, t, _, compressor) in enumerate(self.wordings):
            lo, hi = max(0, cue - len(t)), min(len(text), cue + len(t))
            block = text[lo:hi].encode()
            if (lo, hi) not in sizes:
                sizes[lo, hi] = len(self.alone.compress(block)) - self.frame
            saving = sizes[lo, hi] - (len(compressor.compress(block)) - self.frame)
            if saving >= LEAST_SAVING * self.own[k]:
                saved.append((saving, k))
        return sorted(saved, key=lambda s: (-s[0], s[1]))

    def confirm(self, text: str, cue: int, k: int) -> tuple[int, int, int] | None:
        """(start, end, different words) if the words around the cue are the wording's."""
        _, t, words, _ = self.wordings[k]
        lo = max(0, cue - len(t) - 40)
        near = [(plain(m[0]), lo + m.start(), lo + m.end()) for m in WORD.finditer(text[lo:cue + len(t) + 40]) if m[0].lower() not in COMMENT]
        if hit := self.aligned(near, cue, k):
            return hit
        # a like notice next to this one drew the alignment to itself: only where the cue word is the wording's
        at, slack = next((i for i, (_, _, end) in enumerate(near) if cue < end), 0), int(MOST_DIFFERENT * len(words))
        hits = [hit for j, w in enumerate(words) if near and w == near[at][0]
                if (hit := self.aligned(near[max(0, at - j - slack):at - j + len(words) + slack], cue, k))]
        return min(hits, key=lambda h: h[2], default=None)

    def aligned(self, near: list[tuple[str, int, int]], cue: int, k: int) -> tuple[int, int, int] | None:
        words = self.wordings[k][2]
        blocks = [b for b in difflib.SequenceMatcher(None, [w for w, _, _ in near], words, autojunk=False).get_matching_blocks() if b.size]
        # stray words far from the body are no part of it
        body = max(blocks, key=lambda b: b.size, default=None)
        if body is None:
            return None
        blocks = [b for b in blocks if abs((b.a - b.b) - (body.a - body.b)) <= MOST_DIFFERENT * len(words)]
        first, last, shared = blocks[0].a, blocks[-1].a + blocks[-1].size, sum(b.size for b in blocks)
        different = max(len(words), last - first) - shared
        if different > MOST_DIFFERENT * len(words) or not near[first][1] <= cue < near[last - 1][2]:
            return None
        place = {b.b + i: b.a + i for b in blocks for i in range(b.size)}
        if any(place.get(j) is None or place[j] - place.get(p, -1) != j - p for p, q in self.telling[k] for j in range(p, q)):
            return None
        return near[first][1], near[last - 1][2], different

    def named(self, text: str, k: int, end: int) -> str | None:
        """The license of a confirmed wording that ends here, by what follows it; None if it is part of another notice."""
        name, t, words, _ = self.wordings[k]
        if t.startswith(TAG):
            return None if TAG_GOES_ON.match(text, end) else name
        clauses = CLAUSES.get(name, ()) if len(words) > MOST_SHORT else ()
        if clauses:
            reach = max(n for _, _, n in clauses)
            after = [plain(w) for w in itertools.islice((m[0] for m in WORD.finditer(text, end) if m[0].lower() not in COMMENT), reach)]
            own = f" {' '.join(words[:6])} "
            for clause, other, n in clauses:
                near = f" {' '.join(after[:n])} ".split(own)[0] + " "  # up to the next notice of this wording
                if f" {' '.join(plain(w) for w in WORD.findall(clause))} " in near:
                    return other
        return name

    def scan(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, license, bytes saved, different words), in order, without overlap."""
        found: list[tuple[int, int, str, int, int]] = []
        for m in CUE.finditer(text):
            if found and m.start() < found[-1][1]:
                continue
            hits = [(hit[2] / len(self.wordings[k][2]), rank, name, saving, hit) for rank, (saving, k) in enumerate(self.candidates(text, m.start()))
                    if (hit := self.confirm(text, m.start(), k)) and (name := self.named(text, k, hit[1]))]
            if hits:  # the fewest differing words, then the better rank
                _, _, name, saving, (start, end, different) = min(hits)
                found.append((start, end, name, saving, different))
        return found


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Per document: doc_id and the licenses found, with their place in code
    points, the saving and the number of differing words.

    One row per input row. Null and empty texts hold none; repeated rows and
    null ids are judged alike; of wordings that save equally the first listed
    wins; other columns are ignored. Of a tag with several names the first is
    reported, a name that is not listed is not. Narrow: no shuffle.
    """
    item = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saving", pa.int32()), ("different", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [[{"license": n, "start": a, "end": b, "saving": s, "different": d} for a, b, n, s, d in scanner.scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
