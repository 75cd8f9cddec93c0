"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import WordHashes, map_arrow, shingles
from pointmill.llm.spans import sliding_min

#: Notices by SPDX identifier; more, or full texts, can be passed to scan().
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Words that tell licenses apart. A template's own must all match, and none may stand in its stretch, or just
#: beside it, that it doesn't have.
DECISIVE = frozenset(b"lesser library affero sa nc nd by sharealike noncommercial noderivatives noderivs mit apache mozilla bsd isc gpl lgpl agpl gnu cc cc0 not".split())

_TOKEN = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*|[\x80-\xff]+")


def tokens(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lower-case words and numbers (2.0 is 2), with their first and last byte in the UTF-8 text."""
    raw = (text or "").encode("utf-8", "replace").lower()
    found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(raw)]
    w, a, b = zip(*found) if found else ((), (), ())
    w = [x.removesuffix(b".0") if x[:1].isdigit() else x for x in w]
    return w, np.array(a, np.int64), np.array(b, np.int64)


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints that winnowing keeps: the least hash of every window of `width` hashes."""
    return np.unique(sliding_min(h, min(width, len(h)))) if len(h) else h


@dataclass
class Index:
    """Inverted index from winnowed fingerprints to (template, position). Its size is that of the templates.

    Winnowing is sure to keep one fingerprint of any k + width - 1 words. A template of fewer words is
    indexed by all of its runs of `short` words, as are the documents for these templates alone."""

    templates: dict[str, tuple[str, ...]] = field(default_factory=lambda: TEMPLATES)
    k: int = 3
    width: int = 3
    short: int = 2

    def __post_init__(self):
        hashes = WordHashes()
        self.names, self.words, self.at, self.few = [], [], {}, {}
        for name, texts in sorted(self.templates.items()):
            for t in texts:
                words = tokens(t)[0]
                self.names.append(name)
                self.words.append(words)
                if not words:
                    raise ValueError(f"a template of {name} has no words")
                if len(words) < self.k + self.width - 1:
                    for i, x in enumerate(shingles(hashes.of(words), self.short).tolist()):
                        self.few.setdefault(x, []).append((len(self.words) - 1, i))
                    continue
                h = shingles(hashes.of(words), self.k)
                kept = set(winnow(h, self.width).tolist())
                for i, x in enumerate(h.tolist()):
                    if x in kept:
                        self.at.setdefault(x, []).append((len(self.words) - 1, i))
        self.prints, self.few_prints = (np.array(sorted(x), np.uint64) for x in (self.at, self.few))
        # a template of one word is the run of that word alone
        self.lengths = sorted({min(self.short, len(self.words[t])) for x in self.few.values() for t, _ in x})

    def candidates(self, words: np.ndarray) -> dict[int, list[int]]:
        """Per template: word positions at which it would start, by the document's own winnowed fingerprints."""
        out: dict[int, list[int]] = {}
        if not len(words):
            return out
        h = shingles(words, self.k)
        hit = np.isin(h, self.prints)
        if hit.any():
            kept = winnow(h, self.width)
            for i in np.flatnonzero(hit & np.isin(h, kept)).tolist():
                for template, at in self.at[int(h[i])]:
                    out.setdefault(template, []).append(i - at)
        for k in self.lengths:
            if len(words) >= k:
                h = shingles(words, k)
                for i in np.flatnonzero(np.isin(h, self.few_prints)).tolist():
                    for template, at in self.few[int(h[i])]:
                        out.setdefault(template, []).append(i - at)
        return out


def align(template: list[bytes], words: list[bytes], start: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and past-last document word of the best local alignment within `band` of the
    diagonal at `start`: +2 a match, -1 a mismatch or gap."""
    n, width = len(template), 2 * band + 1
    score, matched, begin = [0] * width, [0] * width, [-1] * width
    best = (0, 0, 0, 0)
    for i in range(n):
        ns, nm, nb = [0] * width, [0] * width, [-1] * width
        for d in range(width):
            j = start + i + d - band
            if not 0 <= j < len(words):
                continue
            s, m, b = score[d], matched[d], begin[d]
            if template[i] == words[j]:
                s, m, b = s + 2, m + 1, b if s > 0 and b >= 0 else j
            else:
                s -= 1
            if d + 1 < width and score[d + 1] - 1 > s:
                s, m, b = score[d + 1] - 1, matched[d + 1], begin[d + 1]
            if d > 0 and ns[d - 1] - 1 > s:
                s, m, b = ns[d - 1] - 1, nm[d - 1], nb[d - 1]
            if s <= 0:
                s, m, b = 0, 0, -1
            ns[d], nm[d], nb[d] = s, m, b
            if template[i] == words[j] and s > best[0]:
                best = (s, m, b, j + 1)
        score, matched, begin = ns, nm, nb
    return best[1], best[2], best[3]


def decisive(word: bytes) -> bool:
    """Words that tell licenses apart: DECISIVE ones, and numbers, which are versions."""
    return word in DECISIVE or word[:1].isdigit()


#: Between two words: the end of a sentence, or an empty line.
_ENDS = re.compile(rb"[.!?;][\"')\]]*\s|\n\s*\n")


def told_apart(template: list[bytes], words: list[bytes], i: int, j: int, gap: Callable[[int], bytes]) -> bool:
    """Whether words[i:j] has the template's decisive words and no others, in order.

    A short template, a notice of one line, also has no word inside that it lacks, does not follow "not",
    and ends where the document's variant of the name does not go on ("CC BY" before "SA"). Words of the
    sentences before and after, as gap(n), the bytes before words[n], parts them, are neither."""
    plain = lambda ws: [w for w in ws if decisive(w)]
    if plain(template) != plain(words[i:j]):
        return False
    if len(template) > SHORT:
        return True
    denied = words[i - 1 : i] == [b"not"] and not _ENDS.search(gap(i))
    goes_on = j < len(words) and words[j] in DECISIVE and words[j] not in (b"not", b"by") and not _ENDS.search(gap(j))
    return j - i <= len(template) and not denied and not goes_on


#: Templates of at most so many words are notices of one line.
SHORT = 14


def hits(index: Index, text: str | None, hashes: WordHashes, least: float = 0.7, band: int = 8):
    """(license, coverage, matched words, words of the template, first word, past-last word, first byte,
    past-last byte) of the licenses in a text, best first where they overlap; each stretch once."""
    words, a, b = tokens(text)
    gap = lambda n: text.encode("utf-8", "replace")[b[n - 1] : a[n]]
    found = []
    for template, starts in index.candidates(hashes.of(words)).items() if words else ():
        last = None
        for s in sorted(starts):
            if last is not None and s - last <= band // 2:
                continue
            last = s
            m, i, j = align(index.words[template], words, s, band)
            if m and m / len(index.words[template]) >= least and told_apart(index.words[template], words, i, j, gap):
                found.append((m / len(index.words[template]), m, template, i, j))
    taken: list[tuple[int, int]] = []
    for coverage, m, template, i, j in sorted(found, key=lambda x: (-x[1] * x[0], x[2], x[3])):
        if any(i < y and x < j for x, y in taken):
            continue
        taken.append((i, j))
        yield index.names[template], coverage, m, len(index.words[template]), i, j, int(a[i]), int(b[j - 1])


RESULT = "doc_id long, license string, coverage double, matched int, template_words int, start_word int, stop_word int, start_byte long, stop_byte long"


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """One row per license found in each document. Null, empty and wordless texts have none, nor has an empty
    table; equal rows report alike; whole texts of any length are read; columns of any other name are left
    out. Where licenses overlap, the one with more matched words is reported, of equal ones the first by
    name. A template without words is refused."""
    index, box = Index(templates or TEMPLATES), []

    def run(batch: pa.RecordBatch):
        if not box:
            box.append(WordHashes())
        rows = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in hits(index, t, box[0], least)]
        cols = list(zip(*rows)) or [[]] * 9
        kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, RESULT)
