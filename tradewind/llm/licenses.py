"""License notices in texts: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.words import LOWER, SPACE, mix, text_chunks, word_hashes

#: Public notices by which a text says what license it has.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_B = np.arange(256)
#: Bytes as read here: A-Z lower-cased, ASCII that is no letter or digit a gap.
READ = np.where((_B < 128) & ~(((LOWER >= 97) & (LOWER <= 122)) | ((_B >= 48) & (_B <= 57))), 32, LOWER).astype(np.uint8)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = mix(h + words[i : i + n])
    return h


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places chosen by winnowing: in every `window` neighbours the smallest hash, the last of equals."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


class Index:
    """Fingerprints of the templates: hash, template and place, sorted by hash."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.names, self.words = list(templates), []
        found = []
        for i, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            words, _ = word_hashes(READ[data], np.array([0, len(data)]))
            self.words.append(words)
            grams = _grams(words, k)
            found += [(int(grams[p]), i, int(p)) for p in winnow(grams, window)]
        found.sort()
        self.hash = np.array([f[0] for f in found], np.uint64)
        self.template, self.place = (np.array([f[c] for f in found], np.int64) for c in (1, 2))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, template, place in the template) of every shared fingerprint."""
        low, high = np.searchsorted(self.hash, grams, "left"), np.searchsorted(self.hash, grams, "right")
        at = np.flatnonzero(high > low)
        many = (high - low)[at]
        entry = np.repeat(low[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.template[entry], self.place[entry]


def chains(place: np.ndarray, spot: np.ndarray, reach: int, k: int) -> list[tuple[int, int, int, int]]:
    """Candidates of one template from its hits in one text: lowest and highest diagonal, and the words each may use.

    A hit continues the chain that ends before it in text and template, with the nearest diagonal, at most `reach` away;
    without one it begins a chain, as a new copy does. Of the text a chain leaves out what chains before and after it with
    as many hits hold.
    """
    found: list[list[tuple[int, int]]] = []
    last = 0
    for at, here in sorted(zip(place.tolist(), spot.tolist())):
        near = [(abs(at - here - c[-1][0] + c[-1][1]), i) for i, c in enumerate(found[last:], last) if c[-1][0] < at and c[-1][1] < here]
        if near and min(near)[0] <= reach:
            found[min(near)[1]].append((at, here))
        else:
            found.append([(at, here)])
        while found[last][-1][0] + 2 * reach < at:
            last += 1  # too far back to go on
    out = []
    for i, c in enumerate(found):
        low, high, size = 0, np.iinfo(np.int64).max, len(c)
        for o in reversed(found[:i]):
            if len(o) >= size and o[-1][0] < c[0][0]:
                low = o[-1][0] + k
                break
        for o in found[i + 1 :]:
            if len(o) >= size and o[0][0] > c[-1][0]:
                high = o[0][0]
                break
        diagonals = [at - here for at, here in c]
        out.append((min(diagonals), max(diagonals), min(low, c[0][0]), high))
    return out


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Words matched by the best alignment within `band` of the diagonal, and the text's words from and to there.

    Global over the template, free at both ends of the text: a match counts 1, everything else nothing; of equal
    alignments the one that spans the fewest words of the text.
    """
    low = diagonal - band
    width = 2 * band + 1
    none = (-1, 0, 0)
    before = [(0, -max(0, low + d), max(0, low + d)) for d in range(width)]  # (matches, -start, end) after no template word
    for i, word in enumerate(template):
        now: list[tuple[int, int, int]] = []
        for d in range(width):
            j = i + low + d  # the text's word beside this one
            up = before[d + 1] if d + 1 < width else none  # this template word is left out
            best = up
            if 0 <= j < len(text):
                same = before[d]
                if text[j] == word:
                    start = -same[1] if same[0] > 0 else j
                    best = max(best, (same[0] + 1, -(start), j + 1), key=lambda c: (c[0], -(c[2] + c[1])))
                elif same[0] >= best[0]:
                    best = max(best, same, key=lambda c: (c[0], -(c[2] + c[1])))
                if now and now[-1][0] > best[0]:
                    best = now[-1]  # a word of the text is left out
            now.append(best)
        before = now
    matched, start, end = max(before, key=lambda c: (c[0], -(c[2] + c[1])))
    return matched, -start, end


def find_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    k: int = 3,
    window: int = 2,
    band: int = 6,
    least: float = 0.8,
) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, matched_words, template_words, start, end (code points).

    Words are runs of letters and digits, A-Z lower-cased. The templates' k-grams of words are thinned by winnowing over
    `window` neighbours and kept in an inverted index, which is part of the code and so of fixed size; `k` + `window` - 1
    words in a row are never missed. Every k-gram of the whole text is looked up. Hits of a template that continue
    each other in text and template, with at most `band` words or the template's length between, are one candidate; its
    words are aligned with the text's within `band` words of its own diagonals. A candidate with
    `least` of its words matched is reported; one that lies within another of higher coverage times length is not.

    Null, empty and short texts have no notices. Repeated rows report each by itself; other columns are not read; an
    empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, k, window)
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[tuple] = []
            for at, data, offsets in text_chunks(batch.column("text")):
                words, rows = word_hashes(READ[data], offsets)
                place, template, spot = index.hits(_grams(words, k))
                row = np.searchsorted(rows, place, "right") - 1
                for r in np.unique(row).tolist():
                    mine = row == r
                    own = words[rows[r] : rows[r + 1]]
                    raw = data[offsets[r] : offsets[r + 1]]
                    found = []
                    for t in np.unique(template[mine]).tolist():
                        goal = index.words[t]
                        own_hits = mine & (template == t)
                        for first, final, low, high in chains(place[own_hits] - rows[r], spot[own_hits], max(band, len(goal)), k):
                            low, high = max(low, first - band), min(high, final + len(goal) + band, len(own))
                            matched, start, end = align(goal, own[low:high], (first + final) // 2 - low, (final - first + 1) // 2 + band)
                            if matched >= least * len(goal):
                                found.append((matched, t, start + low, end + low))
                    found.sort(key=lambda f: (-f[0], f[1], f[2]))
                    taken: list[tuple] = []
                    for f in found:
                        if all(f[3] <= g[2] or f[2] >= g[3] for g in taken):
                            taken.append(f)
                    if taken:
                        gap = SPACE[READ[raw]]
                        begins = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
                        stops = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
                        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    for matched, i, start, end in sorted(taken, key=lambda f: f[2]):
                        size = len(index.words[i])
                        out.append((ids[at + r].as_py(), index.names[i], matched / size, matched, size, int(points[begins[start]]), int(points[stops[end - 1]])))
            if out:
                columns = list(zip(*out))
                types = [ids.type, pa.string(), pa.float64(), *[pa.int64()] * 4]
                names = ["doc_id", "license", "coverage", "matched_words", "template_words", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(columns, types)], names=names)

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(
        scan, f"doc_id {kind}, license string, coverage double, matched_words long, template_words long, start long, end long"
    )
