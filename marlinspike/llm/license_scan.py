"""License scan by conditional compression.

A candidate block is compressed once alone and once with each license template
as a raw-content Zstandard dictionary.  A template that says the same makes the
block almost free, so templates are ranked by how much they shrink it.  The
winner is confirmed, or not, by the exact difference of its words to the
template's: few words may differ, and none that decide which license it is, such
as its name, its version or NC and SA.  A notice inside longer text is cut out by
aligning each template with the words around each license word, and what is cut
out is ranked and confirmed like any block.  Lines without any license word
never leave the scan's filter.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed wording of common license notices; a parameter of the scan.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under the Creative Commons CC0 1.0 Universal dedication.",
}
_TRIGGER = r"(?i)licen[cs]e|creative\W+commons|\bCC\W+BY\b|SPDX-|permission\W+is\W+hereby|permission\W+to\W+use|redistribution\W+and\W+use|free\W+software|public\W+domain"
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Least share by which the winner shrinks a block, and most differing words as a share of the template's.
LEAST_REDUCTION, MOST_DIFFERENT = 0.3, 0.2
#: Blocks whose verdict a scanner remembers.
JUDGED = 20_000
#: Words that tell one license from another; versions do too, years do not.
_NAMES = frozenset(
    "mit apache gpl lgpl agpl gnu lesser library affero mozilla mpl bsd boost isc zlib cc cc0 nc nd sa noncommercial sharealike noderivatives noderivs unlicense unencumbered".split()
)
_VERSION, _YEAR = re.compile(r"v?\d+(\.\d+)*"), re.compile(r"(19|20)\d\d")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def deciding(words: list[str]) -> set[str]:
    """Names and versions among the words, also those joined to others by a hyphen."""
    parts = {p for w in words for p in w.split("-")}
    return {p.removeprefix("v") if _VERSION.fullmatch(p) else p for p in parts if p in _NAMES or _VERSION.fullmatch(p) and not _YEAR.fullmatch(p)}


def difference(block: list[str], template: list[str]) -> tuple[int, int]:
    """Words of the template that the block lacks, and words that it adds, along an alignment that keeps the most words.

    Bit i of the state is cleared where the longest common subsequence with the
    template's first i + 1 words is longer than with its first i.
    """
    places: dict[str, int] = {}
    for i, word in enumerate(template):
        places[word] = places.get(word, 0) | 1 << i
    full = state = (1 << len(template)) - 1
    for word in block:
        if here := places.get(word):
            met = state & here
            state = ((state + met) | (state - met)) & full
    same = len(template) - state.bit_count()
    return len(template) - same, len(block) - same


def blocks_of(text: str, longest: int) -> list[tuple[int, int, str]]:
    """(first line, end line, text) of candidate blocks.

    Each line with a license word is a block, and so is the paragraph around
    it if it has several lines and at most twice the longest template's words.
    More words than that differ from every template in too many to be confirmed;
    a notice among them is cut out by ``Scanner.windows``.
    """
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if re.search(_TRIGGER, line)]
    out, done = [], -1
    for i in hits:
        out.append((i, i + 1, lines[i]))
        if i < done:
            continue
        a, b = i, i + 1
        while a > 0 and lines[a - 1].strip():
            a -= 1
        while b < len(lines) and lines[b].strip():
            b += 1
        done = b
        part = " ".join(lines[a:b])
        if b - a > 1 and len(wording(part)) <= 2 * longest:
            out.append((a, b, part))
    return out


def best_windows(words: np.ndarray, template: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(differing words, start, end) of the windows of ``words`` that differ from the template in at most ``most`` words.

    Exact: missing and extra words are counted along the best alignment that
    ends at each word.  Of windows that overlap the one that differs least stays.
    """
    n = len(words)
    unit = n + 2  # a key is the difference times the unit, less the start: the shortest window wins ties
    at = np.arange(n + 1, dtype=np.int64)
    extra, key = at * unit, unit - 1 - at
    for word in template:
        nxt = key + unit
        nxt[1:] = np.minimum(nxt[1:], np.where(words == word, key[:-1], np.iinfo(np.int64).max))
        key = np.minimum.accumulate(nxt - extra) + extra
    cost, start = key // unit, unit - 1 - key % unit
    out, taken = [], Taken()
    for end in sorted(np.flatnonzero(cost <= most).tolist(), key=lambda j: (cost[j], j)):
        a = int(start[end])
        if a < end and taken.add(a, end):
            out.append((int(cost[end]), a, end))
    return out


class Taken:
    """Spans that do not overlap."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, start: int, end: int) -> int | None:
        """Where a span would go, or None if it overlaps another."""
        at = bisect_right(self.starts, start)
        if at and self.ends[at - 1] > start or at < len(self.starts) and self.starts[at] < end:
            return None
        return at

    def add(self, start: int, end: int) -> bool:
        at = self.free(start, end)
        if at is None:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class Scanner:
    """Compressors of all templates; one a worker."""

    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        # no magic number, sizes or checksums: only what the block itself costs
        plain = z.ZstdCompressionParameters.from_level(9, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = z.ZstdCompressor(compression_params=plain)
        self.given = {k: z.ZstdCompressor(compression_params=plain, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
        self.words = {k: wording(t) for k, t in templates.items()}
        self.longest = max(map(len, self.words.values()), default=0)
        self.number = {w: i for i, w in enumerate(sorted({w for own in self.words.values() for w in own}))}
        self.numbers = {k: np.array([self.number[w] for w in own], np.int64) for k, own in self.words.items()}
        self.wanted = {k: np.bincount(own, minlength=len(self.number)) for k, own in self.numbers.items()}
        self.deciding = {k: deciding(own) for k, own in self.words.items()}
        self.judged: dict[str, dict | None] = {}

    def rank(self, block: str) -> list[tuple[float, str]]:
        """Templates by how far they shrink the block, as a share; ties by name."""
        data = block.strip().encode()
        size = max(1, len(self.alone.compress(data)))
        return sorted((-(size - len(c.compress(data))) / size, k) for k, c in self.given.items())

    def windows(self, text: str) -> list[dict]:
        """Confirmed notices at any place of the text, whatever lines and words surround them; none overlap."""
        spans = [m.span() for m in _WORD.finditer(text)]
        if not spans:
            return []
        starts = [a for a, _ in spans]
        words = np.array([self.number.get(text[a:b].lower(), -1) for a, b in spans], np.int64)
        breaks = [m.start() for m in re.finditer("\n", text)]
        hits = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in re.finditer(_TRIGGER, text)})
        found = []
        for name, own in self.numbers.items():
            most = int(MOST_DIFFERENT * len(own))
            reach, regions = len(own) + most, []
            for p in hits if len(own) else []:
                a, b = max(0, p - reach), min(len(words), p + reach + 1)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = b
                else:
                    regions.append([a, b])
            for a, b in regions:
                part = words[a:b]
                # whatever the order, so many of the template's words must be there
                if np.minimum(np.bincount(part[part >= 0], minlength=len(self.number)), self.wanted[name]).sum() < len(own) - most:
                    continue
                for differing, i, j in best_windows(part, own, most):
                    same = (len(own) + j - i - differing) // 2
                    found.append((-same, differing, name, a + i, a + j))
        out, taken = [], Taken()
        for _, _, name, i, j in sorted(found):
            if taken.free(i, j) is None:
                continue
            low, high = spans[i][0], spans[j - 1][1]
            best = self.judge(" ".join(text[low:high].split()))
            if best and best["confirmed"] and best["license"] == name:
                taken.add(i, j)
                out.append({"line_from": bisect_right(breaks, low), "line_to": bisect_right(breaks, high - 1) + 1} | best)
        return sorted(out, key=lambda r: (r["line_from"], r["line_to"], r["license"]))

    def judge(self, block: str) -> dict | None:
        """The best-ranked template that the block's words confirm, or else the best-ranked one."""
        if block in self.judged:
            return self.judged[block]
        own, best = wording(block), None
        marks = deciding(own)
        for loss, name in self.rank(block):
            missing, extra = difference(own, self.words[name])
            found = {"license": name, "reduction": -loss, "n_missing": missing, "n_extra": extra}
            found["confirmed"] = -loss >= LEAST_REDUCTION and missing + extra <= MOST_DIFFERENT * len(self.words[name]) and marks == self.deciding[name]
            best = best or found
            if found["confirmed"]:
                best = found
                break
            if -loss < LEAST_REDUCTION:
                break
        if len(self.judged) >= JUDGED:
            self.judged.clear()
        self.judged[block] = best
        return best

    def scan(self, text: str) -> list[dict]:
        out = [{"line_from": a, "line_to": b} | best for a, b, block in blocks_of(text, self.longest) if (best := self.judge(block))]
        # a confirmed block has no room for a second copy, so a window of its license in it is the same notice
        sure: dict[str, list[tuple[int, int]]] = {}
        for r in sorted((r for r in out if r["confirmed"]), key=lambda r: r["line_from"]):
            own = sure.setdefault(r["license"], [])
            own.append((r["line_from"], max(r["line_to"], own[-1][1] if own else 0)))  # the farthest end so far
        for w in self.windows(text):
            own = sure.get(w["license"], [])
            at = bisect_right(own, w["line_from"], key=lambda r: r[0])
            if not at or own[at - 1][1] < w["line_to"]:
                out.append(w)
        return out


_scanners: dict[int, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidate blocks of all documents with their best template.

    Returns doc_id, line_from, line_to (lines of the text from 0, end
    exclusive), license, reduction, n_missing, n_extra and confirmed.  A block
    whose winner is not confirmed stays, with confirmed false.  Notices that are
    part of a longer line or paragraph, or go over blank lines, add a row each,
    of the lines they touch and with the differences of their own words.  Null and empty
    texts have no blocks; repeated rows give repeated results; only the two
    named columns are read.
    """

    def scan(batches):
        key = hash(tuple(sorted(templates.items())))
        if key not in _scanners:
            _scanners[key] = Scanner(templates)
        scanner = _scanners[key]
        names = ["doc_id", "line_from", "line_to", "license", "reduction", "n_missing", "n_extra", "confirmed"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = [{"doc_id": i} | r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in scanner.scan(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(_TRIGGER))
    return rows.mapInArrow(scan, "doc_id long, line_from long, line_to long, license string, reduction double, n_missing long, n_extra long, confirmed boolean")
