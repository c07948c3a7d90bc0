"""License scans by conditional compression.

In blocks of text that may state a license, every template is confirmed by the exact differences
in wording, wherever the block has it. Places are compressed with the template as a raw zstandard
dictionary: of templates with equally many differences at a place, the one that makes it smallest,
next to its size without any, ranks first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import runtime as R

# Names and wordings of license notices, and words that a statement of a license has.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MARKS = ("licens", "licenc", "permission is hereby", "redistribution and use")

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Marks with their words on one line or wrapped, with comment signs between.
_MARKS = [re.compile(re.escape(mark).replace(r"\ ", r"[\W_]+")) for mark in MARKS]
#: Where lines end, with comment signs of the next.
_WRAP = re.compile(r"\s*\n[\W_]*")
#: The share of a template's words that may differ.
MOST_CHANGED = 0.2
#: A difference in the costs of alignments; what is below it says where they start.
_STEP = 1 << 32


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: w for name, t in templates.items() if (w := _WORD.findall(t.lower()))}
        self.bags = {name: Counter(w) for name, w in self.words.items()}
        self.most = {name: int(MOST_CHANGED * len(w) + 1e-9) for name, w in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=9)
        self.given = {name: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, t in templates.items()}

    @staticmethod
    def lower(text: str) -> str:
        """The text in lower case, each letter at its place."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift positions
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        return low

    def blocks(self, low: str, starts: list[int]) -> list[tuple[int, int]]:
        """Words, by their starts in the text, that a place around a mark can reach, over any lines; words that touch are one block."""
        reach = max((len(w) + self.most[name] for name, w in self.words.items()), default=0)
        out: list[tuple[int, int]] = []
        for at in sorted(m.start() for mark in _MARKS for m in mark.finditer(low)):
            k = bisect_right(starts, at) - 1
            start, end = max(k - reach + 1, 0), min(k + reach, len(starts))
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
        return out

    def reduction(self, name: str, low: str) -> float:
        """How much smaller the template makes a text, its lines joined, as a share of its own size."""
        data = _WRAP.sub(" ", low).encode(errors="replace")
        return 1 - len(self.given[name].compress(data)) / len(self.plain.compress(data))

    def places(self, name: str, have: list[str], start: int, end: int) -> list[tuple[int, int, int]]:
        """(differences, first word, word after the last) of places among have[start:end] that are near enough to the template.

        Of places that overlap, the one with the fewest differences, then the first. Differences
        are words of the template that a place lacks and words amid it that it adds.
        """
        want, most = self.words[name], self.most[name]
        if sum((self.bags[name] - Counter(have[start:end])).values()) > most:
            return []
        column = [i * _STEP - start for i in range(len(want) + 1)]
        found = []
        for j in range(start, end):
            w, last, diagonal, above = have[j], column[-1], column[0], -(j + 1)
            column[0] = above
            for i, x in enumerate(want, 1):
                left = column[i]
                cost = (left if left < above else above) + _STEP
                if x == w and diagonal < cost:
                    cost = diagonal
                column[i] = above = cost
                diagonal = left
            if above < last + _STEP and (n := -(-above // _STEP)) <= most:
                found.append((n, n * _STEP - above, j + 1))
        return _apart(sorted(found, key=lambda f: (f[0], f[2])))

    def differences(self, name: str, have: list[str]) -> list[str]:
        """Words of the template that the words of a place lack (-word), and words it adds (+word): as few as can be."""
        want = self.words[name]
        rest = [[0] * (len(have) + 1) for _ in range(len(want) + 1)]
        for i in range(len(want), -1, -1):
            for j in range(len(have), -1, -1):
                if i == len(want) or j == len(have):
                    rest[i][j] = len(want) - i + len(have) - j
                else:
                    rest[i][j] = rest[i + 1][j + 1] if want[i] == have[j] else 1 + min(rest[i + 1][j], rest[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(want) or j < len(have):
            if i < len(want) and j < len(have) and want[i] == have[j]:
                i, j = i + 1, j + 1
            elif j == len(have) or (i < len(want) and rest[i + 1][j] <= rest[i][j + 1]):
                out.append("-" + want[i])
                i += 1
            else:
                out.append("+" + have[j])
                j += 1
        return out

    def find(self, text: str | None) -> list[tuple[int, int, str, float, int, str]]:
        """(start, end, license, reduction, number of differences, differences) of each place that states a license.

        Places don't overlap: fewer differences go first, then the larger reduction, then the
        name. What is left between them is searched again until no template is confirmed.
        """
        low = self.lower(text or "")
        if not any(mark.search(low) for mark in _MARKS):
            return []
        at = [m.span() for m in _WORD.finditer(low)]
        have, starts = [low[a:b] for a, b in at], [a for a, _ in at]
        todo = self.blocks(low, starts)
        taken = []
        while todo:
            start, end = todo.pop()
            found = []
            for name in self.words:
                for n, a, b in self.places(name, have, start, end):
                    found.append((n, -self.reduction(name, low[at[a][0] : at[b - 1][1]]), name, a, b))
            new = _apart([(*f[3:], f) for f in sorted(found)], 0)
            taken += [f for *_, f in new]
            if new:
                edges = [start, *(x for a, b, _ in sorted(new) for x in (a, b)), end]
                todo += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
        return [(at[a][0], at[b - 1][1], name, -gain, n, " ".join(self.differences(name, have[a:b]))) for n, gain, name, a, b in sorted(taken, key=lambda f: f[3])]


def _apart(found: list[tuple], k: int = 1) -> list[tuple]:
    """Of (.., start, end, ..) with the start at k, in order of preference, those that overlap none before."""
    out: list[tuple] = []
    ends: list[int] = []
    for f in found:
        i = bisect_left(ends, f[k] + 1)  # the first one that ends after this starts
        if i == len(ends) or out[i][k] >= f[k + 1]:
            ends.insert(i, f[k + 1])
            out.insert(i, f)
    return out


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, start, end, license, reduction, n_changes, changes) of each license statement found.

    Positions are code points of the text, from the first to the last word of the statement. Null and empty texts have none; rows are
    independent, so that repeated rows are found again each. Of statements that overlap, the one with the
    fewest changes is reported, then the one with the largest reduction, then the first name. Other columns are ignored.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in scanner.find(text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "end", "license", "reduction", "n_changes", "changes"])

    documents = R.columns(documents, "doc_id", "text")
    return R.arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, start int, end int, license string, reduction double, n_changes int, changes string")
