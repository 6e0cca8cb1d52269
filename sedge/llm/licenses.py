"""Operator 3: licences by conditional compression.

Around each cluster of cue words a block of a text is a candidate: as many words before and after as
the longest template can have there, over any number of lines. Each block is compressed with every
template as a zstandard raw dictionary; the templates are ranked by what they save beside no
dictionary, and each that saves anything is confirmed, or not, by the exact differences of wording
between block and template, which also cut the block down to the notice.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import from_texts, need

# Public wordings of notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
}
#: What may stand between two words where a notice is wrapped: white space and the marks of comments.
BREAK = r"(?:\x20|[^\S\n]*\n[\s#*/;%>-]*)"
CUE = re.compile(rf"licen[sc]|permission{BREAK}(?:is|to)|redistribut|public{BREAK}domain|spdx", re.IGNORECASE)
WRAP = re.compile(BREAK)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: Share of a template's words that may differ; words that one cluster of cues may span.
DIFFERENT, CLUSTER = 0.1, 64


def _reach() -> tuple[int, int]:
    """The most words that a notice can have before its first cue, and from it on, with those that may differ."""
    before, after = 0, 0
    for text in (t for texts in TEMPLATES.values() for t in texts):
        all_words = len(WORD.findall(text))
        head = len(WORD.findall(text[: m.start()])) if (m := CUE.search(text)) else 0
        spare = int(DIFFERENT * all_words)
        before, after = max(before, head + spare), max(after, all_words - head + spare)
    return before, after


BEFORE, AFTER = _reach()
RESULT = "n_licenses long, licenses string, spans string, n_candidates long"


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        import zstandard

        plain = {"level": 3, "write_content_size": False, "write_checksum": False}
        self.bare = zstandard.ZstdCompressor(**plain)
        self.all = []
        for name, texts in templates.items():
            for text in texts:
                data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.all.append((name, [w.lower() for w in WORD.findall(text)], zstandard.ZstdCompressor(dict_data=data, **plain)))

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(saving, template) of those that save, best first."""
        data = WRAP.sub(" ", block).encode()
        size = len(self.bare.compress(data))
        found = [(size - len(c.compress(data)), k) for k, (_, _, c) in enumerate(self.all)]
        return sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1]))

    def _best(self, words: list[tuple[str, int, int]], among: list[int]) -> tuple | None:
        """(template's words as minus, words that differ, first, last, name) of the best template that the wording confirms."""
        own = [w[0] for w in words]
        counts, best = Counter(own), None
        for k in among:
            name, wanted, _ = self.all[k]
            most = DIFFERENT * len(wanted)
            if len(wanted) - (Counter(wanted) & counts).total() > most:
                continue
            same = [b for b in difflib.SequenceMatcher(None, wanted, own, autojunk=False).get_matching_blocks() if b.size]
            # words before and after the notice may match by chance: of all runs of matches that which differs least
            for i in range(len(same)):
                matched = 0
                for b in same[i:]:
                    matched += b.size
                    first, last = same[i].b, b.b + b.size
                    # a version or variant is a word like any other, so in short notices none may differ
                    differ = max(len(wanted), last - first) - matched
                    if differ <= most and (best is None or (-len(wanted), differ) < best[:2]):
                        best = (-len(wanted), differ, first, last, name)
        return best

    def judge(self, block: str) -> tuple:
        """(name, words that differ, start, end) of each notice in the block, the longest first, then those on its sides."""
        words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(block)]
        among = [k for _, k in self.ranked(block)]
        out, todo = [], [(0, len(words))]
        while todo:
            low, high = todo.pop()
            if low < high and (best := self._best(words[low:high], among)):
                _, differ, first, last, name = best
                out.append((name, differ, words[low + first][1], words[low + last - 1][2]))
                todo += [(low, low + first), (low + last, high)]
        return tuple(out)


def candidate_blocks(text: str) -> Iterator[tuple[int, str]]:
    """(start, block): the passage of words around each cluster of cues, long enough for any notice at any of them."""
    cues = [m.start() for m in CUE.finditer(text)]
    if not cues:
        return
    words = [m.span() for m in WORD.finditer(text)]
    starts = [w[0] for w in words]
    at = [max(0, bisect_right(starts, c) - 1) for c in cues]
    k = 0
    while k < len(at):
        first = last = at[k]
        while k < len(at) and at[k] < first + CLUSTER:
            last, k = at[k], k + 1
        a, b = words[max(0, first - BEFORE)][0], words[min(last + AFTER, len(words) - 1)][1]
        yield a, text[a:b]


def license_spans(text: str, templates: Templates) -> tuple[list[tuple[int, int, str, int]], int]:
    """(start, end, name, differing words) by start, and the number of candidate blocks."""
    found, n = [], 0
    for start, block in candidate_blocks(text):
        n += 1
        found += [(start + a, start + b, name, differ) for name, differ, a, b in templates.judge(block)]
    out: list[tuple[int, int, str, int]] = []
    for span in sorted(set(found), key=lambda s: (s[0] - s[1], s[3], s[0])):  # longest first
        if all(span[1] <= o[0] or span[0] >= o[1] for o in out):
            out.append(span)
    return sorted(out), n


def _scanner():
    templates = Templates(TEMPLATES)

    def row(text: str | None) -> tuple[int, str, str, int]:
        spans, n = license_spans(text or "", templates)
        return len(spans), ",".join(sorted({s[2] for s in spans})), ",".join(f"{name}:{a}:{b}" for a, b, name, _ in spans), n

    return lambda texts: list(map(row, texts))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses, spans (name:start:end, code points) and n_candidates of each row of docs (doc_id, text).

    Null and empty texts have none; a null doc_id stays null; each repeated row has its own row in the
    result; an empty table gives an empty result; extra columns, whatever their names, are not read. Of overlapping spans the
    longest stays, of equally long ones that with fewer differing words. The work on a very long text goes with its
    cues, a block of bounded words for each cluster of them.
    """
    return from_texts(need(docs, "doc_id", "text"), _scanner, RESULT)
