"""License notices by conditional compression against templates.

A candidate block is compressed with each template as a raw-content Zstandard dictionary; the
templates are then compared with it word by word, those that make it smallest first, and of those whose
differences are few the one that accounts for most words is confirmed. What is left on both sides of a
notice is a block again.
"""

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Customary wordings of public licenses' notices.
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
     "provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
     "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction"),
    # Short forms, without the verb that they follow.
    ("apache-2.0", "under the Apache License 2.0"),
    ("apache-2.0", "under the Apache License, Version 2.0"),
    ("bsd-2-clause", "under the BSD 2-Clause License"),
    ("bsd-3-clause", "under the BSD 3-Clause License"),
    ("isc", "under the ISC License"),
    ("mit", "under the MIT License"),
    ("mit", "under the terms of the MIT License"),
    ("mpl-2.0", "under the Mozilla Public License 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Identifiers of the same licenses.
IDENTIFIERS = (
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("lgpl-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
# Words that turn a notice into its opposite, up to three words before it.
NEGATIONS = frozenset(("not", "never", "no", "nor", "neither", "without", "isn't", "aren't", "cannot", "wasn't"))
_TRIGGER = re.compile(r"licen[sc]e|redistribut|hereby\W+granted", re.I)
# A match cannot start inside a run whose first character gave none.
_WORD = re.compile(r"(?<![\w.+-])[\w.+-]*\w")
#: Missing and added words, as a share of the template's words, up to which it is confirmed.
MOST_DIFFERENT = 0.15
#: Templates of which so much is equal are siblings; the words that only one of them has tell their licenses apart.
SIBLINGS = 0.5
_VERSION = re.compile(r"v?\d+(\.\d+)*")


def reach_of(templates) -> int:
    """Words that a notice of any of the templates has at most."""
    return max((math.ceil((1 + MOST_DIFFERENT) * len(words_at(t))) for _, t in templates), default=0)


def words_at(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]


class Scanner:
    """Compressors and words of the templates, made once for each worker."""

    def __init__(self, templates=TEMPLATES + IDENTIFIERS, level: int = 9):
        options = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False)
        self.plain = zstandard.ZstdCompressor(compression_params=options)
        self.names = [n for n, _ in templates]
        self.words = [[w for w, _, _ in words_at(t)] for _, t in templates]
        self.reach = reach_of(templates)
        # Numbers of clauses are no versions.
        self.versions = [{w for before, w in zip([""] + own, own) if _VERSION.fullmatch(w) and ("." in w or before in ("version", "v"))}
                         for own in self.words]
        self.telling, self.rivals = self._telling()
        self.primed = [zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(
            t.encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]

    def _telling(self) -> tuple[list[set[str]], list[set[str]]]:
        """For each template the words that must not be missing, and those that must not stand in it.

        Versions must be there; so must what a sibling of another license lacks, and what only the sibling has must not.
        """
        telling = [set(v) for v in self.versions]
        rivals: list[set[str]] = [set() for _ in self.words]
        for i, own in enumerate(self.words):
            for j, other in enumerate(self.words):
                if self.names[i] != self.names[j] and SequenceMatcher(None, own, other, autojunk=False).ratio() >= SIBLINGS:
                    telling[i] |= set(own) - set(other)
                    rivals[i] |= set(other) - set(own)
        # The long forms differ from each other in whole clauses, not in words; there the bound on differences decides.
        long = [len(own) * MOST_DIFFERENT >= 5 for own in self.words]
        return ([v if x else t for t, v, x in zip(telling, self.versions, long)],
                [set() if x else r for r, x in zip(rivals, long)])

    def _right(self, i: int, missing: list[str], added: list[str]) -> bool:
        """Whether the differences leave the template's license what it is."""
        if self.telling[i].intersection(missing) or self.rivals[i].intersection(added):
            return False
        return not (missing and self.versions[i] and any(_VERSION.fullmatch(w) for w in added))

    def reductions(self, block: str) -> list[tuple[float, int]]:
        """(share by which the template shrinks the block, template), largest first."""
        raw = block.encode("utf-8")
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, i) for i, c in enumerate(self.primed)), key=lambda x: (-x[0], x[1]))

    def _aligned(self, seen: list[str], i: int):
        """(differences, missing words, added words, first word, end word) of template ``i``, None if they are too many."""
        own, most = self.words[i], MOST_DIFFERENT * len(self.words[i])
        match, slack, parts = SequenceMatcher(None, own, seen, autojunk=False), max(2, len(own) // 5), [(0, len(seen))]
        while parts:
            low, high = parts.pop()
            there = set(seen[low:high])
            if sum(w not in there for w in own) > most:
                continue
            core = match.find_longest_match(0, len(own), low, high)
            # Only words about the place of the longest run are compared: stray matches far from it are not part of the notice.
            left = max(low, core.b - core.a - slack)
            near = SequenceMatcher(None, own, seen[left:min(high, core.b - core.a + len(own) + slack)], autojunk=False)
            used = [b for b in near.get_matching_blocks()[:-1] if abs((left + b.b - core.b) - (b.a - core.a)) <= slack]
            if used:
                first, end = min(left + b.b for b in used), max(left + b.b + b.size for b in used)
                hit_own = {b.a + k for b in used for k in range(b.size)}
                hit_seen = {left + b.b + k for b in used for k in range(b.size)}
                missing = [own[k] for k in range(len(own)) if k not in hit_own]
                added = [seen[k] for k in range(first, end) if k not in hit_seen]
                if len(missing) + len(added) <= most and self._right(i, missing, added):
                    return len(missing) + len(added), missing, added, first, end
            parts += [(core.b + core.size, high), (low, core.b)]
        return None

    def _in_part(self, block: str, at: int) -> list[dict]:
        found, open_ = [], [(block, at)]
        while open_:
            block, at = open_.pop()
            words = words_at(block)
            seen = [w for w, _, _ in words]
            best = None
            # Reductions only set the order: near-equal templates take the first places together, so all are compared.
            for reduction, i in self.reductions(block):
                got = self._aligned(seen, i)
                # The template that accounts for most words, differences counted against it; of equal ones that with fewer.
                if got and (best is None or (len(self.words[i]) - got[0], -got[0]) > best[0]):
                    best = (len(self.words[i]) - got[0], -got[0]), got, i, reduction
            if best is None:
                continue
            _, (_, missing, added, first, end), i, reduction = best
            start, stop = words[first][1], words[end - 1][2]
            # What is said before the notice is a difference of its wording, too.
            added = [w for w in seen[max(0, first - 3):first] if w in NEGATIONS] + added
            found.append({"license": self.names[i], "start": at + start, "end": at + stop, "reduction": reduction,
                          "missing": missing, "added": added})
            open_ += [(b, a) for b, a in ((block[:start], at), (block[stop:], at + stop)) if _TRIGGER.search(b)]
        return sorted(found, key=lambda n: n["start"])

    def notices(self, block: str, at: int = 0) -> list[dict]:
        """Confirmed notices of a block that starts ``at`` characters into its text.

        A long block is gone over in parts; a part holds every notice that starts before its last ``reach`` words whole.
        """
        words, found, low = words_at(block), [], 0
        starts = [a for _, a, _ in words]
        while low < len(words):
            high = low + 8 * self.reach
            last = high >= len(words)
            inner = len(block) if last else starts[high - self.reach]
            floor = starts[low]
            mine = [n for n in self._in_part(block[floor:None if last else words[high - 1][2]], at + floor) if n["start"] < at + inner]
            found += mine
            if last:
                break
            low = max(high - self.reach, bisect_left(starts, mine[-1]["end"] - at) if mine else 0)
        return found


def _back(text: str, at: int, floor: int, reach: int) -> int:
    """Where the ``reach`` words before ``at`` start, ``floor`` if there are not so many."""
    size = 16 * reach
    while at - size > floor:
        # The first word may be cut.
        words = [m.start() for m in _WORD.finditer(text[at - size:at])]
        if len(words) > reach:
            return at - size + words[-reach]
        size *= 2
    return floor


def blocks_of(text: str, reach: int = reach_of(TEMPLATES + IDENTIFIERS)) -> Iterator[tuple[int, str]]:
    """(start, block): lines with a trigger, those next to them, and all the words that a notice may run over on both sides."""
    first, last, line = None, 0, -1
    for m in _TRIGGER.finditer(text):
        start = _back(text, m.start(), last, reach)
        # The trigger's own word is one more.
        words = [w.end() for w in islice(_WORD.finditer(text, m.start()), reach + 1)]
        end = max(m.end(), words[-1] if words else 0)
        if m.start() > line:
            start = min(start, max(last, text.rfind("\n", last, max(last, text.rfind("\n", last, m.start()))) + 1))
            line = _line_end(text, m.start())
            next_line = _line_end(text, line + 1)
        if first is not None and start > last:
            yield first, text[first:last]
            first = None
        first, last = start if first is None else first, max(last, end, next_line)
    if first is not None:
        yield first, text[first:last]


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


_NOTICE = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
                     ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])


def _finder(templates):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        reach = scanner.reach
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text, taken, own = text.as_py() or "", 0, []
                for start, block in blocks_of(text, reach):
                    for n in scanner.notices(block, start):
                        if n["start"] >= taken:
                            own.append(n)
                            taken = n["end"]
                rows.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_NOTICE))], names=["doc_id", "notices"])
    return find


def license_notices(docs: DataFrame, templates=TEMPLATES + IDENTIFIERS) -> DataFrame:
    """doc_id and notices (license, start, end, reduction, missing, added) for every row of ``docs``.

    Positions are code points of the whole text; ``missing`` and ``added`` are the exact wording
    differences, a negation within three words before the notice being one; a notice that lacks or replaces a version or
    another word that tells templates apart is none. Null and empty texts have no notices, texts of any length are read
    whole, in parts. Of templates that account for as many words the one that shrinks the block most is taken. Rows are independent: nulls in doc_id and repeated rows
    pass through, an empty table gives no rows, columns other than doc_id and text are not read, whatever their names.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _finder(templates), "doc_id bigint, notices array<struct<license:string,start:bigint,end:bigint,"
        "reduction:double,missing:array<string>,added:array<string>>>")
