"""Licence scans by a positional rare-token index over templates.

Each template word has postings (template, offset) and an IDF over the scanned files.
A file's licence words are gone through from the highest IDF down; every template
looks at the postings of the first RARE_WORDS different ones that it has.  A place p of
a word that a template has at offset i says that the template starts at p - i.  The
postings are intersected by relative position: starts that two rare words or more
agree on, but for words put in or left out between them, name an alignment.  It is
verified: the mandatory key phrase must stand there word for word and not be
negated, and the share of the template's words found in their order is its score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

#: Words are runs of these bytes after A-Z are lower-cased.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: SPDX identifiers and their labels; a tag of each is a template.
IDENTIFIERS = {
    "MIT": "mit",
    "Apache-2.0": "apache-2",
    "BSD-2-Clause": "bsd-2",
    "BSD-3-Clause": "bsd-3",
    "ISC": "isc",
    "Zlib": "zlib",
    "GPL-2.0": "gpl-2",
    "GPL-3.0": "gpl-3",
    "LGPL-2.1": "lgpl",
    "LGPL-3.0": "lgpl",
    "AGPL-3.0": "agpl",
    "MPL-2.0": "mpl-2",
    "EPL-2.0": "epl-2",
    "BSL-1.0": "boost",
    "Unlicense": "unlicense",
    "CC0-1.0": "cc0",
    "CC-BY-4.0": "cc-by",
    "CC-BY-SA-4.0": "cc-by-sa",
    "CC-BY-NC-4.0": "cc-by-nc",
}

#: A tag with its expression, and the operators and names in one.
_TAG = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_NAMES = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_JOINS = frozenset(["and", "or"])
_ENDINGS = re.compile(r"(?i)(\+|-only|-or-later)$")

#: Public licence texts and notices: (label, mandatory key phrase, text).  Disclaimers, which licences share, are left out.
NOTICES = [
    ("mit", "the mit license", "released under the MIT License"),
    ("mit", "the mit license", "licensed under the MIT License"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3",
        "may be used to endorse or promote products derived from this software",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ),
    (
        "zlib",
        "provided as is without any express or implied warranty",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    ),
    ("apache-2", "apache license version 2", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "except in compliance with the license",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("gpl-3", "gnu general public license version 3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "gnu general public license version 2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "gplv3", "licensed under GPLv3"),
    ("gpl-2", "gplv2", "licensed under GPLv2"),
    ("gpl-3", "gnu gpl version 3", "licensed under the GNU GPL version 3"),
    ("gpl-2", "gnu gpl version 2", "licensed under the GNU GPL version 2"),
    (
        "gpl",
        "gnu general public license as published by the free software foundation",
        """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    ("lgpl", "gnu lesser general public license", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "gnu lesser general public license", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "gnu affero general public license", "licensed under the GNU Affero General Public License"),
    ("agpl", "gnu affero general public license", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "mozilla public license v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-2", "eclipse public license", "made available under the terms of the Eclipse Public License 2.0"),
    ("boost", "boost software license version 1 0", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "released into the public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "waived all copyright and related", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "cc by nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "cc by 4 0", "licensed under CC BY 4.0"),
    ("cc-by-nc", "attribution noncommercial 4 0 international", "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "attribution sharealike 4 0 international", "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "attribution 4 0 international", "licensed under the Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

#: Different rare words of a file that one template looks up.
RARE_WORDS = 6
#: Share of a template's words that must be found in their order.
LEAST_SCORE = 0.6
#: Words put in or left out between two postings of one alignment: so many, or a share of the template.
LEAST_SLACK, SLACK = 2, 0.15
#: Words that negate a key phrase if one stands at most NEGATION_SPAN words before it.
NEGATIONS = frozenset(b"not no never nor neither without isn aren wasn".split())
NEGATION_SPAN = 3


def words_of(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())


def tagged_labels(text: str, identifiers: dict[str, str]) -> set[str] | None:
    """Labels of all names in the SPDX expressions of a text, exceptions after WITH left out; null if it has no tag.

    A name counts as a whole: BSD-3-Clause-Clear isn't BSD-3-Clause.  An expression
    ends where two names stand without an operator between them.
    """
    known = {name.lower(): label for name, label in identifiers.items()}
    out: set[str] | None = None
    for expression in _TAG.findall(text):
        out = set() if out is None else out
        wanted, exception = True, False
        for name in _NAMES.findall(expression.lower()):
            if name in _JOINS or name == "with":
                wanted, exception = True, name == "with"
            elif not wanted:
                break
            else:
                wanted = False
                bare = _ENDINGS.sub("", name.rstrip("."))
                if not exception and bare in known:
                    out.add(known[bare])
                exception = False
    return out


def templates_of(notices: list[tuple[str, str, str]], identifiers: dict[str, str]) -> list[tuple[str, list[bytes], list[bytes]]]:
    """(label, key phrase, words) of the notices and of a tag for each identifier."""
    tags = [(label, f"identifier {name}", f"SPDX-License-Identifier: {name}") for name, label in identifiers.items()]
    return [(label, words_of(key), words_of(text)) for label, key, text in [*notices, *tags]]


@dataclass
class Scan:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: list[str]
    labels: list[str]
    score: float


def in_order(template: list[bytes], window: list[bytes]) -> int:
    """The most words of the template that the window has in their order."""
    best = [0] * (len(window) + 1)
    for w in template:
        before = 0
        for j, x in enumerate(window, 1):
            here = best[j]
            if w == x:
                best[j] = before + 1
            elif best[j - 1] > here:
                best[j] = best[j - 1]
            before = here
    return best[-1]


class Index:
    """Postings of template words with their IDF over files."""

    def __init__(self, templates: list[tuple[str, list[bytes], list[bytes]]], base: dict[str, str], idf: dict[bytes, float] | None = None, identifiers: dict[str, str] | None = None) -> None:
        self.templates = templates
        self.identifiers = IDENTIFIERS if identifiers is None else identifiers
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, (_, key, words) in enumerate(templates):
            if not any(words[i : i + len(key)] == key for i in range(len(words))):
                raise ValueError(f"the key phrase {b' '.join(key).decode()!r} isn't in its template")
            for i, w in enumerate(words):
                self.postings[w][t].append(i)
        self.vocabulary = frozenset(self.postings)
        self.idf = idf or {}
        self.base = [(words_of(p), label) for p, label in base.items()]
        self.needed = [frozenset(words) for words, _ in self.base]
        #: No licence phrase is without its key phrase's words; these start the work on a file.
        self.keys = [frozenset(key) for _, key, _ in templates]

    def alignments(self, places: dict[bytes, list[int]], live: set[int]) -> set[tuple[int, int]]:
        """(template, first word of the file at which it may start): starts that the postings of rare words agree on."""
        looked_up: dict[int, list[bytes]] = defaultdict(list)
        open_ = set(live)
        for w in sorted(places, key=lambda w: (-self.idf.get(w, math.inf), w)):
            for t in self.postings[w].keys() & open_:
                looked_up[t].append(w)
                if len(looked_up[t]) == RARE_WORDS:
                    open_.discard(t)
        out = set()
        for t, rare in looked_up.items():
            words = self.templates[t][2]
            slack = max(LEAST_SLACK, int(SLACK * len(words))) if len(words) > 4 else 0
            starts = sorted((p - i, w) for w in rare for i in self.postings[w][t] for p in places[w])
            agree = min(2, len(set(words)))
            first = 0
            for last in range(len(starts)):
                while starts[last][0] - starts[first][0] > slack:
                    first += 1
                if (agree == 1 or any(starts[k][1] != starts[last][1] for k in range(last - 1, first - 1, -1))) and (t, starts[first][0]) not in out:
                    out.add((t, starts[first][0]))
        return out

    def verified(self, words: list[bytes], t: int, start: int) -> float:
        """The alignment's score; 0 where the key phrase isn't there, or only negated."""
        _, key, template = self.templates[t]
        slack = max(LEAST_SLACK, int(SLACK * len(template))) if len(template) > 4 else 0
        low, high = max(0, start - slack), min(len(words), start + len(template) + 2 * slack)
        window = words[low:high]
        for i in range(len(window) - len(key) + 1):
            if window[i] == key[0] and window[i : i + len(key)] == key and NEGATIONS.isdisjoint(words[max(0, low + i - NEGATION_SPAN) : low + i]):
                return in_order(template, window) / len(template)
        return 0.0

    def scan(self, text: str) -> Scan:
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        base = [(phrase, label) for (phrase, label), needed in zip(self.base, self.needed, strict=True) if needed <= present or needed <= set(words)]
        live = {t for t, key in enumerate(self.keys) if key <= present}
        if not base and not live and b"spdx" not in present:
            return Scan(len(words), 0, None, None, [], [], 0.0)
        places: dict[bytes, list[int]] = defaultdict(list)
        wanted = present | {phrase[0] for phrase, _ in base}
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        starts: list[int] = []
        found: set[str] = set()
        for phrase, label in base:
            hits = [p for p in places[phrase[0]] if words[p : p + len(phrase)] == phrase]
            if hits:
                starts += hits
                found.add(label)
        labels, best = set(found), 1.0 if found else 0.0
        tags: set[str] = set()
        for t, start in sorted(self.alignments({w: places[w] for w in present}, live)):
            score = self.verified(words, t, start)
            if score >= LEAST_SCORE:
                label, key, _ = self.templates[t]
                (tags if key[0] == b"identifier" else labels).add(label)
                best = max(best, score)
        if b"spdx" in present:
            # A tag's names are read from its expression, of which a template knows only a beginning.
            named = tagged_labels(text, self.identifiers)
            labels |= tags if named is None else named
            best = max(best, 1.0 if named else 0.0)
        return Scan(len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(found), sorted(labels), best)


def file_idf(docs: DataFrame, vocabulary: frozenset[bytes], text_column: str = "text") -> dict[bytes, float]:
    """IDF over all files of the words of the templates: what is counted and collected has at most as many rows as these."""
    spark = docs.sparkSession
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    found = {bytes(r.word): r.n for r in docs.select(text_of(text_column).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(b"", 0)
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) for w in vocabulary}


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str, str]] | None = None, identifiers: dict[str, str] | None = None, base: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row with its licence labels; one pass counts the templates' words in all files, one scans.

    Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score.  ``notices`` are (label, key phrase, text), ``identifiers`` SPDX names with
    their labels, ``base`` phrases with theirs, counted wherever they stand.  Null
    text: empty (0 words, empty labels, score 0).  Null ids stay null, repeated rows
    are scanned each, an empty table gives an empty result, other columns are not
    looked at.  No text is shuffled.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    templates = templates_of(NOTICES if notices is None else notices, IDENTIFIERS if identifiers is None else identifiers)
    base = BASE_PHRASES if base is None else base
    idf = file_idf(docs, frozenset(w for _, _, words in templates for w in words), text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, base, idf, identifiers)
        for batch in batches:
            found = [index.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([getattr(s, n) for s in found], pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
                    pa.array([",".join(s.base_labels) for s in found], pa.string()),
                    pa.array([",".join(s.labels) for s in found], pa.string()),
                    pa.array([s.score for s in found], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
