"""Licence recognition by sentences: known sentences get identifiers, and identifier sequences match ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encode import batches

#: Known sentences by name, as licences print them.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
#: Licence, and the names its sentences must have one after the other. Where rules begin at one sentence, the first that fits.
RULES = [
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")), ("MIT", ("mit-grant", "mit-condition")), ("MIT", ("mit-title",)), ("MIT", ("mit-title-the",)), ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-licensed",)),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-url")), ("Apache-2.0", ("apache-header", "apache-use")), ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")), ("GPL-3.0-only", ("gpl3-notice",)), ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl2-version")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)), ("MPL-2.0", ("mpl-header",)), ("CC-BY-4.0", ("cc-by",)), ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)), ("all-rights-reserved", ("reserved",)),
]
_BREAK = re.compile(r"\n+|(?<=[.!?;:])[^\w\n]*\s+")
_WORD = re.compile(r"[^\W_]+")
#: What a list item begins with: "1.", "(2)", "b)", "iv.".
_MARKER = re.compile(r"[^\w\n]*(?:\d{1,3}|[a-z]|[ivx]{1,5})[.):\]]+(?:[^\w\n]*\s+|\W*$)")


def normal(sentence: str) -> str:
    """Lower-cased words with single spaces: marks, bullets and line ends don't count."""
    return " ".join(_WORD.findall(sentence.lower()))


class Rules:
    """Sentences and rules made ready for scanning."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]]):
        self.known = {normal(s): name for name, s in sentences.items()}
        self.beginnings = {k[:i] for k in self.known for i in range(1, len(k) + 1) if k[i : i + 1] in ("", " ")}
        # a sentence can stand in a text only if its longest word does
        self.anchors = sorted({max(k.split(), key=len) for k in self.known}, key=len)
        self.anchors = [a for i, a in enumerate(self.anchors) if not any(b in a for b in self.anchors[:i])]
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for licence, names in rules:
            self.by_first.setdefault(names[0], []).append((licence, names))

    def sentences(self, text: str | None) -> list[str | None]:
        """Names of a whole text's sentences in order, None for each run of others; lines may wrap known sentences."""
        if not text:
            return []
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        units, marks = [], []
        for s in _BREAK.split(low):
            if m := _MARKER.match(s):
                units.append(normal(m[0]))
                marks.append(True)
                s = s[m.end() :]
            if u := normal(s):
                units.append(u)
                marks.append(False)
        out: list[str | None] = []
        i = 0
        while i < len(units):
            name, taken, joined = None, 1, ""
            for j in range(i, len(units)):  # the longest run of units that is a known sentence
                joined = f"{joined} {units[j]}" if joined else units[j]
                if joined not in self.beginnings:
                    break
                if joined in self.known:
                    name, taken = self.known[joined], j - i + 1
            if name is not None or not marks[i] and (not out or out[-1] is not None):
                out.append(name)
            i += taken
        return out

    def licences(self, names: list[str | None]) -> list[str]:
        """Licences whose rules the sequence holds, in order of where they begin, each once."""
        out: list[str] = []
        i = 0
        while i < len(names):
            step = 1
            for licence, rule in self.by_first.get(names[i] or "", ()):
                if tuple(names[i : i + len(rule)]) == rule:
                    step = len(rule)
                    if licence not in out:
                        out.append(licence)
                    break
            i += step
        return out


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences array<string> (known sentences in order) and licences array<string> of every whole text.

    Sentences end at lines and after marks; a known sentence may run over any number of such units. A rule fits where
    its sentences follow each other with no other text between; list markers are no text. Null and empty texts, and texts with no known sentence, have
    empty arrays. Repeated rows give rows each; null ids stay; other columns are ignored. Nothing is shuffled.
    """
    made = Rules(sentences, rules)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())
        for b in parts:
            for at, texts in batches(b.column(1)):
                names = [made.sentences(t.as_py()) for t in texts]
                found = [made.licences(n) for n in names]
                names = [[x for x in n if x is not None] for n in names]
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(names, lists), pa.array(found, lists)], ["doc_id", "sentences", "licences"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, sentences array<string>, licences array<string>")
