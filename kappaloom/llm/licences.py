"""Licence scans with a positional index of rare words.

The index holds, for the rarest words of each template's mandatory key phrase, the templates and where in the phrase they stand. A
first pass counts in how many documents each licence word occurs. A document's
licence words of the highest inverse document frequency are then looked up, the rarest first; every
posting says where its key phrase would begin, the places that a template's words tell are intersected, and at those that are left
the key phrase is verified word by word. A verified place is scored by the share of the whole template that
stands around it, a few added or missing words apart.

The rarest word of every key phrase that a document has is always looked up, whatever its rank. So no place is missed, however many
rare words there are, and the result depends on the documents' frequencies by the scores' weights alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Wording of well-known notices and licences; label, wording, and the key phrase in it that must stand whole.
NOTICES = (
    ("agpl", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license"),
    ("apache", "spdx license identifier apache 2 0", "apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided by the copyright holders and contributors as is"),
    ("bsd", "spdx license identifier bsd", "license identifier bsd"),
    ("boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt", "boost software license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under the creative commons zero public domain dedication", "commons zero"),
    ("copyright", "copyright c", "copyright c"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("no-warranty", "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "without any warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "in no event will the authors be held liable"),
)
#: Words of a key phrase in the index; words of a document that are looked up, beside the rarest of each key phrase.
POSTED, RAREST = 4, 16
#: Words that may be added or missing between two that agree; words that must agree for a score of one half, at full agreement.
SLACK, HALF = 4, 3

SPACED = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words in lower case, as UTF-8: runs of ASCII letters and digits and of all other characters.

    >>> words_of("All RIGHTS-reserved, é")
    [b'all', b'rights', b'reserved', b'\\xc3\\xa9']
    """
    return (text or "").encode("utf-8", "surrogatepass").translate(SPACED).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key_at: int
    key: tuple[bytes, ...]
    base: bool


def _templates() -> list[Template]:
    out = []
    for phrase, label in BASE:
        words = tuple(phrase.encode().split())
        out.append(Template(label, words, 0, words, True))
    for label, notice, key in NOTICES:
        words, part = tuple(notice.encode().split()), tuple(key.encode().split())
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        out.append(Template(label, words, at, part, False))
    return out


TEMPLATES = _templates()
VOCABULARY = frozenset(w for t in TEMPLATES for w in t.words)


def agreeing(template: tuple[bytes, ...], words: list[bytes], i: int, j: int, step: int) -> Iterator[int]:
    """Places of the template, from i on by step, whose words stand in the same order from place j of the text on, with SLACK words in between at most."""
    while 0 <= i < len(template) and 0 <= j < len(words):
        skips = ((a, n - a) for n in range(SLACK + 1) for a in range(n + 1))
        for a, b in skips:
            p, q = i + step * a, j + step * b
            if 0 <= p < len(template) and 0 <= q < len(words) and template[p] == words[q]:
                yield p
                i, j = p + step, q + step
                break
        else:
            return


class Index:
    """Positional postings of the key phrases' rare words, by the words' document frequencies."""

    def __init__(self, frequencies: dict[bytes, int], documents: int, rarest: int = RAREST) -> None:
        self.idf = {w: math.log((1 + documents) / (1 + frequencies.get(w, 0))) + 1 for w in VOCABULARY}
        self.rarest = rarest
        #: By word: the templates with the word in their key phrase and how far the phrase begins from it.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: By template: the rarest word of its key phrase.
        self.anchors: list[bytes] = []
        for k, t in enumerate(TEMPLATES):
            order = sorted(range(len(t.key)), key=lambda i: (-self.idf[t.key[i]], i))
            self.anchors.append(t.key[order[0]])
            for i in order[:POSTED]:
                self.postings[t.key[i]].append((k, -i))
        self.always = frozenset(self.anchors)
        self.whole = [sum(self.idf[w] for w in t.words) for t in TEMPLATES]

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, where its key phrase begins), verified, in order of template and place."""
        at: dict[bytes, list[int]] = defaultdict(list)
        postings = self.postings
        for i, w in enumerate(words):
            if w in postings:
                at[w].append(i)
        if not at:
            return []
        ranked = sorted(at, key=lambda w: (-self.idf[w], w))
        asked = dict.fromkeys([*ranked[: self.rarest], *(w for w in ranked if w in self.always)])
        begins: dict[int, set[int]] = {}
        for w in asked:
            for k, shift in postings[w]:
                # what an asked word of the key phrase does not allow falls out; a template enters with its rarest word
                if w == self.anchors[k] and k not in begins:
                    begins[k] = {i + shift for i in at[w]}
                elif k in begins:
                    begins[k] &= {i + shift for i in at[w]}
        return [(k, i) for k, found in sorted(begins.items()) for i in sorted(found) if i >= 0 and tuple(words[i : i + len(TEMPLATES[k].key)]) == TEMPLATES[k].key]

    def score(self, words: list[bytes], k: int, at: int) -> float:
        """From 0 to 1: the share of the template's IDF that stands around a place, the lower the fewer words that is."""
        t = TEMPLATES[k]
        got = set(range(t.key_at, t.key_at + len(t.key)))
        got.update(agreeing(t.words, words, t.key_at - 1, at - 1, -1), agreeing(t.words, words, t.key_at + len(t.key), at + len(t.key), 1))
        return sum(self.idf[t.words[i]] for i in sorted(got)) / self.whole[k] * len(got) / (len(got) + HALF)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def describe(words: list[bytes], index: Index) -> tuple:
    found = index.places(words)
    base = [(TEMPLATES[k].label, at) for k, at in found if TEMPLATES[k].base]
    places = [at for _, at in base]
    return (
        len(words),
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted({x for x, _ in base})),
        ",".join(sorted({TEMPLATES[k].label for k, _ in found})),
        round(max((index.score(words, k, at) for k, at in found), default=0.0), 6),
    )


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and the number of documents. At most one row a word comes to the driver."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[bytes, int] = defaultdict(int)
        rows = 0
        for part in parts:
            for text in part["text"]:
                rows += 1
                for w in VOCABULARY.intersection(words_of(text)):
                    n[w] += 1
        yield pd.DataFrame([("", rows), *((w.decode(), k) for w, k in n.items())], columns=["word", "n"])

    found = docs.select(F.col(text_column).cast("string").alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r.word.encode(): r.n for r in found.collect()}
    return got, got.pop(b"", 0)


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rarest: int = RAREST) -> DataFrame:
    """(doc_id, SCHEMA) for every row.

    labels are those of the templates whose key phrase stands in the text, the base ones among them. score is the highest of their places:
    near 1 for a whole licence, low for a short phrase. A null text is empty: no words, no places, null first and last word, empty
    labels, score 0. Null ids, repeated rows and other columns, whatever their names, do not matter, nor do ties of words' frequencies; texts of any length
    are scanned whole; an empty table gives an empty result.
    """
    index = Index(*document_frequencies(docs, text_column), rarest=rarest)

    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame([describe(words_of(t), index) for t in part], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    scanned = F.pandas_udf(scan, SCHEMA)
    return docs.select(F.col(id_column).alias("doc_id"), scanned(F.col(text_column).cast("string")).alias("found")).select("doc_id", "found.*")
