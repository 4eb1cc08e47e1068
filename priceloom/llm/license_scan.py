"""Operator 5: license scans by an exact set-similarity join of text blocks and license templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A block is a window of
``WINDOW`` words, starting at every half window, so a passage of half a window's length lies wholly in one.
Templates of more than half a window have blocks of their own: the window is doubled until half of it holds them.
A block holds a template if at least ``THRESHOLD`` of the template's distinct words are in it.

One pass counts, over all documents, how many hold each template word; rarest first is the global
token order.  Then, for a template of n words that must share k = ceil(THRESHOLD * n):

* prefix filter: a block must hold one of the n - k + 1 rarest words of the template,
* length filter: it must have k different words of the templates' vocabulary,
* positional filter: after the first shared word, enough words of either side must be left,

and the survivors are counted exactly.  The template side is a constant of this module, so
documents are scanned in place and only word counts are shuffled.

Base phrases are found where their words stand consecutively.  So are ``NOTICES``, which are too short for
a share of their words to mean anything; of those that start at one word the longest counts, as a block
with share 1 that starts there.  ``score``: 1 with a base phrase, otherwise the largest share of a template in a block that meets the threshold, otherwise 0.
Words are compared by their XXH64.

Null or empty text: no words, no labels, score 0.  Very long texts are scanned whole; a task then holds some 12
bytes for each of the text's.  Ties: of blocks with equal shares each is listed; of equally frequent words
the one with the lesser hash comes first.  Repeated rows are judged alike.  An empty table gives an empty table,
no templates only the base labels.  The given columns stay in ``row``, so no name can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, THRESHOLD = 256, 0.8

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The notices of public licenses, by label; each of at most half a window.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License. To view a copy of this license, visit or send a letter to Creative Commons, Mountain View, California, USA.",
}

#: Short notices, by their words; versions and openings tell them from other uses of the letters.
NOTICES = {
    words: f"cc-{kind.replace(' ', '-')}"
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
    for words in (*(f"{verb} under {the}cc {kind}" for verb in ("licensed", "released", "available", "distributed") for the in ("", "a ", "the ")), *(f"cc {kind} {v}" for v in ("1 0", "2 0", "2 5", "3 0", "4 0")))
}

IS_WORD = ~C._table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
FIELDS = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("blocks", "array<struct<label:string,first_word:bigint,shared:double>>")]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(word, text number, place in its text) of every word; and the number of words of each text."""
    flat = C.Flat(texts)
    data = C.ASCII_LOWER[flat.data]
    starts, ends, owner = flat.runs(IS_WORD[data])
    n_words = C.sums_by(owner, flat.n)
    place = np.arange(len(owner)) - (np.cumsum(n_words) - n_words)[owner]
    return C.packed(data, starts, ends), owner, place, n_words


class Words:
    """The words that are looked for, numbered: equal bytes, and only those, share a number."""

    def __init__(self, texts: list[str]):
        self.held = pc.unique(split_words(pa.array(texts, pa.string()))[0])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word; -1 of others."""
        code, different = C.numbered(words)
        return pc.index_in(different, value_set=self.held).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code]

    def of(self, text: str) -> np.ndarray:
        return self.numbers(split_words(pa.array([text]))[0])


def stands(words: np.ndarray, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where ``words`` stand consecutively within one text."""
    k = len(words)
    at = np.flatnonzero(h[: max(0, len(h) - k + 1)] == words[0])
    for x in range(1, k):
        at = at[h[at + x] == words[x]]
    return at[owner[at] == owner[at + k - 1]]


class Vocabulary:
    """The words of the templates, by number."""

    def __init__(self, templates: dict[str, str]):
        self.labels = list(templates)
        self.all = Words([*templates.values(), *PHRASES, *NOTICES])
        self.sets = [np.unique(self.all.of(t)) for t in templates.values()]
        self.lengths = [len(self.all.of(t)) for t in templates.values()]
        self.words = np.unique(np.concatenate([*self.sets, np.zeros(0, np.int64)]))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        if not len(self.words):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[k] == h, k, -1)


class Join:
    """Templates with their words in the global order, and the filters that follow from it."""

    def __init__(self, vocabulary: Vocabulary, frequency: dict[int, int], threshold: float):
        self.vocabulary = vocabulary
        n = len(vocabulary.words)
        order = np.lexsort((np.arange(n), [frequency.get(i, 0) for i in range(n)]))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.sets = [np.sort(self.rank[vocabulary.find(s)]) for s in vocabulary.sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        #: asks[template, rank]: the word is in the template's prefix
        self.asks = np.zeros((len(self.sets), n), bool)
        for t, (s, k) in enumerate(zip(self.sets, self.need)):
            self.asks[t, s[: len(s) - k + 1]] = True

    def shared(self, t: int, block: np.ndarray) -> float:
        """The share of template t in a block, given as its sorted ranks; 0 below the threshold."""
        s, k = self.sets[t], self.need[t]
        if len(block) < k:
            return 0.0
        both = np.intersect1d(s, block, assume_unique=True)
        if not len(both):
            return 0.0
        left = min(len(s) - np.searchsorted(s, both[0]), len(block) - np.searchsorted(block, both[0]))
        return len(both) / len(s) if left >= k and len(both) >= k else 0.0


def frequencies(df: DataFrame, text: str, vocabulary: Vocabulary) -> dict[int, int]:
    """For each template word, the number of documents that hold it."""

    def count(batches):
        n = len(vocabulary.words)
        total = np.zeros(n, np.int64)
        for batch in batches:
            for part in C.chunks(batch, "text"):
                words, owner, _, _ = split_words(part.column(0))
                k = vocabulary.find(vocabulary.all.numbers(words))
                seen = np.unique(owner[k >= 0] * n + k[k >= 0])
                total += np.bincount(seen % max(n, 1), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    counts = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "word bigint, n bigint")
    return {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each template word


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, window: int | None = None) -> DataFrame:
    """``row`` (struct of ``keep``) with FIELDS; ``blocks`` lists every block that holds a template; ``window``: for all templates alike."""
    vocabulary = Vocabulary(TEMPLATES if templates is None else templates)
    join = Join(vocabulary, frequencies(df, text, vocabulary), threshold)
    tokens = vocabulary.all.of
    phrases = [(tokens(p), label) for p, label in PHRASES.items()]
    notices = sorted(((tokens(w), label) for w, label in (NOTICES if templates is None else {}).items()), key=lambda x: -len(x[0]))
    short_cc = tokens("cc")[0]
    sizes: dict[int, list[int]] = {}  # half a window: the templates that it holds
    for t, body in enumerate(vocabulary.lengths):
        step = (window or WINDOW) // 2
        while window is None and step < body:
            step *= 2
        sizes.setdefault(step, []).append(t)

    def run(_, texts):
        words, owner, place, n_words = split_words(texts)
        h, n = vocabulary.all.numbers(words), len(texts)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
        base: list[set] = [set() for _ in range(n)]
        for words, label in phrases:
            at = stands(words, h, owner)
            n_base += C.sums_by(owner[at], n)
            np.minimum.at(first, owner[at], place[at])
            np.maximum.at(last, owner[at], place[at])
            for d in np.unique(owner[at]):
                base[d].add(label)

        known = vocabulary.find(h)
        at = np.flatnonzero(known >= 0)
        held: list[list] = [[] for _ in range(n)]
        for step, chosen in sizes.items():
            asks = join.asks[chosen]
            rank, doc, block = join.rank[known[at]], owner[at], place[at] // step
            final = np.maximum(0, -(-n_words[doc] // step) - 2)  # number of the last block
            rows = np.concatenate([np.stack([doc, np.minimum(b, final), rank], 1)[b >= 0] for b in (block, block - 1)])
            if not len(rows) or not asks.any(0)[rows[:, 2]].any():
                continue
            rows = np.unique(rows, axis=0)
            where = rows[:, 0] * (rows[:, 1].max() + 1) + rows[:, 1]
            for x in np.unique(where[asks.any(0)[rows[:, 2]]]):
                a, z = np.searchsorted(where, [x, x + 1])
                ranks = rows[a:z, 2]
                for t in np.array(chosen)[asks[:, ranks].any(1)]:
                    if share := join.shared(t, ranks):
                        held[rows[a, 0]].append({"label": vocabulary.labels[t], "first_word": int(rows[a, 1]) * step, "shared": share})
        if (h == short_cc).any():  # every notice holds this word
            taken: set = set()
            for words, label in notices:  # the longest first
                for x in stands(words, h, owner).tolist():
                    if x not in taken:
                        taken.add(x)
                        held[owner[x]].append({"label": label, "first_word": int(place[x]), "shared": 1.0})
        none = n_base == 0
        return {
            "n_words": n_words, "n_base": n_base,
            "first_word": pa.array(first, pa.int64(), mask=none), "last_word": pa.array(last, pa.int64(), mask=none),
            "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b | {x["label"] for x in m})) for b, m in zip(base, held)],
            "score": [1.0 if b else max((x["shared"] for x in m), default=0.0) for b, m in zip(base, held)],
            "blocks": pa.array(held, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("shared", pa.float64())]))),
        }

    return C.map_texts(df, text, keep or df.columns, run, FIELDS)
