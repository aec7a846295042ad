"""License scans: an exact set-similarity join of text blocks with license notices.

The templates are a table of notices, as they stand in files, with their labels. Blocks are,
for a template of n words, all runs of 2 n consecutive words of the whole text, across line
breaks (one run where there are no more words); a block's tokens are its distinct words. A
block matches a template if it holds at least THRESHOLD of the template's distinct tokens.
The join is exact and filters as set-similarity joins do, first on the words of the whole
text, which hold those of each block: tokens are ordered by the number of documents that have
them (rarest first); a match must share one of the template's first
|T| - ceil(THRESHOLD |T|) + 1 tokens (prefix), must have ceil(THRESHOLD |T|) tokens (length),
and after the first shared token must still be able to reach that overlap from the tokens
that are left on both sides (position). For what passes, a block slides over the places of
the template's tokens. The templates are a fixed list, so they and the frequencies of their
tokens go to every task.

Besides, phrases are found as consecutive words of the whole text, across lines: those of the
base, whose places are told, and short statements, which only give labels. Statements of a few
words are no templates, since as sets of words they would be met by chance.

Defined results. Null and empty texts have no words, labels or places. Repeated rows are
scanned one by one. A block may match several templates (a notice of a Lesser licence meets
that of the General one), and a document keeps every label once; overlapping blocks that match
one template are one place, with their best containment. The score is 1 where a phrase stands,
else the best containment of a block, else 0. An empty table gives no rows. All asked-for
columns are kept; the result is one struct column whose name gets a number if it is taken.
"""

from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.text import alnum_words, utf8
from quire.plans.staging import fresh

THRESHOLD = 0.8
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Statements by which texts name their license in a few words.
STATEMENTS = {
    "gnu general public license": "gpl", "gnu general public license version 3": "gpl-3", "gnu gpl": "gpl", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "creative commons zero": "cc0", "under the bsd license": "bsd",
}
# Notices as licenses ask for them.
TEMPLATES = {
    "mit": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so""",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "isc": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies"""],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "apache-2": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at http://www.apache.org/licenses/LICENSE-2.0"""],
    "gpl": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version"""],
    "mpl": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at https://mozilla.org/MPL/2.0/"""],
    "unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"""],
    "cc0": ["""To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"""],
    "zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software"""],
}

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.LongType())),
        T.StructField("phrase_labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType())]))),
    ]
)


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[bytes], int]]:
    """(label, distinct tokens, words of a block) of each template."""
    words = [(label, alnum_words(t.encode())) for label, texts in templates.items() for t in texts]
    return [(label, frozenset(w), 2 * len(w)) for label, w in words]


def least_overlap(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


class Index:
    """Prefix postings of the templates, with tokens in the given global order (rarest first)."""

    def __init__(self, sets: list[tuple[str, frozenset[bytes], int]], frequency: dict[bytes, int], threshold: float):
        self.place = {w: k for k, w in enumerate(sorted({w for _, s, _ in sets for w in s}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.postings = [], {}
        for label, tokens, wide in sets:
            if not tokens:
                continue
            order = sorted(tokens, key=self.place.__getitem__)
            need = least_overlap(len(order), threshold)
            k = len(self.templates)
            self.templates.append((label, order, need, wide))
            for i, w in enumerate(order[: len(order) - need + 1]):
                self.postings.setdefault(w, []).append((k, i))

    def matches(self, tokens: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that a set of tokens meets."""
        mine = sorted((w for w in tokens if w in self.place), key=self.place.__getitem__)
        seen, out = set(), []
        for j, w in enumerate(mine):
            for k, i in self.postings.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first shared token: no earlier token of the template is in the block
                _, order, need, _ = self.templates[k]
                if len(tokens) < need or min(len(order) - i, len(mine) - j) < need:
                    continue
                shared = sum(t in tokens for t in order[i:])
                if shared >= need:
                    out.append((k, shared / len(order)))
        return out

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, containment) of every group of overlapping blocks of a text that meet a template."""
        out = []
        for k, _ in self.matches(set(words)):  # a block's words are among the text's
            _, order, need, wide = self.templates[k]
            end = -1
            for first, last, n in slide(words, frozenset(order), need, wide):
                if first <= end:
                    out[-1] = (k, out[-1][1], max(out[-1][2], n / len(order)))
                else:
                    out.append((k, first, n / len(order)))
                end = max(end, last)
        return sorted(out, key=lambda b: (b[1], b[0]))


def slide(words: list[bytes], tokens: frozenset[bytes], need: int, wide: int) -> list[tuple[int, int, int]]:
    """(first, last word, distinct tokens) of the runs of wide words that hold need tokens."""
    held: dict[bytes, int] = {}
    queue: deque[tuple[int, bytes]] = deque()
    out = []
    for p, w in enumerate(words):
        if w not in tokens:
            continue
        queue.append((p, w))
        held[w] = held.get(w, 0) + 1
        while queue[0][0] <= p - wide:
            old = queue.popleft()[1]
            held[old] -= 1
            if not held[old]:
                del held[old]
        if len(held) >= need:
            out.append((queue[0][0], p, len(held)))
    return out


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another."""
    flat, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        look = b" " + phrase + b" "
        at, word, counted = flat.find(look), 0, 0
        while at >= 0:
            word += flat.count(b" ", counted, at)
            counted = at
            out.append((word, label))
            at = flat.find(look, at + 1)
    return sorted(out)


def frequencies(docs: DataFrame, text_col: str, sets: list[tuple[str, frozenset[bytes], int]]) -> dict[bytes, int]:
    """In how many documents each token of the templates stands."""
    wanted = frozenset(w for _, s, _ in sets for w in s)

    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for t in utf8(batch.column(0)):
                for w in wanted.intersection(alnum_words(t)):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    counted = docs.select(text_col).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r.w): r.n for r in counted.collect()}


def scan(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None, statements: dict[str, str] | None = None, threshold: float = THRESHOLD, name: str = "licenses",
) -> tuple[DataFrame, str]:
    """The documents (columns keep, or all) with a struct of n_words, phrase places and labels, all labels and matching blocks."""
    name = fresh(docs.columns, name)
    kept = docs.columns if keep is None else keep
    base = docs.select(*dict.fromkeys([*kept, text_col]))
    sets = template_sets(TEMPLATES if templates is None else templates)
    index = Index(sets, frequencies(docs, text_col, sets), threshold)
    known, named = ({k.encode(): v for k, v in x.items()} for x in (PHRASES if phrases is None else phrases, STATEMENTS if statements is None else statements))
    kind = pa.struct(
        [
            ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("phrase_labels", pa.list_(pa.string())), ("score", pa.float64()), ("labels", pa.list_(pa.string())),
            ("blocks", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
        ]
    )

    def one(raw: bytes | None) -> dict:
        words = alnum_words(raw)
        blocks = [{"word": at, "label": index.templates[t][0], "containment": share} for t, at, share in index.blocks(words)]
        places = phrase_places(words, known)
        base = {label for _, label in places}
        told = base | {label for _, label in phrase_places(words, named)}
        score = 1.0 if told else max((b["containment"] for b in blocks), default=0.0)
        labels = sorted(told | {b["label"] for b in blocks})
        return {"n_words": len(words), "places": [p for p, _ in places], "phrase_labels": sorted(base), "score": score, "labels": labels, "blocks": blocks}

    def run(batches):
        for batch in batches:
            found = pa.array([one(t) for t in utf8(batch.column(text_col))], kind)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*kept, name])

    return base.mapInArrow(run, T.StructType([*[base.schema[c] for c in kept], T.StructField(name, RESULT)])), name


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    found, at = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    r = F.col(at)
    return found.select(
        "doc_id",
        r.n_words.alias("n_words"),
        F.size(r.places).cast("long").alias("n_base"),
        F.array_min(r.places).alias("first_word"),
        F.array_max(r.places).alias("last_word"),
        F.array_join(r.phrase_labels, ",").alias("base_labels"),
        F.array_join(r.labels, ",").alias("labels"),
        r.score.alias("score"),
    )
