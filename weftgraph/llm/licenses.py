"""License statements: phrases word by word, and blocks of text that contain a template nearly whole.

Words are runs of [0-9a-z] and characters past ASCII, A-Z lower-cased. Base phrases count wherever their words stand
consecutively. The other labels come from an exact set-similarity join of the text's blocks with templates. A block is any run of
words across line ends; for a template of m words one of ceil(m / threshold) words, so that wrapped notices and ones
with words put in are blocks too. A block takes a template's label if it holds at least ``threshold`` of the template's
distinct words. Template words are ordered by how many documents of the whole table have them, rarest first. A block that
reaches the threshold holds one of a template's first n - ceil(threshold n) + 1 words (prefix filter: only the surroundings of
such words are looked at), enough words at all (length filter), and what is left of the template after its first
match must suffice (positional filter). What passes is counted word by word in a window that slides over the template's words.

Templates are rows (label, text): the fixed list below, a list, or a DataFrame of at most ``MAX_TEMPLATES`` rows, which is counted and
sent to every task; more raise an error.

score: the largest share of a template that a block holds, over blocks that reach the threshold; 1 with a base phrase; else 0.
blocks: the runs that blocks of one template cover together, with their best share. Null text: empty. Null doc_id and
repeated rows: each row is scanned. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import narrow

#: A template table has at most so many rows.
MAX_TEMPLATES = 20_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# License statements in public use, with the labels they take.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("all-rights-reserved", "Copyright. All rights reserved. No part of this publication may be reproduced"),
]


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def template_words(templates=None) -> list[tuple[str, list[bytes]]]:
    """(label, words) of the templates; those without words match nothing and go."""
    if isinstance(templates, DataFrame):
        rows = templates.select("label", "text").where("text is not null").limit(MAX_TEMPLATES + 1).collect()
        if len(rows) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        templates = sorted((r["label"] or "", r["text"]) for r in rows)
    made = [(label, words_of(t.encode("utf-8", "surrogatepass"))) for label, t in templates or TEMPLATES]
    return [(label, words) for label, words in made if words]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each word of the vocabulary (a fixed, small set), over all documents."""
    known = frozenset(vocabulary)

    def run(batches):
        import pyarrow as pa

        seen = defaultdict(int)
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in known.intersection(words_of(t.encode("utf-8", "surrogatepass"))):
                    seen[w] += 1
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    rows = narrow(docs, "text").select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in rows}


class Index:
    """Templates by the words of their prefixes, in the global order."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        every = {w for _, words in templates for w in words}
        self.rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix = [], defaultdict(list)
        for k, (label, words) in enumerate(templates):
            ordered = sorted({self.rank[w] for w in words})
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            width = math.ceil(len(words) / threshold - 1e-9)
            self.templates.append((label, {r: i for i, r in enumerate(ordered)}, need, width))
            for r in ordered[:len(ordered) - need + 1]:
                self.prefix[r].append(k)

    def blocks(self, words) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, best share) of the runs that blocks at the threshold cover, by template and place."""
        rank = self.rank
        held = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
        near = defaultdict(list)
        for i, r in held:
            for k in self.prefix.get(r, ()):
                near[k].append(i)
        out = []
        for k in sorted(near):
            _, places, need, width = self.templates[k]
            own = [(i, places[r]) for i, r in held if r in places]
            if len({at for _, at in own}) >= need:
                out += [(k, *run) for run in self._runs(own, near[k], len(places), need, width)]
        return out

    @staticmethod
    def _runs(own, prefix_at, n: int, need: int, width: int):
        """Runs of one template. own: (word, template place) in order; prefix_at: the words that are of its prefix."""
        at, out = 0, []
        while at < len(prefix_at):
            last = at
            while last + 1 < len(prefix_at) and prefix_at[last + 1] - prefix_at[last] < 2 * width:
                last += 1
            lo, hi = bisect_left(own, (prefix_at[at] - width + 1,)), bisect_left(own, (prefix_at[last] + width,))
            at = last + 1
            distinct = {place for _, place in own[lo:hi]}
            if len(distinct) < need or n - min(distinct) < need:
                continue
            count, left = Counter(), lo
            for right in range(lo, hi):
                i, place = own[right]
                count[place] += 1
                while i - own[left][0] >= width:
                    gone = own[left][1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                    left += 1
                if len(count) >= need:
                    start, share = own[left][0], len(count) / n
                    if out and start < out[-1][1]:
                        out[-1] = (out[-1][0], i + 1, max(share, out[-1][2]))
                    else:
                        out.append((start, i + 1, share))
        return out


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        want = b" " + b" ".join(words_of(phrase.encode())) + b" "
        at, before, nth = joined.find(want), 0, 0
        while at >= 0:
            nth += joined.count(b" ", before, at)
            before = at
            out.append((nth, label))
            at = joined.find(want, at + 1)
    return out


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
BLOCK = "label string, template int, first_word int, end_word int, share double"


def scan(docs: DataFrame, threshold: float = 0.8, phrases=None, templates=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks of each row."""
    phrases, templates = dict(phrases or PHRASES), template_words(templates)
    index = Index(templates, document_frequencies(docs, {w for _, words in templates for w in words}), threshold)

    def run(batches):
        import pyarrow as pa

        fields = [tuple(x.split()) for x in BLOCK.split(", ")]
        kind = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        block = pa.list_(pa.struct([(name, kind[t]) for name, t in fields]))
        kinds = [kind[x.split()[1]] for x in OUT.split(", ")] + [block]
        names = [x.split()[0] for x in OUT.split(", ")] + ["blocks"]
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t.encode("utf-8", "surrogatepass"))
                base, blocks = phrase_places(words, phrases), index.blocks(words)
                labels = {label for _, label in base}
                found = labels | {index.templates[k][0] for k, *_ in blocks}
                score = max([1.0 if base else 0.0, *(share for *_, share in blocks)])
                at = [i for i, _ in base]
                spans = [dict(zip((n for n, _ in fields), (index.templates[k][0], k, s, e, share))) for k, s, e, share in blocks]
                rows.append((d, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(found)), score, spans))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    struct = ", ".join("{}: {}".format(*x.split()) for x in BLOCK.split(", "))
    return narrow(docs, "text").mapInArrow(run, f"{OUT}, blocks array<struct<{struct}>>")
