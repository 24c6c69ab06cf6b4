"""License scan: exact set-similarity join of text blocks with license templates.

A template is the set of its words.  The text blocks are the runs of twice as
many words as the template's text has, at every word of a text.  A block meets
a template when it holds at least the threshold's share of its words.  Template
words are put in one global order, rarest in the corpus first.  A block that
meets the template must hold one of its first n - need + 1 words (prefix
filter), so only blocks around these are looked at.  They must hold ``need``
distinct words together (length filter); while the words are compared in
that order, they are given up as soon as the words still to come can't make up
for those missed (positional filter).  What is left is slid over word by word,
so every block that meets the threshold is found, wherever it starts.

A place that meets a template gives its label when a block there holds the
words that tell the template from others (``mit``, ``lesser``), unless a place
of a similar template with another label covers it with more words.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.text import alnum_words, raw_texts

THRESHOLD = 0.8

# Phrases and labels that are always reported.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public notices by label, and the words without which a text is another notice.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction", ""),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation", "gnu general public"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "creative commons attribution"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("bsd", "Released under the BSD License.", "bsd"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", ""),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0.", "mozilla public"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted", ""),
)


def corpus_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """How often each template word occurs in all texts; counted in the tasks, a row per word and batch is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                total.update([w for w in alnum_words(raw) if w in vocabulary])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
        )

    rows = docs.select(F.col(text_col)).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}  # at most the template words


class Template:
    def __init__(
        self, number: int, label: str, text: str, counts: dict[bytes, int], threshold: float, telling: str = ""
    ) -> None:
        self.number, self.label = number, label
        tokens = alnum_words(text.encode())
        self.width = 2 * len(tokens)  # words of a block
        self.words = set(tokens)
        self.order = sorted(self.words, key=lambda w: (counts.get(w, 0), w))
        self.n = len(self.order)
        self.need = max(1, ceil(threshold * self.n - 1e-9))
        self.prefix = self.order[: self.n - self.need + 1]
        self.telling = set(alnum_words(telling.encode()))
        self.rivals: set[int] = set()  # templates of other labels that hold the threshold's share of its words

    def can_meet(self, words: set[bytes]) -> bool:
        """Whether the words hold enough of the template's."""
        if len(words) < self.need:
            return False
        missed = 0
        for w in self.order:
            if w not in words:
                missed += 1
                if self.n - missed < self.need:
                    return False
        return True


@dataclass
class Place:
    """Blocks that meet a template and overlap, cut to the template's words."""

    template: Template
    first: int
    last: int
    matched: int  # most words of the template in a block
    tells: bool  # a block holds all telling words
    core: tuple[int, int]  # the shortest run with the most words, of blocks with all telling words if there are any

    @property
    def rank(self) -> tuple:
        return self.tells, self.matched, self.core[0] - self.core[1]


def ready_templates(templates: tuple[tuple[str, str, str], ...], counts: dict[bytes, int], threshold: float) -> list[Template]:
    out = [Template(k, label, text, counts, threshold, telling) for k, (label, text, telling) in enumerate(templates)]
    for t in out:
        t.rivals = {u.number for u in out if u.label != t.label and len(t.words & u.words) >= t.need}
    return out


def base_places(tokens: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase."""
    joined = b" " + b" ".join(tokens) + b" "
    found = []
    for phrase, label in BASE:
        wanted = f" {phrase} ".encode()
        at = joined.find(wanted)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(wanted, at + 1)
    return found


def slide(tokens: list[bytes], lo: int, hi: int, t: Template) -> list[Place]:
    """Places in tokens[lo:hi]; for each end the block is cut to the shortest run with as many of the template's words."""
    at: deque[int] = deque()
    count: Counter = Counter()
    out: list[Place] = []
    for i in range(lo, hi):
        if tokens[i] not in t.words:
            continue
        at.append(i)
        count[tokens[i]] += 1
        # A first word that stands again later adds nothing to this block, nor to one that ends later.
        while i - at[0] >= t.width or count[tokens[at[0]]] > 1:
            w = tokens[at.popleft()]
            count[w] -= 1
            if not count[w]:
                del count[w]
        if len(count) >= t.need:
            found = Place(t, at[0], i, len(count), t.telling <= count.keys(), (at[0], i))
            if out and out[-1].last >= found.first:
                best = max(out[-1], found, key=lambda p: p.rank)
                found = Place(t, min(out[-1].first, found.first), i, max(out[-1].matched, found.matched), best.tells, best.core)
                out.pop()
            out.append(found)
    return out


def template_places(tokens: list[bytes], templates: list[Template], by_word: dict[bytes, list[int]]) -> list[Place]:
    """Places of all blocks that meet a template; those of a template that overlap are one."""
    around: dict[int, list[list[int]]] = {}
    for i, w in enumerate(tokens):
        if w in by_word:
            for k in by_word[w]:
                reach = templates[k].width - 1
                parts = around.setdefault(k, [])
                if parts and parts[-1][1] >= i - reach:
                    parts[-1][1] = i + reach + 1
                else:
                    parts.append([max(0, i - reach), i + reach + 1])
    out: list[Place] = []
    for k in sorted(around):
        for lo, hi in around[k]:
            hi = min(hi, len(tokens))
            if templates[k].can_meet(set(tokens[lo:hi])):
                out += slide(tokens, lo, hi, templates[k])
    return out


def gives_label(place: Place, places: list[Place]) -> bool:
    """Whether a place names its license; see the module's text."""
    return place.tells and not any(
        q.tells and q.template.number in place.template.rivals and q.matched > place.matched
        and q.core[0] <= place.core[0] and place.core[1] <= q.core[1]
        for q in places
    )


PLACE = pa.list_(pa.struct([
    ("template", pa.int64()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("share", pa.float64()), ("named", pa.bool_()),
]))
ROW = (
    "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, places array<struct<template:bigint,label:string,first_word:bigint,last_word:bigint,share:double,named:boolean>>"
)


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, *, id_col: str = "doc_id",
    text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: words, base places, labels, score and the places of templates.

    ``places`` holds every place that meets a template, ``named`` where it gives
    its label.  The score is the largest share of a template at a place that
    names its license, 1 where a base phrase stands, 0 where nothing is found.
    A template's telling words may be empty: then every place names it.  Null and empty texts have no
    words, empty labels and score 0; null ids and repeated rows are kept;
    other columns are ignored; an empty table gives an empty one.
    """
    vocabulary = {w for _, text, _ in templates for w in alnum_words(text.encode())}
    counts = corpus_counts(docs, vocabulary, text_col)
    ready = ready_templates(templates, counts, threshold)
    by_word: dict[bytes, list[int]] = {}
    for k, t in enumerate(ready):
        for w in t.prefix:
            by_word.setdefault(w, []).append(k)

    def row(raw: bytes) -> tuple:
        tokens = alnum_words(raw)
        base = base_places(tokens)
        places = template_places(tokens, ready, by_word)
        labels = {label for _, label in base}
        named = [gives_label(p, places) for p in places]
        every = labels | {p.template.label for p, yes in zip(places, named) if yes}
        score = 1.0 if base else max((p.matched / p.template.n for p, yes in zip(places, named) if yes), default=0.0)
        starts = [s for s, _ in base]
        return (
            len(tokens), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(every)), score,
            [
                {"template": p.template.number, "label": p.template.label, "first_word": p.first, "last_word": p.last,
                 "share": p.matched / p.template.n, "named": yes}
                for p, yes in zip(places, named)
            ],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), PLACE]
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(row(raw) for raw in raw_texts(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names
                )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ROW)
