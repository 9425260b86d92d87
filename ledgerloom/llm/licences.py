"""License scans: phrases in word order, and an exact set-similarity join of text blocks with templates.

A block (a line of a text, a run of up to ``JOINED`` lines, or, for notices wrapped over more lines, any lines) meets a template if it holds at least
THRESHOLD of the template's distinct words among as many words, one after the other, as the template has and a quarter more: what stands far apart in a
long line is no notice. The join is exact and filtered: words are ordered
by how many documents hold them, rarest first, counted over the whole corpus; a block that meets a template must
hold one of its first words (prefix filter), must have enough words at all (length filter), and from the place
of the first common word on enough words must be left (positional filter). Only what passes is counted.
Templates are a parameter of fixed size (MOST_WORDS), so every task holds their index.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .texts import plain, raw

#: Phrases that are looked for as they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of usual notices, with the labels of the method.
TEMPLATES = {
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "apache-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "copyright": "Copyright (c) All rights reserved",
}
THRESHOLD = 0.8
JOINED = 3
MOST_WORDS = 100_000


def _template_words(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    words = {label: frozenset(plain(text.encode())) for label, text in templates.items()}
    if sum(map(len, words.values())) > MOST_WORDS:
        raise ValueError(f"templates hold more than {MOST_WORDS} words; give them in several calls")
    return {label: w for label, w in words.items() if w}


def _counts(docs: Iterator[pa.RecordBatch], known: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    held = dict.fromkeys(sorted(known), 0)
    for batch in docs:
        for text in raw(batch, "text"):
            for w in known.intersection(plain(text)):
                held[w] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "docs"])


def order(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """Documents that hold each template word, over all of ``docs``: at most MOST_WORDS numbers."""
    known = frozenset().union(*_template_words(templates).values())
    rows = docs.select("text").mapInArrow(partial(_counts, known=known), "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return dict.fromkeys(known, 0) | {bytes(r["word"]): r["docs"] for r in rows}


class Templates:
    """Sorted templates with their prefix index."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.sets = {label: tuple(sorted(words, key=self.rank.__getitem__)) for label, words in _template_words(templates).items()}
        self.need = {label: max(1, math.ceil(threshold * len(words) - 1e-9)) for label, words in self.sets.items()}
        self.span = {label: math.ceil(len(plain(templates[label].encode())) / threshold) for label in self.sets}
        self.prefix: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for label, words in self.sets.items():
            for i, w in enumerate(words[: len(words) - self.need[label] + 1]):
                self.prefix[w].append((label, i))
        self.first = frozenset(self.prefix)

    def dense(self, words: list[bytes], label: str) -> int:
        """The most of a template's distinct words that stand within its span of words."""
        wanted, span, counts, hits, left, best = frozenset(self.sets[label]), self.span[label], defaultdict(int), [], 0, 0
        for p, w in enumerate(words):
            if w in wanted:
                hits.append((p, w))
                counts[w] += 1
                while hits[left][0] <= p - span:
                    first = hits[left][1]
                    counts[first] -= 1
                    if not counts[first]:
                        del counts[first]
                    left += 1
                best = max(best, len(counts))
        return best

    def met(self, block: set[bytes], lines: Sequence[list[bytes]] = ()) -> Iterator[tuple[str, float]]:
        """(label, share of its words) for each template that the block meets: its distinct words, and all of them, line by line, to tell how far apart they stand."""
        firsts: dict[str, int] = {}
        for w in block & self.first:
            for label, i in self.prefix[w]:
                firsts[label] = min(firsts.get(label, i), i)
        for label, i in firsts.items():
            words, need = self.sets[label], self.need[label]
            if len(block) < need or len(words) - i < need:
                continue
            common = sum(w in block for w in words[i:])
            if common >= need and sum(map(len, lines)) > self.span[label]:
                common = self.dense([w for line in lines for w in line], label)
            if common >= need:
                yield label, common / len(words)


def _blocks(words: list[list[bytes]], templates: Templates) -> list[tuple[str, int, int, float]]:
    """(label, line, lines, share) of the least runs of lines that meet a template; share: the best of the runs around."""
    runs, lines = {}, [set(x) for x in words]
    for n in range(1, JOINED + 1):
        for i in range(len(lines) - n + 1):
            runs[i, n] = {}
            if lines[i] and lines[i + n - 1] and any(not templates.first.isdisjoint(x) for x in lines[i : i + n]):
                runs[i, n] = dict(templates.met(set().union(*lines[i : i + n]), words[i : i + n]))
    out = []
    for (i, n), met in runs.items():
        for label in met:
            if n == 1 or label not in runs[i, n - 1] and label not in runs[i + 1, n - 1]:
                around = [runs[j, m][label] for m in range(n, JOINED + 1) for j in range(i + n - m, i + 1) if label in runs.get((j, m), ())]
                out.append((label, i, n, max(around)))
    return sorted(out)


def _wrapped(lines: list[list[bytes]], templates: Templates, found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Blocks of more than JOINED lines, of windows of ``span`` words, that have no other block of the label inside; share: the best window around."""
    flat = [(i, w) for i, line in enumerate(lines) for w in line]
    every, out = {w for _, w in flat}, []
    for label, words in templates.sets.items():
        need, span, wanted = templates.need[label], templates.span[label], frozenset(words)
        if len(every & wanted) < need:
            continue
        hits = [(p, i, w) for p, (i, w) in enumerate(flat) if w in wanted]
        passes: list[list[tuple[int, int, int]]] = []  # (first line, last line, words): both lines never fall inside a pass
        for least in (False, True):  # whole windows; then without what their start can spare
            counts, left, own = defaultdict(int), 0, []
            for p, i, w in hits:
                counts[w] += 1
                while hits[left][0] <= p - span or least and (counts[hits[left][2]] > 1 or len(counts) > need):
                    first = hits[left][2]
                    counts[first] -= 1
                    if not counts[first]:
                        del counts[first]
                    left += 1
                if len(counts) >= need:
                    own.append((hits[left][1], i, len(counts)))
            passes.append(own)
        runs = {(a, b, 1) for own in passes for a, b, _ in own} | {(i, i + n - 1, 0) for own, i, n, _ in found if own == label}
        ends = len(lines)  # the least last line of the runs that begin here or later
        for a, b, fresh in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
            if fresh and b < ends and b - a >= JOINED:
                around = [n for own in passes for x, y, n in own[bisect_left(own, b, key=lambda r: r[1]) : bisect_right(own, a, key=lambda r: r[0])]]
                out.append((label, a, b - a + 1, max(around) / len(words)))
            ends = min(ends, b)
    return out


def _scan(docs: Iterator[pa.RecordBatch], templates: Templates, phrases: dict[bytes, str]) -> Iterator[pa.RecordBatch]:
    heads = frozenset(p.split()[0] for p in phrases)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]
    place = pa.struct([("label", pa.string()), ("line", pa.int64()), ("lines", pa.int64()), ("share", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(place)]
    for batch in docs:
        out: list[list] = [[] for _ in kinds]
        for text in raw(batch, "text"):
            words = plain(text)
            starts, labels, blocks = [], set(), []
            if not heads.isdisjoint(words):
                line = b" " + b" ".join(words) + b" "
                for phrase, label in phrases.items():
                    at, place, seen = line.find(b" " + phrase + b" "), 0, 0
                    while at >= 0:
                        place, seen = place + line.count(b" ", seen, at), at
                        starts.append(place)
                        labels.add(label)
                        at = line.find(b" " + phrase + b" ", at + 1)
            if not templates.first.isdisjoint(words):
                lines = [plain(x) for x in (text or b"").split(b"\n")]
                blocks = _blocks(lines, templates)
                if len(lines) > JOINED:
                    blocks = sorted(blocks + _wrapped(lines, templates, blocks))
            row = [len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), [dict(zip(("label", "line", "lines", "share"), b, strict=True)) for b in blocks]]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, blocks (label, line, lines, share) per row of ``docs``.

    Phrases are found wherever their words stand one after the other, whatever is between them; places are
    words from 0. A null text has no words and no blocks. Notices wrapped over any number of lines are found. A run of lines is told only if no shorter run inside
    it meets the template. Time is linear in a text, however long. Repeated rows are scanned one by one; an empty table gives no rows; other columns don't matter.
    """
    templates = TEMPLATES if templates is None else templates
    index = Templates(templates, order(docs.select(docs["text"]), templates), threshold)
    phrases = {p.encode(): label for p, label in PHRASES.items()}
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(partial(_scan, templates=index, phrases=phrases), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<label:string,line:long,lines:long,share:double>>")


def digests(found: DataFrame) -> DataFrame:
    own = F.transform("blocks", lambda b: b["label"])
    labels = F.array_join(F.sort_array(F.array_union("base_labels", own)), ",")
    score = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), F.greatest(score, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return digests(scan(table(spark, sf_dir, "documents")))


def _sql() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sets = {k: sorted(w.decode() for w in v) for k, v in _template_words(TEMPLATES).items()}
    span = {k: math.ceil(len(plain(TEMPLATES[k].encode())) / THRESHOLD) for k in sets}
    rows = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}], {max(1, math.ceil(THRESHOLD * len(v) - 1e-9))}, {span[k]})" for k, v in sets.items())
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH t(label, words, need, span) AS (VALUES {rows}),
b(phrase, label, n) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all({low.format("coalesce(text, '')")}, {word}) AS w, string_split({low.format("coalesce(text, '')")}, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, label, i - 1 AS at_word FROM (SELECT doc_id, w, label, phrase, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, b)
      WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
pb AS (SELECT doc_id, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
r AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT doc_id, regexp_extract_all(array_to_string(list_slice(lines, i, i + n - 1), ' '), {word}) AS w FROM r, (VALUES (1), (2), (3)) AS e(n) WHERE i + n - 1 <= len(lines)),
c AS (SELECT doc_id, label, words, need, CASE WHEN len(w) <= span THEN len(list_intersect(words, w)) ELSE list_max(list_transform(range(1, len(w) - span + 2), lambda i: len(list_intersect(words, list_slice(w, i, i + span - 1))))) END AS n FROM k, t WHERE len(list_intersect(words, w)) >= need),
m AS (SELECT doc_id, label, max(n / len(words)) AS share FROM c WHERE n >= need GROUP BY doc_id, label),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM p) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN pb USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP2_SQL = _sql()
