"""Licence scan with a positional index of rare words (operator 11).

Of each template's words those with the highest inverse document frequency, counted over all documents, are its rare words; the index holds
their places in the template. Each text's words are looked up in it; a posting gives where the template would begin in the text.
Places that agree within SLACK words are one candidate, which counts if enough rare words agree and the template's mandatory key phrases stand
inside. Templates and their index are a fixed, small list; texts are scanned once for frequencies and once for matches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import flat, slices, strings

#: Rare words of a template; the share of them that must agree; words that may be put in or left out between them.
RARE, AGREE, SLACK = 6, 0.6, 8
#: Bytes of text that a task scans at a time.
SLICE = 4 << 20

# A word is a run of 0-9, a-z (after lower-casing A-Z) and everything from U+0080.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Phrases that name a licence by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A licence text or notice; all ``phrases`` must stand in a match."""

    name: str
    label: str
    text: str
    phrases: tuple[str, ...]


# Published notices and grants of public licences, with what each of them cannot lack.
TEMPLATES = [
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense", ("permission is hereby granted", "without restriction")),
    Template("mit-notice", "mit", "Released under the MIT License", ("mit license",)),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    Template("gpl-notice", "gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl-grant", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl-notice", "lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("agpl-notice", "agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("bsd-grant", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("isc-grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mpl-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("epl-notice", "epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("unlicense", "unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc0-notice", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "neighboring rights")),
    Template("cc-by-notice", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-short", "cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-short", "cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-short", "cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd-short", "cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
]


def words(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _codes(column: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts behind each other as places in ``known`` (-1: any other word), and where each text's words begin, with the end. One text longer
    than SLICE is cut into words in parts."""
    body, at = flat(column)
    if len(at) > 2 or len(body) <= SLICE:
        return _coded(body, at, known)
    parts, start = [], 0
    while start < len(body):
        stop = start + SLICE
        while stop < len(body) and _KEEP[body[stop]]:
            stop += 1
        part = body[start:stop]
        parts.append(_coded(part, np.array([0, len(part)]), known)[0])
        start = stop
    codes = np.concatenate(parts)
    return codes, np.array([0, len(codes)])


def _coded(body: np.ndarray, at: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keep = _KEEP[body]
    before = np.concatenate([[False], keep[:-1]]) if len(keep) else keep
    before[at[:-1][at[:-1] < len(body)]] = False
    begin = np.flatnonzero(keep & ~before)
    place = np.concatenate([[0], np.cumsum(keep)])
    found = strings(_LOWER[body[keep]], np.append(place[begin], place[-1]))
    codes = pc.index_in(found, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    return codes, np.searchsorted(begin, at)


def _runs(codes: np.ndarray, at: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where a phrase's words stand consecutively in one text: places among all words."""
    n = len(codes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(codes[:n] == phrase[0])
    for k, x in enumerate(phrase[1:], 1):
        found = found[codes[found + k] == x]
    return found[found + len(phrase) <= at[np.searchsorted(at, found, side="right")]]


def vocabulary(templates: list[Template]) -> list[str]:
    """All words of templates and phrases: as long as the list of templates, whatever the corpus."""
    return sorted({w for x in templates for p in (x.text, *x.phrases) for w in words(p)} | {w for p in PHRASES for w in p.split()})


class Index:
    """Postings (template, place, which of its rare words) of each word."""

    def __init__(self, templates: list[Template], frequency: dict[str, int], rare: int = RARE, agree: float = AGREE):
        known = vocabulary(templates)
        code = {w: k for k, w in enumerate(known)}
        self.known, self.templates = pa.array(known, pa.large_string()), templates
        self.need, self.size, self.rare, self.phrases, postings = [], [], [], [], []
        for t, x in enumerate(templates):
            own = words(x.text)
            # the highest inverse document frequency is the smallest document frequency; ties by the word itself
            chosen = sorted(set(own), key=lambda w: (frequency.get(w, 0), w))[:rare]
            postings += [(code[w], t, k, chosen.index(w)) for k, w in enumerate(own) if w in chosen]
            self.need.append(-(-len(chosen) * round(agree * 100) // 100))
            self.size.append(len(own))
            self.rare.append(len(chosen))
            self.phrases.append([tuple(code[w] for w in words(p)) for p in x.phrases])
        self.postings = np.array(sorted(postings), np.int64).reshape(-1, 4)
        self.first = np.searchsorted(self.postings[:, 0], np.arange(len(known) + 1))
        self.base = [(tuple(code[w] for w in p.split()), label) for p, label in PHRASES.items()]

    def hits(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(template, row, word of the row where the template would begin, which rare word) of all words that have postings, sorted."""
        place = np.flatnonzero(codes >= 0)
        low, high = self.first[codes[place]], self.first[codes[place] + 1]
        times = high - low
        found = self.postings[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        place = np.repeat(place, times)
        row = np.searchsorted(at, place, side="right") - 1
        begin = place - at[row] - found[:, 2]
        order = np.lexsort((begin, row, found[:, 1]))
        return found[order, 1], row[order], begin[order], found[order, 3]

    def matches(self, codes: np.ndarray, at: np.ndarray, slack: int = SLACK) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first word, end, score) of each place where enough rare words agree and all key phrases stand."""
        template, row, begin, word = self.hits(codes, at)
        if not len(template):
            return []
        # hits of one template and row up to slack words later: from each hit to its stop
        key = (template * (len(at) + 1) + row) * (1 << 33) + (begin + (1 << 16))
        stop = np.searchsorted(key, key + slack, side="right")
        need = np.array(self.need)[template]
        some = np.flatnonzero(stop - np.arange(len(key)) >= need)
        distinct = np.zeros(len(some), np.int64)
        for k in range(max(self.rare)):
            reach = np.concatenate([[0], np.cumsum(word == k)])
            distinct += reach[stop[some]] > reach[some]
        good = distinct >= need[some]
        some, distinct = some[good], distinct[good]
        runs = {p: _runs(codes, at, p) for t in np.unique(template[some]).tolist() for p in self.phrases[t]}
        out = []
        for t in np.unique(template[some]).tolist():
            of = template[some] == t
            r, b, n = row[some[of]], begin[some[of]], distinct[of]
            low = at[r] + np.maximum(b, 0)
            high = np.minimum(at[r + 1], at[r] + b + slack + self.size[t])
            sure = np.ones(len(r), bool)
            for p in self.phrases[t]:
                next_run = np.append(runs[p], 1 << 62)[np.searchsorted(runs[p], low)]
                sure &= next_run + len(p) <= high
            out += [(x, t, y, z, w / self.rare[t]) for x, y, z, w in zip(r[sure].tolist(), (low - at[r])[sure].tolist(), (high - at[r])[sure].tolist(), n[sure].tolist(), strict=True)]
        return out


def frequencies(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates stands: a row for each of these words, whatever the corpus."""
    known = vocabulary(templates)

    def run(batches):
        values, sums = pa.array(known, pa.large_string()), np.zeros(len(known), np.int64)
        for batch in slices(batches, text, SLICE):
            codes, at = _codes(batch.column(text), values)
            place = np.flatnonzero(codes >= 0)
            row = np.searchsorted(at, place, side="right") - 1
            sums += np.bincount(np.unique(row * len(known) + codes[place]) % len(known), minlength=len(known))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([values.take(pa.array(some)).cast(pa.string()), pa.array(sums[some])], ["word", "n"])

    return {r.word: r.n for r in docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[Template] | None = None, text: str = "text", slack: int = SLACK) -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word and base_labels (places where one of PHRASES stands), ``licences`` (a
    template that matches, its label, the first and the end word of its best match, and its score: the share of its rare words that agree),
    ``labels`` (both kinds, distinct and sorted) and ``score`` (the best of them, 0 without a match).

    Null and empty texts have no words; of equally good matches the first counts; repeated rows stay and count each time; very long texts are cut in
    parts, and matched as a whole; an empty table gives an empty one; an input column named like an added one raises ValueError.
    """
    templates = TEMPLATES if templates is None else templates
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "licences", "labels", "score"]
    if both := set(names) & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    index = Index(templates, frequencies(docs, templates, text))
    kept = [f for f in docs.schema.fields if f.name != text]
    kind = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in slices(batches, text, SLICE):
            codes, at = _codes(batch.column(text), index.known)
            n = batch.num_rows
            count, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            for phrase, label in index.base:
                found = _runs(codes, at, phrase)
                row = np.searchsorted(at, found, side="right") - 1
                count += np.bincount(row, minlength=n)
                np.minimum.at(first, row, found - at[row])
                np.maximum.at(last, row, found - at[row])
                for r in np.unique(row).tolist():
                    base[r].add(label)
            best: list[dict] = [{} for _ in range(n)]
            for r, t, low, high, score in index.matches(codes, at, slack):
                if t not in best[r] or (-score, low) < (-best[r][t][2], best[r][t][0]):
                    best[r][t] = (low, high, score)
            told = [[{"template": templates[t].name, "label": templates[t].label, "start": a, "end": b, "score": x} for t, (a, b, x) in sorted(own.items())] for own in best]
            made = [
                pa.array(np.diff(at), pa.int64()), pa.array(count), pa.array(first, pa.int64(), mask=count == 0), pa.array(last, pa.int64(), mask=count == 0),
                pa.array([",".join(sorted(x)) for x in base]), pa.array(told, kind),
                pa.array([",".join(sorted(x | {y["label"] for y in own})) for x, own in zip(base, told, strict=True)]),
                pa.array([max([0.0, *(y["score"] for y in own)]) for own in told], pa.float64()),
            ]
            own = batch.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [*own.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.mapInArrow(run, ", ".join([*fields, "n_words long, n_base long, first_word long, last_word long, base_labels string, licences array<struct<template:string,label:string,start:long,end:long,score:double>>, labels string, score double"]))
