"""Licence notices in texts: winnowed template fingerprints, then banded alignment.

Templates are word sequences.  Word k-grams of each template are winnowed
(of every few neighbours the one with the least hash stays) into an
inverted index fingerprint -> (template, place).  k and the number of
neighbours follow from the template's length: when words missing from the
text are all that lowers the coverage to ``LEAST``, some run of words is
left that holds an indexed k-gram.  A text's k-grams are looked up; hits on nearby diagonals are a candidate, and a local alignment
in a band around that diagonal gives the words matched, the coverage of the
template and the span in the text.

The templates are the caller's (a bounded dictionary; it travels with the
tasks).  Contract: null, empty and wordless texts have no row; a notice
that occurs twice has two rows, also without a word between; of overlapping
finds of one template the better one stays (ties: the earlier) and the rest
is aligned to the words it leaves; repeated rows are scanned alike; an empty
table or no templates give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchops.llm.common import map_texts, texts

GRAM, WINNOW = 3, 2  # at most
BAND = 8
LEAST = 0.8  # coverage of a template that is reported
_WORD = re.compile(r"\w+")

# Notices as their licences word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                "the following conditions are met",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation",
}


def gram_of(words: int) -> tuple[int, int]:
    """k and winnowing width for a template of so many words."""
    lost = words - int(np.ceil(LEAST * words - 1e-9))  # at most, by a find that is reported
    run = -(-(words - lost) // (lost + 1))  # words left in one piece, at least
    k = max(1, min(GRAM, run))
    return k, max(1, min(WINNOW, run - k + 1))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = [_WORD.findall(templates[n].lower()) for n in self.names]
        self.code = {w: i for i, w in enumerate(sorted(set().union(*words)), 1)} if words else {}
        self.base = len(self.code) + 1
        self.templates = [np.array([self.code[w] for w in ws], np.int64) for ws in words]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by k
        for t, codes in enumerate(self.templates):
            k, winnow = gram_of(len(codes))
            grams = self._grams(codes, k)
            order = [crc32(str(g).encode()) for g in grams.tolist()]
            for lo in range(max(1, len(grams) - winnow + 1) if len(grams) else 0):
                at = min(range(lo, min(lo + winnow, len(grams))), key=lambda i: (order[i], i))
                places = self.index.setdefault(k, {}).setdefault(int(grams[at]), [])
                if (t, at) not in places:
                    places.append((t, at))
        self.known = {k: np.array(sorted(index), np.int64) for k, index in self.index.items()}

    def _grams(self, codes: np.ndarray, k: int) -> np.ndarray:
        """k-gram numbers; -1 where a word is in no template."""
        n = len(codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, foreign = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(k):
            out = out * self.base + codes[i:i + n]
            foreign |= codes[i:i + n] == 0
        return np.where(foreign, -1, out)

    def _codes(self, words) -> np.ndarray:
        get = self.code.get
        return np.array([get(w, 0) for w in words], np.int64)

    def align(self, t: int, codes: np.ndarray, diagonal: int) -> tuple[int, int, int]:
        """(words matched, first, behind last word of the text): best local
        alignment with text place - template place within BAND of diagonal;
        a match scores 2, a word passed over on either side costs 1, and
        words that are taken (-1) end every alignment."""
        none = (0, 0, 0, 0)  # score, matched, first, behind last
        best, row = none, [none] * (2 * BAND + 1)
        for j, word in enumerate(self.templates[t].tolist()):
            new: list[tuple[int, int, int, int]] = []
            for b in range(2 * BAND + 1):
                i = j + diagonal + b - BAND
                cell = none
                if 0 <= i < len(codes) and codes[i] >= 0:
                    if codes[i] == word:  # the same offset one template word earlier
                        s = row[b]
                        cell = (s[0] + 2, s[1] + 1, s[2] if s[1] else i, i + 1)
                    for s in (row[b + 1] if b < 2 * BAND else none, new[b - 1] if b else none):
                        if s[0] - 1 > cell[0]:
                            cell = (s[0] - 1, *s[1:])
                new.append(cell)
                if (cell[1], -(cell[3] - cell[2]), -cell[2]) > (best[1], -(best[3] - best[2]), -best[2]):
                    best = cell
            row = new
        return best[1:]

    def scan(self, text: str) -> list[tuple[str, int, float, int, int]]:
        """(template, words matched, coverage, first character, behind last)."""
        first = self._codes(_WORD.findall(text.lower()))
        if not any(np.isin(self._grams(first, k), known).any() for k, known in self.known.items()):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        codes = self._codes(text[a:b].lower() for a, b in spans)
        seen: dict[int, list[int]] = {}
        for k, known in self.known.items():
            grams = self._grams(codes, k)
            for at in np.flatnonzero(np.isin(grams, known)).tolist():
                for t, place in self.index[k][int(grams[at])]:
                    seen.setdefault(t, []).append(at - place)
        found = []
        for t, diagonals in sorted(seen.items()):
            words, least = codes.copy(), LEAST * len(self.templates[t])
            last, own = None, []
            for d in sorted(set(diagonals)):
                if last is None or d - last > BAND // 2:
                    last = d
                    n, lo, hi = self.align(t, words, d)
                    if n >= least:
                        own.append((-n, lo, hi, d))
            heapify(own)
            while own:
                n, lo, hi, d = heappop(own)
                if (words[lo:hi] >= 0).all():
                    words[lo:hi] = -1
                    found.append((self.names[t], -n, -n / len(self.templates[t]), spans[lo][0], spans[hi - 1][1]))
                n, lo, hi = self.align(t, words, d)  # to the words not taken
                if n >= least:
                    heappush(own, (-n, lo, hi, d))
        return sorted(found, key=lambda f: (f[3], f[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, matched_words, coverage, span_start, span_end): one row for each notice."""
    scanner = Scanner(TEMPLATES if templates is None else templates)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched_words", pa.int64()), ("coverage", pa.float64()),
                        ("span_start", pa.int64()), ("span_end", pa.int64())])

    def run(part: pa.RecordBatch) -> dict:
        rows = [(d, *hit) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in scanner.scan(t)]
        return dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in schema.names}

    return map_texts(texts(docs), run, schema,
                     "doc_id long, license string, matched_words long, coverage double, span_start long, span_end long")
