"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates are cut into words of letters and digits in lower case, and into shingles
of five words. Templates are cut into pieces; short ones of 5 words, longer ones of 9. Windows
of a text come in two sizes that go with the pieces: 4 shingles (8 words) next to each other,
and 12 shingles (16 words) of which each begins 8 shingles after the one before; so every
piece that occurs lies whole in a window, with a Jaccard similarity of 1/4 or 5/12 at least.
Each window has 32 MinHash values, each a band of its own: a piece is missed with a probability
of at most (3/4) ** 32 = 0.0001. A hit is verified exactly: the share of the template's shingles
that stand within the template's length around the window must be 0.8 or more.

Cases: null, empty and shorter texts have no rows; a text has one row per license found, with
the number of separate places; very long texts are scanned whole; repeated rows each give their
rows; templates of fewer than five words are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import by_bytes, text_of
from lendwell.llm.words import ALNUM, CHUNK_BYTES, shingles, words_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
SHORT_WINDOW, LONG_WINDOW, LONG_STEP = 4, 12, 8  # in shingles
LONG_PIECE = 5  # in shingles
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

# Notices by which well-known licenses are applied.
TEMPLATES: dict[str, str] = {
    "MIT (line)": "Released under the MIT License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "LGPL": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation",
    "AGPL": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
    "published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


class Index:
    """Templates by the MinHash values of their pieces."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        # By window size and band: sorted MinHash values, and the template of each
        found: dict[tuple[bool, int], list[tuple[int, int]]] = {}
        for number, (name, text) in enumerate(templates.items()):
            words = words_of([text], ALNUM)
            own = shingles(words, SHINGLE)[0]
            if not len(own):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.sets.append(np.unique(own))
            self.lengths.append(len(words.hashes))
            long = len(own) >= LONG_PIECE
            size = LONG_PIECE if long else 1
            starts = sorted({*range(0, len(own) - size + 1, size), len(own) - size})
            for start in starts:
                for band in range(BANDS):
                    low = self.permuted(own[start : start + size], band).min()
                    found.setdefault((long, band), []).append((int(low), number))
        self.values: dict[tuple[bool, int], np.ndarray] = {}
        self.numbers: dict[tuple[bool, int], np.ndarray] = {}
        self.first_bits: dict[tuple[bool, int], np.ndarray] = {}
        for key, entries in found.items():
            entries.sort()
            self.values[key] = np.array([v for v, _ in entries], np.uint64)
            self.numbers[key] = np.array([n for _, n in entries])
            self.first_bits[key] = np.zeros(1 << 16, bool)
            self.first_bits[key][self.values[key] >> np.uint64(48)] = True

    def permuted(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return hashes * self.factors[band] + self.terms[band]

    def candidates(self, hashes: np.ndarray, valid: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of a window's first shingle and a template that share a band."""
        pad = -len(hashes) % SHORT_WINDOW + LONG_WINDOW
        held = np.concatenate([hashes, np.zeros(pad, np.uint64)])
        out = np.concatenate([~valid, np.ones(pad, bool)])
        pairs: set[tuple[int, int]] = set()
        for band in range(BANDS):
            values = self.permuted(held, band)
            values[out] = NONE
            short = values.reshape(-1, SHORT_WINDOW).min(axis=1)
            blocks, step = LONG_WINDOW // SHORT_WINDOW, LONG_STEP // SHORT_WINDOW
            count = len(short) - blocks + 1
            long = short[:count:step].copy()
            for i in range(1, blocks):
                np.minimum(long, short[i : i + count : step], out=long)
            for lows, is_long, width in ((short, False, SHORT_WINDOW), (long, True, LONG_STEP)):
                key = (is_long, band)
                if key not in self.values:
                    continue
                near = np.flatnonzero(self.first_bits[key][lows >> np.uint64(48)])
                left = np.searchsorted(self.values[key], lows[near], side="left")
                right = np.searchsorted(self.values[key], lows[near], side="right")
                for at, a, b in zip(near, left, right):
                    pairs.update((int(at) * width, int(n)) for n in self.numbers[key][a:b])
        return pairs


def scanner(templates: Mapping[str, str]):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates)
        for frame in by_bytes(frames, "text", CHUNK_BYTES):
            words = words_of(frame["text"].tolist(), ALNUM)
            hashes, valid = shingles(words, SHINGLE)
            # Places of a template by text: containment and the span of words it was found in
            places: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
            for at, number in sorted(index.candidates(hashes, valid)):
                low, high = max(0, at - index.lengths[number]), at + LONG_WINDOW + index.lengths[number]
                inside = np.flatnonzero(np.isin(hashes[low:high], index.sets[number]) & valid[low:high]) + low
                for doc in np.unique(words.docs[inside]):
                    own = inside[words.docs[inside] == doc]
                    share = len(np.unique(hashes[own])) / len(index.sets[number])
                    if share >= CONTAINMENT:
                        places.setdefault((int(doc), number), []).append((int(own[0]), int(own[-1]), share))
            firsts = np.cumsum(words.counts) - words.counts
            rows = []
            for (doc, number), spans in sorted(places.items()):
                apart, end = 0, -1
                for first, last, _ in sorted(spans):
                    apart, end = apart + (first > end), max(end, last)
                begin = min(s[0] for s in spans) - int(firsts[doc])
                rows.append((doc, index.names[number], apart, begin, max(s[2] for s in spans)))
            out = pd.DataFrame(rows, columns=["doc", "license", "places", "first_word", "containment"])
            out["doc_id"] = frame["doc_id"].to_numpy()[out["doc"].to_numpy(dtype=int)]
            yield out[["doc_id", "license", "places", "first_word", "containment"]]

    return run


def scanned(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, license, places, first_word, containment``: one row per text and license found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    schema = "doc_id long, license string, places long, first_word long, containment double"
    return rows.mapInPandas(scanner(dict(templates)), schema)
