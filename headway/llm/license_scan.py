"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from headway.llm.common import SHINGLE_WORDS, SIMILARITY, random_table, text_chunks, words

#: A template inside a window escapes retrieval with this probability at most.
MISS = 1e-9

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0/disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT/short": "Released under the MIT License.",
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL/or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def _row_shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one text; of fewer words, one of all."""
    k = min(SHINGLE_WORDS, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    m = len(hashes) - k + 1
    x = hashes[:m].copy()
    for i in range(1, k):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    return x ^ (x >> np.uint64(32))


class Band:
    """Templates of u/2 < size <= u shingles; windows of 2u shingles every u, so that each template lies whole in one.

    One value a band: a window that holds the share c of a template of q shingles has a Jaccard similarity of at
    least ``c q / (2u + (1 - c) q)``, so ``n`` independent minima all differ with probability ``(1 - J) ** n``.
    """

    def __init__(self, upper: int, templates: dict[str, np.ndarray], containment: float):
        self.upper, self.names = upper, sorted(templates)
        self.sets = [np.unique(templates[n]) for n in self.names]
        q = min(len(s) for s in self.sets)
        need = math.ceil(containment * q)
        jaccard = need / (2 * upper + q - need)
        self.n = math.ceil(math.log(MISS) / math.log(1 - jaccard)) if jaccard < 1 else 1
        self.factor = random_table(self.n, 7) | np.uint64(1)
        self.minima = np.array([(s[:, None] * self.factor).min(axis=0) for s in self.sets])

    def candidates(self, hashes: np.ndarray, hashed: np.ndarray) -> list[tuple[int, int]]:
        """(window, template) pairs with an equal minimum; ``hashed`` has a column for each function."""
        u = self.upper
        least = np.minimum.reduceat(hashed[:, : self.n], np.arange(0, len(hashes), u), axis=0)
        least[:-1] = np.minimum(least[:-1], least[1:])
        return [(int(w), t) for t in range(len(self.names)) for w in np.flatnonzero((least == self.minima[t]).any(axis=1))]


def bands_of(templates: dict[str, str], containment: float) -> list[Band]:
    sized: dict[int, dict[str, np.ndarray]] = {}
    for name, text in templates.items():
        data = np.frombuffer(text.encode(), np.uint8)
        s = _row_shingles(words(data, np.array([0, len(data)]), alnum=True)[2])
        if len(s):
            sized.setdefault(1 << (len(np.unique(s)) - 1).bit_length(), {})[name] = s
    return [Band(u, of, containment) for u, of in sorted(sized.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = SIMILARITY) -> DataFrame:
    """``doc_id, license, n_shingles, n_found, first_byte, last_byte``: the templates that a window of a text contains.

    Texts are cut into words of letters and digits, lower-cased in ASCII, and five-word shingles. For each size of
    templates, windows of twice that size overlap by half; a window and a template with an equal MinHash value are a
    candidate, and the number of functions is set so that a contained template is missed with probability MISS at
    most. Verification counts the template's shingles in the window exactly. Of a template's windows in a document the
    fullest counts, the first of equals; the bytes are those of the window's first to last shared shingle.

    Null and empty texts contain nothing; every row of ``docs`` is scanned on its own. The templates are a parameter
    of a few kB, part of the closure.
    """
    bands = bands_of(TEMPLATES if templates is None else templates, containment)
    overlap = 4 * max((b.upper for b in bands), default=1)
    block = max(4096, 4 * overlap)
    functions = max((b.factor for b in bands), key=len, default=np.zeros(0, np.uint64))
    schema = "doc_id long, license string, n_shingles long, n_found long, first_byte long, last_byte long"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id")
            for first, data, offsets in text_chunks(batch.column("text")):
                starts, ends, hashes = words(data, offsets, alnum=True)
                edges = np.searchsorted(starts, offsets)
                for r in range(len(offsets) - 1):
                    a, b = edges[r], edges[r + 1]
                    s = _row_shingles(hashes[a:b])
                    best: dict[str, tuple] = {}
                    for lo in range(0, len(s), block - overlap):
                        part = s[lo : lo + block]
                        hashed = part[:, None] * functions
                        for band in bands:
                            for w, t in band.candidates(part, hashed):
                                window = part[w * band.upper : (w + 2) * band.upper]
                                shared = np.flatnonzero(np.isin(window, band.sets[t]))
                                found = len(np.unique(window[shared]))
                                name, q = band.names[t], len(band.sets[t])
                                if found and found >= containment * q and found > best.get(name, (0, 0))[1]:
                                    at = lo + w * band.upper
                                    head, tail = a + at + shared[0], a + min(at + shared[-1] + SHINGLE_WORDS, b - a) - 1
                                    best[name] = (q, found, int(starts[head] - offsets[r]), int(ends[tail] - offsets[r]))
                        if lo + block >= len(s):
                            break
                    out += [(ids[first + r].as_py(), name, *x) for name, x in sorted(best.items())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), *[pa.int64()] * 4], strict=True)], ["doc_id", "license", "n_shingles", "n_found", "first_byte", "last_byte"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
