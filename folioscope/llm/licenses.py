"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Texts are taken as words in lower case, ASCII signs as blanks.  Templates and documents are cut into
windows of 5, 8, 12 and 20 words at every offset; a template gives windows of the largest of these
sizes that fits it.  A window's minima under 16 hashes of its 5-word shingles make 8 bands of 2.  Equal
windows always meet; windows of similarity 0.8 share a band with probability 1 - 0.36^8 = 0.9997, of
0.6 with 0.97.  Where a document's window meets a template's, the place of the whole template follows,
and the share of its distinct shingles found there is counted exactly.

The templates are a short fixed list and broadcast.  One pass over the documents, without a shuffle.

Null and empty texts hold nothing.  Of overlapping finds the one with the greatest share counts, then
that of the longest template, then the first.  Templates of fewer than 5 words are ignored.  Repeated rows give
repeated finds.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import WordHash, mix64, query, table, text_bytes

SHINGLE = 5
SIZES = (5, 8, 12, 20)
BANDS, ROWS = 8, 2
CONTAINMENT = 0.8
SLACK = 0.2  # of the template's length, before and after its expected place
CHUNK = 200_000
TABLE_BITS = 16

# fixed values: public license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    "BSD": "Licensed under the BSD 3-Clause License.",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation""",
    "LGPL": "Licensed under the GNU Lesser General Public License",
    "AGPL": "Licensed under the GNU Affero General Public License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD_BYTES).split()


def shingles(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - SHINGLE + 1
    made = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE if n > 0 else 0):
        made = made * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    return mix64(made)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == size else np.minimum(values[: len(values) - (size - span)], values[size - span :])


def window_keys(marks: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """One array of keys per band, over all windows of `size` words of consecutive shingles."""
    count = size - SHINGLE + 1
    if len(marks) < count:
        return
    short = (marks >> np.uint64(32)).astype(np.uint32)
    for band in range(BANDS):
        key = None
        for row in range(band * ROWS, (band + 1) * ROWS):
            seed = (0x9E3779B1 * (2 * row + 1)) & 0xFFFFFFFF
            least = _least((short ^ np.uint32(seed >> 7)) * np.uint32(seed | 1), count).astype(np.uint64)
            key = least if key is None else (key << np.uint64(32)) ^ least
        yield mix64(key + np.uint64(size * BANDS + band))


class Index:
    """Bands of the windows of all templates."""

    def __init__(self, templates: dict[str, str]):
        hashes = WordHash()
        words = {name: hashes.of(plain_words(text.encode())) for name, text in templates.items()}
        self.names = [name for name, ids in words.items() if len(ids) >= SHINGLE]
        self.sizes = [len(words[name]) for name in self.names]
        self.marks = [np.unique(shingles(words[name])) for name in self.names]
        keys, owner, offset = [], [], []
        self.used = sorted({max(s for s in SIZES if s <= n) for n in self.sizes})
        for i, name in enumerate(self.names):
            size = max(s for s in SIZES if s <= self.sizes[i])
            for found in window_keys(shingles(words[name]), size):
                keys.append(found)
                owner.append(np.full(len(found), i))
                offset.append(np.arange(len(found)))
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys = flat[order]
        self.owner = np.concatenate(owner)[order] if keys else order
        self.offset = np.concatenate(offset)[order] if keys else order
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True

    def _candidates(self, marks: np.ndarray) -> np.ndarray:
        """[template, expected first word] for every window that meets a template's."""
        found = [np.empty((0, 2), np.int64)]
        for size in self.used:
            for keys in window_keys(marks, size):
                at = np.flatnonzero(self.table[keys >> np.uint64(64 - TABLE_BITS)])
                low, high = (np.searchsorted(self.keys, keys[at], side) for side in ("left", "right"))
                times = high - low
                inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                where = np.repeat(low, times) + inner
                found.append(np.stack((self.owner[where], np.repeat(at, times) - self.offset[where]), 1))
        return np.unique(np.concatenate(found), axis=0)

    def finds(self, texts: list[bytes], hashes: WordHash) -> Iterator[tuple[int, str, int, int, float]]:
        """(number of the text, license, first word, end, containment)."""
        words = [plain_words(text) for text in texts]
        counts = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(counts) - counts
        flat = hashes.of([w for each in words for w in each])
        marks = shingles(flat)
        places: dict[int, list[tuple[float, int, int, int, int]]] = {}
        for template, place in self._candidates(marks).tolist():
            size, want = self.sizes[template], self.marks[template]
            doc = int(np.searchsorted(first, max(place, 0) + size // 2, side="right")) - 1
            slack = int(size * SLACK)
            low = max(place - slack, int(first[doc]))
            high = min(place + size + slack, int(first[doc] + counts[doc]))
            if high - low < SHINGLE:
                continue
            hits = np.flatnonzero(np.isin(marks[low : high - SHINGLE + 1], want))
            share = len(np.unique(marks[low + hits])) / len(want)
            if share >= CONTAINMENT:
                begin, end = low + int(hits[0]) - int(first[doc]), low + int(hits[-1]) + SHINGLE - int(first[doc])
                places.setdefault(doc, []).append((-share, -size, begin, end, template))
        for doc, found in sorted(places.items()):
            taken: list[tuple[int, int]] = []
            for share, _, begin, end, template in sorted(found):
                if all(end <= b or begin >= e for b, e in taken):
                    taken.append((begin, end))
                    yield doc, self.names[template], begin, end, -share


def find_licenses(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None
) -> DataFrame:
    """doc_id, license, first_word, end_word, containment of every notice found in a document."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows, texts, first, size = [], [], 0, 0
            for row, text in enumerate(text_bytes(batch.column(1))):
                texts.append(text)
                size += len(text) // 6
                if size >= CHUNK or row + 1 == batch.num_rows:
                    rows += [(first + doc, *find) for doc, *find in index.finds(texts, hashes)]
                    texts, first, size = [], row + 1, 0
            columns = list(zip(*rows)) if rows else [()] * 5
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            made = [ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]]
            names = ["doc_id", "license", "first_word", "end_word", "containment"]
            yield pa.RecordBatch.from_arrays(made, names)

    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, license string, first_word long, end_word long, containment double")


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
