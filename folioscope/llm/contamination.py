"""Benchmark decontamination by the q-gram lemma.

A benchmark text of m characters that occurs in a document with at most k edits shares at least
m - q + 1 - k q of its q-grams with it, on diagonals (place in the document less place in the item)
that differ by at most k.  Shared q-grams are counted in overlapping bands of diagonals; bands that
reach the bound are aligned within the band, and those of at most k edits are matches.

Texts are compared in lower case with runs of blanks as one space; offsets refer to the text as given,
in code points.  The benchmark is the query set: it is taken in blocks of bounded size, one pass over
the documents each, and only the index of a block goes to the tasks.

Null and empty texts match nothing, on either side; nor do items of fewer than `q` characters.  Of
several places of an item in a document the one with the fewest edits counts, then the first.  Equal
items match alike.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import mix64, query, table

Q = 8
PERCENT = 10  # edits per hundred characters of the item
BLOCK_CHARS = 4_000_000  # of the benchmark in one pass
CHUNK = 400_000  # characters of documents at a time
TABLE_BITS = 22

FOLDED = 0x1F000  # no code point from here on has another case or is a blank
_LOWER = np.arange(FOLDED, dtype=np.uint32)
_BLANK = np.zeros(FOLDED, bool)
for _c in range(FOLDED):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
    _BLANK[_c] = chr(_c).isspace()


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with runs of blanks as one space, and their places in `text`."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = codes < FOLDED
    small = np.where(low, codes, 0)
    codes = np.where(low, _LOWER[small], codes)
    blank = _BLANK[small] & low
    keep = np.flatnonzero(~(blank & np.concatenate(([False], blank[:-1]))))
    return np.where(blank, np.uint32(32), codes)[keep], keep


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q consecutive code points."""
    n = len(codes) - q + 1
    made = np.zeros(max(n, 0), np.uint64)
    for i in range(q if n > 0 else 0):
        made = made * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return mix64(made)


class Items:
    """q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, percent: int):
        self.q = q
        made = [(key, normal(text)[0]) for key, text in items]
        made = [(key, codes) for key, codes in made if len(codes) >= q]
        self.keys = [key for key, _ in made]
        self.codes = [codes for _, codes in made]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        # as many edits as the share allows, but no more than leave one q-gram that must be shared
        self.edits = np.minimum(sizes * percent // 100, (sizes - q) // q)
        self.bound = sizes - q + 1 - self.edits * q
        self.gap = int(self.edits.max(initial=0)) + 1
        self.width = self.gap  # of half a band: any span of at most k + 1 diagonals lies in one band
        all_grams = [grams(c, q) for c in self.codes]
        flat = np.concatenate(all_grams) if made else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(made)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if made else item
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[flat >> np.uint64(64 - TABLE_BITS)] = True

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """[item, first diagonal of the band] of bands that reach the bound."""
        hashed = grams(codes, self.q)
        at = np.flatnonzero(self.table[hashed >> np.uint64(64 - TABLE_BITS)])
        slot = np.searchsorted(self.grams, hashed[at])
        slot[slot == len(self.grams)] = 0
        real = self.grams[slot] == hashed[at] if len(self.grams) else np.zeros(0, bool)
        at, slot = at[real], slot[real]
        if not len(at):
            return np.empty((0, 2), np.int64)
        times = self.count[slot]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(self.first[slot], times) + inner
        item = self.item[where]
        half = (np.repeat(at, times) - self.place[where]) // self.width
        key, shared = np.unique((item << 40) + half + (1 << 32), return_counts=True)  # halves may be negative
        item, half = key >> 40, (key & ((1 << 40) - 1)) - (1 << 32)
        # a band is two halves: this one and the next, or this one alone after an empty one
        after = np.zeros(len(key), np.int64)
        same = key[1:] == key[:-1] + 1
        after[:-1][same] = shared[1:][same]
        lone = np.concatenate(([True], ~same)) if len(key) else np.empty(0, bool)
        bands = [np.stack((item, half * self.width), 1)[shared + after >= self.bound[item]]]
        bands.append(np.stack((item, (half - 1) * self.width), 1)[lone & (shared >= self.bound[item])])
        return np.unique(np.concatenate(bands), axis=0)

    def align(self, codes: np.ndarray, item: int, lows: np.ndarray) -> list[tuple[int, int, int]]:
        """(edits, start, end) of the best place of `item` in each band that begins at `lows`.

        One row per character of the item, one cell per diagonal.  A cell holds edits and start in one
        number, so that the least number has the fewest edits and then the first start.
        """
        pattern, edits = self.codes[item], int(self.edits[item])
        lows = lows - edits
        band, size = 2 * self.width + 2 * edits, len(pattern)
        step, far = 1 << 32, 1 << 52
        reach = lows[:, None] + np.arange(band + size)
        inside = (reach >= 0) & (reach < len(codes))
        seen = np.where(inside, codes[np.clip(reach, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
        # a verbatim place needs no alignment
        same = (np.lib.stride_tricks.sliding_window_view(seen, size, axis=1)[:, :band] == pattern).all(axis=2)
        plain = same.any(axis=1)
        found = [(0, int(b), int(b) + size) for b in lows[plain] + same[plain].argmax(axis=1)]
        if plain.all():
            return found
        lows, reach, seen = lows[~plain], reach[~plain], seen[~plain]
        slope = np.arange(band) * step
        # one cell more at the right, which no alignment passes
        cell = np.full((len(lows), band + 1), far, np.int64)
        first = reach[:, :band]
        cell[:, :band] = np.where(first >= 0, np.minimum(first, len(codes)), far)
        work = np.empty((len(lows), band), np.int64)
        for i, code in enumerate(pattern):
            np.multiply(seen[:, i : i + band] != code, step, out=work)
            work += cell[:, :band]
            np.minimum(work, cell[:, 1:] + step, out=work)
            work -= slope
            np.minimum.accumulate(work, axis=1, out=work)
            work += slope
            cell[:, :band] = work
        best = np.argmin(work, axis=1)
        value = work[np.arange(len(lows)), best]
        ends = np.minimum(lows + best + size, len(codes))
        return found + [(int(v >> 32), int(v & 0xFFFFFFFF), int(e)) for v, e in zip(value, ends)]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, key of the item, start, end, edits), one row per text and item."""
        if not self.keys:
            return
        parts, starts, places, size = [], [], [], 0
        # longer than the widest band, so that no band holds places of two texts
        gap = np.zeros(4 * self.gap + self.q, np.uint32)
        for text in texts:
            codes, place = normal(text)
            starts.append(size)
            places.append(place)
            parts += [codes, gap]
            size += len(codes) + len(gap)
        flat = np.concatenate(parts)
        found = self.candidates(flat)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item in np.unique(found[:, 0]):
            lows = found[found[:, 0] == item, 1]
            for some in (lows[i : i + 512] for i in range(0, len(lows), 512)):
                for edits, start, end in self.align(flat, item, some):
                    if edits <= self.edits[item]:
                        text = int(np.searchsorted(starts, start, side="right")) - 1
                        one = (edits, start - starts[text], end - starts[text])
                        best[text, item] = min(one, best.get((text, item), one))
        for (text, item), (edits, start, end) in sorted(best.items()):
            place = places[text]
            end = min(end, len(place))
            yield text, self.keys[item], int(place[start]), int(place[end - 1]) + 1, edits


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, texts, size = 0, [], 0
    for row, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(item).cast("long").alias("key"), F.col(text).alias("text"))
    items = items.filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == block
        yield [(row.key, row.text) for row in items.filter(mine).collect()]


def find_passages(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, item_id, start, end, edits of every benchmark text found in a document."""
    spark = df.sparkSession
    schema = "doc_id long, item_id long, start int, end int, edits int"
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text):
        found = found.unionByName(docs.mapInArrow(_search(Items(block, q, percent)), schema))
    return found


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (first + text, *match)
                for first, texts in _parts(batch.column(1))
                for text, *match in items.matches(texts)
            ]
            columns = list(zip(*rows)) if rows else [()] * 5
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            made = [ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "item_id", "start", "end", "edits"])

    return run


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    percent: int = PERCENT,
) -> DataFrame:
    """`df` without the rows that hold a benchmark text; decided in the scan, without a shuffle."""
    at = df.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text):
        items = Items(block, q, percent)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                for first, texts in _parts(batch.column(at)):
                    stay[[first + match[0] for match in items.matches(texts)]] = False
                yield batch.filter(pa.array(stay))

        df = df.mapInArrow(run, df.schema)
    return df


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
