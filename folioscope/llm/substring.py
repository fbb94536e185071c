"""Removal of repeated passages by relative Lempel-Ziv parsing over words.

The reference is the corpus itself in order of document and place.  Its index holds, for every window
of 20 words, where the window starts first; it is cut into blocks by the window's anchor, the least
hash of its 6-word grams, so equal windows always meet in one block.  A document is parsed by looking
up its windows from left to right: as long as the source goes on with the document, one factor grows;
where it breaks, the next window starts a new factor with its own source.  Every window is looked up,
also those across factor boundaries, so no repeat is missed there.  A factor of at least 20 words is
a duplicate span.

Only what can repeat is shuffled: consecutive windows with one anchor are one row, and rows whose
anchor occurs once are dropped before window hashes are made.  A window is identified by 128 bits.

Null texts have no words.  Texts shorter than a window are left whole.  Rows without an id are left
whole and are no source.  Rows that share an id count as one document.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bloom import Bloom, split
from folioscope.llm.common import WordHash, blobs, mix64, query, table, text_bytes
from folioscope.session import stage

WINDOW = 20
GRAM = 6
HOT = 1_000_000  # occurrences of an anchor from which its windows go by the pre-aggregated way
CHUNK = 200_000  # words hashed at a time

_P = 0x9E3779B97F4A7C15


def _joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every `size` consecutive values, by doubling."""
    made, width = None, 0
    power, span = hashes, 1
    while size:
        if size & 1:
            if made is None:
                made, width = power, span
            else:
                n = len(hashes) - width - span + 1
                made = made[:n] * np.uint64(pow(_P, span, 1 << 64)) + power[width : width + n]
                width += span
        size >>= 1
        if size:
            n = len(power) - span
            power = power[:n] * np.uint64(pow(_P, span, 1 << 64)) + power[span : span + n]
            span *= 2
    return made


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every `size` consecutive values."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == size else np.minimum(values[: len(values) - (size - span)], values[size - span :])


class Parsed:
    """Windows of some documents: anchors, and for each run of windows with one anchor its extent."""

    def __init__(self, texts: list[bytes], hashes: WordHash, window: int, with_windows: bool):
        words = [text.split() for text in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = hashes.of([w for each in words for w in each])
        self.doc = self.start = self.length = self.anchor = self.hits = np.empty(0, np.int64)
        self.windows = np.empty(0, np.uint64)
        if not len(counts) or len(flat) < window:
            return
        gram = min(GRAM, window)
        grams = mix64(_joined(flat, gram))
        anchors = _least(grams, window - gram + 1)
        first = np.cumsum(counts) - counts
        place = np.arange(len(anchors))
        doc = np.searchsorted(first, place, side="right") - 1
        start = place - first[doc]
        valid = start + window <= counts[doc]
        anchors, doc, start, place = anchors[valid], doc[valid], start[valid], place[valid]
        if not len(anchors):
            return
        fresh = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1]))))
        self.doc, self.start, self.anchor = doc[fresh], start[fresh], anchors[fresh].view(np.int64)
        self.length = np.diff(np.append(fresh, len(anchors)))
        self.at = fresh
        # where the anchor is there twice, as in periodic text, windows may repeat within the run
        spans = self.length + window - gram
        ends = np.cumsum(spans)
        inside = np.arange(ends[-1]) + np.repeat(place[fresh] - ends + spans, spans)
        self.hits = np.add.reduceat((grams[inside] == np.repeat(anchors[fresh], spans)).astype(np.int32), ends - spans)
        if with_windows:
            self.windows = mix64(_joined(flat, window))[valid]


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of a batch that hold some hundred thousand words."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(text_bytes(batch.column(column))):
        texts.append(text)
        size += len(text) // 6
        if size >= CHUNK:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def anchors_of(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, start, hits) for every run of windows with one anchor, which is there `hits` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, texts in _groups(batch, 1):
                made = Parsed(texts, hashes, window, False)
                columns = [made.anchor, ids[first + made.doc], made.start.astype(np.int32)]
                names = ["anchor", "doc_id", "start", "hits"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, made.hits.astype(np.int32))], names)

    return docs.mapInArrow(run, "anchor long, doc_id long, start int, hits int")


def _occurrences(docs: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, start, hashes): the windows of the runs that start at `starts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, wanted = np.asarray(batch.column(0)), batch.column(2)
            for first, texts in _groups(batch, 1):
                made = Parsed(texts, hashes, window, True)
                lists = [np.asarray(wanted[first + i].values).astype(np.int64) for i in range(len(texts))]
                asked = np.concatenate([(i << 40) + starts for i, starts in enumerate(lists)])
                take = np.flatnonzero(np.isin((made.doc << 40) + made.start, asked))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(made.anchor[take]),
                        pa.array(ids[first + made.doc[take]]),
                        pa.array(made.start[take].astype(np.int32)),
                        blobs([made.windows[made.at[i] : made.at[i] + made.length[i]] for i in take]),
                    ],
                    ["anchor", "doc_id", "start", "hashes"],
                )

    grouped = stage(starts.groupBy("doc_id").agg(F.collect_list("start").alias("starts")), "starts")
    bloom = Bloom(grouped, "doc_id", grouped.count())
    _, maybe = split(docs, F.col("doc_id"), bloom, "may_repeat")
    joined = maybe.join(grouped, "doc_id").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "anchor long, doc_id long, start int, hashes binary")


_FACTOR = "doc_id long, start int, length int, source_id long, source_start int"


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse runs that come by anchor, then document and place: each window goes to where it is first."""
    block, index = None, {}
    for batch in batches:
        made = []
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for anchor, doc, start, windows in zip(*columns, batch.column(3)):
            if anchor != block:
                block, index = anchor, {}
            source, size, begin = None, 0, 0
            for place, window in enumerate(memoryview(windows.as_buffer()).cast("Q"), start):
                here = (doc, place)
                found = index.setdefault(window, here)
                if found == here:
                    found = None
                if size and (found is None or found[0] != source[0] or found[1] - source[1] not in (size, 0)):
                    made.append((doc, begin, size, *source))
                    size = 0
                if found is not None:
                    if not size:
                        source, begin = found, place
                    size += 1
            if size:
                made.append((doc, begin, size, *source))
        columns = list(zip(*made)) if made else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names = ["doc_id", "start", "length", "source_id", "source_start"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _hot_factors(occurrences: DataFrame) -> DataFrame:
    """The same for anchors with very many occurrences, one row per window, without gathering a block.

    The first place of a window is an aggregate that combines before its shuffle; the join with it has
    one row per window on its small side, so adaptive execution can split the large one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(w) // 8 for w in batch.column(3).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            anchor, doc, start = (np.asarray(batch.column(i)) for i in range(3))
            columns = [anchor[row], flat, doc[row], (start[row] + step).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "window", "doc_id", "start"])

    windows = occurrences.mapInArrow(run, "anchor long, window long, doc_id long, start int")
    first = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    again = windows.join(first, ["anchor", "window"]).filter(F.struct("doc_id", "start") != F.col("first"))
    return again.select(
        "doc_id", "start", F.lit(1).alias("length"), F.col("first.doc_id").alias("source_id"),
        F.col("first.start").alias("source_start"),
    )


def factors(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT
) -> DataFrame:
    """Factors with an earlier source: doc_id, start, length, source_id, source_start.

    `length` counts the windows that start in the factor, so it covers `length + window - 1` words.
    """
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull())
    anchors = anchors_of(docs, window)
    counts = anchors.groupBy("anchor").agg(F.sum("hits").alias("occurrences")).filter("occurrences > 1")
    counts = stage(counts, "anchors")
    common = counts.filter(F.col("occurrences") > hot)

    def starts(repeated: DataFrame) -> DataFrame:
        return anchors.join(repeated.select("anchor"), "anchor").select("doc_id", "start")

    usual = _occurrences(docs, starts(counts.filter(F.col("occurrences") <= hot)), window)
    blocks = usual.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    found = blocks.mapInArrow(_factors, _FACTOR)
    if not common.isEmpty():
        found = found.unionByName(_hot_factors(_occurrences(docs, starts(common), window)))
    return found


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT
) -> DataFrame:
    """One row per row of `df`: doc_id, n_words, n_removed, kept_text (kept words joined by a space).

    A word goes if a window of `window` words that covers it starts earlier elsewhere: in a document
    with a smaller id or before it in the same document.  Windows are judged on the input.  Documents
    without factors pass straight through; only the others are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2) if batch.num_columns > 2 else None
            total, gone, kept = [], [], []
            for row, whole in enumerate(text_bytes(batch.column(1))):
                words = whole.split()
                total.append(len(words))
                if spans is not None and len(words) >= window:
                    begins = np.asarray(spans[row].values.field(0)).astype(np.int64)
                    ends = begins + np.asarray(spans[row].values.field(1)) + window - 1
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, np.minimum(begins, len(words)), 1)
                    np.add.at(edges, np.minimum(ends, len(words)), -1)
                    stay = np.cumsum(edges[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            kept_text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, kept_text], ["doc_id", "n_words", "n_removed", "kept_text"])

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = factors(df, id_column, text, window, hot).groupBy("doc_id")
    found = stage(found.agg(F.collect_list(F.struct("start", "length")).alias("spans")), "spans")
    bloom = Bloom(found, "doc_id", found.count())
    whole, maybe = split(docs, F.coalesce("doc_id", F.lit(-1)), bloom, "may_repeat")
    nothing = F.expr("CAST(array() AS array<struct<start:int,length:int>>)")
    maybe = maybe.join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", nothing).alias("spans"))
    return whole.mapInArrow(run, schema).unionByName(maybe.mapInArrow(run, schema))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
