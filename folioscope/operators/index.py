"""Sparse and dense index tables.

The sparse index is chunk-major: one row per chunk with its terms and weights as arrays.
Counting happens inside the row's own task, so n-grams are never shuffled; only per-task
partial counts of the vocabulary are.  `postings` gives the long form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.session import MAX_BROADCAST_TERMS, fits, stage

WORD_CACHE = 200_000
FLUSH_TERMS = 500_000
SLICE_ROWS = 512  # texts that a task works on at once, with
SLICE_CHARS = 1 << 18  # characters at most, or one text
CODE_POINTS = 0x110000
UNKNOWN = 0xFFFF  # number of a character that no term of a vocabulary has


def char_ngrams(text: Column, low: int = 2, high: int = 4, lower: bool = True) -> Column:
    """All character n-grams inside word bounds, each word padded by one space.

    Pure column form.  Words are set two spaces apart, so an n-gram is any run of n
    characters that is never space-space; the look-ahead yields overlapping matches and
    the trailing dot consumes one code point.
    """
    flat = F.btrim(F.regexp_replace(text, f"[{lx.SPACE_CLASS}]+", "  "), F.lit(" "))
    padded = F.concat(F.lit(" "), F.lower(flat) if lower else flat, F.lit(" "))
    parts = []
    for n in range(low, high + 1):
        shapes = [f"[^ ]{{{n}}}", f" [^ ]{{{n - 1}}}", f"[^ ]{{{n - 1}}} "]
        if n > 2:
            shapes.append(f" [^ ]{{{n - 2}}} ")
        parts.append(F.regexp_extract_all(padded, F.lit(f"(?s)(?=({'|'.join(shapes)}))."), F.lit(1)))
    return F.concat(*parts)


def ngrams_of(word: str, low: int = 2, high: int = 4) -> list[str]:
    wide = f" {word} "
    return [wide[i : i + n] for n in range(low, high + 1) for i in range(len(wide) - n + 1)]


class Grams:
    """Positions of the n-grams of texts, remembered per word."""

    def __init__(self, position: Callable[[str], int | None], lower: bool):
        self.position, self.lower = position, lower
        self.words: dict[str, np.ndarray] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted positions of all n-grams of a text, repeats included."""
        parts = []
        for word in ((text or "").lower() if self.lower else text or "").split():
            at = self.words.get(word)
            if at is None:
                if len(self.words) >= WORD_CACHE:
                    self.words.clear()
                known = [i for i in map(self.position, ngrams_of(word)) if i is not None]
                at = self.words[word] = np.array(known, dtype=np.int64)
            parts.append(at)
        return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def spaced(texts: list[str | None], lower: bool) -> list[str]:
    """Words two spaces apart, one before and after all: windows without a double space are the n-grams."""
    return [f" {'  '.join((text.lower() if lower else text).split())} " if text else "" for text in texts]


def characters(whole: str) -> np.ndarray:
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32)


def packed_grams(texts: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, their counts, ends of rows): the distinct n-grams of every text, ascending within it.

    An n-gram of 2 to 4 characters is a number of 64 bits, 16 for each character's number.  `texts` are `spaced`.
    """
    points = characters("".join(texts))
    ends = np.cumsum([0] + [len(text) for text in texts])
    code, blank = numbers[points].astype(np.uint64), points == 32
    two = ~(blank[:-1] & blank[1:])
    three = two[:-1] & two[1:]
    four = three[:-1] & two[2:]
    shift = [np.uint64(n) for n in (48, 32, 16)]
    pairs = code[:-1] << shift[0] | code[1:] << shift[1]
    triples = pairs[:-1] | code[2:] << shift[2]
    kinds = []
    for grams, whole in ((pairs, two), (triples, three), (triples[:-1] | code[3:], four)):
        before = np.concatenate([[0], np.cumsum(whole)])
        kinds.append((grams[whole], before[np.minimum(ends, len(whole))]))
    cuts = kinds[0][1] + kinds[1][1] + kinds[2][1]
    every = np.empty(cuts[-1], np.uint64)
    for n in range(len(texts)):
        own = every[cuts[n] : cuts[n + 1]]
        np.concatenate([grams[at[n] : at[n + 1]] for grams, at in kinds], out=own)
        own.sort()
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    first[cuts[:-1][cuts[:-1] < len(every)]] = True
    starts = np.flatnonzero(first)
    return every[starts], np.diff(starts, append=len(every)), np.searchsorted(starts, cuts)


def text_slices(texts: list[str | None]) -> Iterator[slice]:
    """Ranges of few texts and characters, so that what is held of them stays small."""
    start = size = 0
    for n, text in enumerate(texts):
        if n > start and (n - start >= SLICE_ROWS or size + len(text or "") > SLICE_CHARS):
            yield slice(start, n)
            start, size = n, 0
        size += len(text or "")
    if texts:
        yield slice(start, len(texts))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(ids):
        return ids, ids
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts], np.diff(starts, append=len(ids))


def term_counts(chunks: DataFrame, text: str = "text", lower: bool = True) -> DataFrame:
    """(term, df, cf) as partial counts per task, to be summed by term.

    N-grams are counted where the text is read: measured five times faster than
    explode + hash aggregate on (chunk, term), and what is shuffled is one task's
    vocabulary instead of its n-grams.  The tables are flushed before they grow large.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for part in text_slices(bodies):
                texts = spaced(bodies[part], lower)
                if not counter.takes(texts):
                    yield counter.flush()
                    if not counter.takes(texts):
                        yield _counted_by_word(bodies[part], lower)
                        continue
                counter.add(texts)
                if counter.size() > FLUSH_TERMS:
                    yield counter.flush()
        yield counter.flush()

    return chunks.select(text).mapInArrow(count, "term string, df long, cf long")


class _Counter:
    """Counts of packed n-grams; characters are numbered as they come, from 1."""

    def __init__(self):
        self.numbers, self.seen = np.zeros(CODE_POINTS, np.uint16), np.empty(0, np.uint32)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def takes(self, texts: list[str]) -> bool:
        """Number the characters of `texts`; false where there are more than numbers."""
        points = np.unique(characters("".join(texts)))
        new = points[self.numbers[points] == 0]
        if len(self.seen) + len(new) >= UNKNOWN:
            return False
        self.numbers[new] = np.arange(len(self.seen) + 1, len(self.seen) + 1 + len(new))
        self.seen = np.concatenate([self.seen, new])
        return True

    def add(self, texts: list[str]) -> None:
        grams, tfs, _ = packed_grams(texts, self.numbers)
        self.parts.append(_tallied(grams, tfs))
        if len(self.parts) > 1 and 2 * len(self.parts[0][0]) < sum(len(p[0]) for p in self.parts):
            self.merge()

    def merge(self) -> None:
        self.parts = [_summed(*(np.concatenate(column) for column in zip(*self.parts)))]

    def size(self) -> int:
        return len(self.parts[0][0])

    def flush(self) -> pa.RecordBatch:
        if self.parts:
            self.merge()
        grams, dfs, cfs = self.parts[0] if self.parts else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
        columns = [pa.array(_unpacked(grams, self.seen), pa.string()), pa.array(dfs), pa.array(cfs)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["term", "df", "cf"])


def _tallied(grams: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-grams of several texts, ascending, with the texts they are in and all their occurrences.

    Values alone are sorted, once each and once per repeat; sorting places to move counts along takes longer.
    """
    if not len(grams):
        return grams, np.empty(0, np.int64), np.empty(0, np.int64)
    more, times = distinct(np.sort(np.repeat(grams, tfs - 1)))
    grams, dfs = distinct(np.sort(grams))
    cfs = dfs.copy()
    cfs[np.searchsorted(grams, more)] += times.astype(np.int64)
    return grams, dfs, cfs


def _summed(grams: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-grams, ascending, with their counts added up."""
    order = np.argsort(grams)
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    return grams[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in counts)


def _unpacked(grams: np.ndarray, seen: np.ndarray) -> list[str]:
    numbers = (grams[:, None] >> np.array([48, 32, 16, 0], np.uint64)) & np.uint64(0xFFFF)
    has = numbers > 0
    whole = seen[numbers[has].astype(np.int64) - 1].astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(has.sum(axis=1)).tolist()
    return [whole[low:high] for low, high in zip([0, *ends], ends)]


def _counted_by_word(bodies: list[str | None], lower: bool) -> pa.RecordBatch:
    """Counts of texts with more characters than there are numbers for."""
    seen: dict[str, int] = {}
    grams = Grams(lambda gram: seen.setdefault(gram, len(seen)), lower)
    rows = [distinct(grams.of(body)) for body in bodies]
    at, tfs = (np.concatenate(column) for column in zip(*rows))
    counts = [pa.array(np.bincount(at, weights, len(seen)).astype(np.int64)) for weights in (None, tfs)]
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], ["term", "df", "cf"])


def idf(df: Column, n_chunks: int) -> Column:
    return F.log((F.lit(1.0) + n_chunks) / (F.lit(1.0) + df)) + 1.0


def vocabulary(chunks: DataFrame, n_chunks: int, max_features: int | None = None, lower: bool = True) -> DataFrame:
    """vocab(term, df, cf, idf); the cap keeps the highest corpus counts."""
    vocab = term_counts(chunks, lower=lower).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    if max_features is not None:
        vocab = top_terms(stage(vocab, "terms"), max_features)
    return vocab.withColumn("idf", idf(F.col("df"), n_chunks))


def numbered(vocab: DataFrame, broadcast_terms: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """The vocabulary with `place`, the frequent terms first, where it is within the broadcast bound."""
    if not fits(vocab, broadcast_terms):
        return vocab
    return vocab.withColumn("place", F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1)


def top_terms(vocab: DataFrame, limit: int) -> DataFrame:
    """The `limit` terms of highest count, the smaller term on ties.

    The count that cuts the list is found on the histogram of counts, so only the terms
    that tie at the cut are sorted, not the vocabulary.
    """
    if fits(vocab, limit):
        return vocab
    sizes = vocab.groupBy("cf").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("cf")).rowsBetween(W.unboundedPreceding, -1))
    cut = (
        sizes.withColumn("above", F.coalesce(above, F.lit(0)))
        .filter((F.col("above") < limit) & (F.col("above") + F.col("n") >= limit))
        .first()
    )
    tied = vocab.filter(F.col("cf") == cut.cf).orderBy("term").limit(limit - cut.above)
    return vocab.filter(F.col("cf") > cut.cf).unionByName(tied)


def _packed(terms: list[str], numbers: np.ndarray) -> np.ndarray:
    """Terms of 2 to 4 characters as numbers of 64 bits, as `packed_grams` makes them."""
    sizes = np.array([len(term) for term in terms], np.int64)
    points = characters("".join(term.ljust(4, "\0") for term in terms)).reshape(-1, 4)
    code = numbers[points].astype(np.uint64)
    code[np.arange(4) >= sizes[:, None]] = 0
    return (code << np.array([48, 32, 16, 0], np.uint64)).sum(axis=1, dtype=np.uint64)


class Words:
    """A vocabulary as a task uses it: packed n-grams, ascending, with their positions."""

    def __init__(self, terms: pa.Array, idfs: np.ndarray):
        self.terms, self.idfs = terms, idfs
        names = terms.to_pylist()
        self.alphabet = np.unique(characters("".join(names)))
        self.grams = self.at = None
        if len(self.alphabet) < UNKNOWN - 1:
            sizes = np.array([len(name) for name in names], np.int64)
            fitting = np.flatnonzero((sizes >= 2) & (sizes <= 4))  # no text has others
            grams = _packed([names[n] for n in fitting.tolist()], self.numbers())
            order = np.argsort(grams)
            self.grams, self.at = grams[order], fitting[order]

    def idfs_of(self, terms: list[str], numbers: np.ndarray | None) -> np.ndarray:
        """Of terms that are in the vocabulary; `numbers` are those of this vocabulary."""
        if not terms:
            return np.empty(0)
        if self.grams is None:
            return self.idfs[pc.index_in(pa.array(terms, pa.string()), value_set=self.terms).to_numpy()]
        return self.idfs[self.at[np.searchsorted(self.grams, _packed(terms, numbers))]]

    def weights(self, at: np.ndarray, tfs: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """tf x idf / norm of terms at their positions, the rows one after the other."""
        weights = tfs * self.idfs[at]
        norms = np.sqrt(np.bincount(row, weights * weights, rows))
        norms[norms == 0] = 1.0
        return weights / norms[row]

    def numbers(self) -> np.ndarray:
        numbers = np.full(CODE_POINTS, UNKNOWN, np.uint16)
        numbers[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return numbers


def pack(at: np.ndarray, tfs: np.ndarray) -> bytes:
    """Ascending places and their counts: the bytes that a value of each has, then gaps and counts, low bytes first."""
    blob = [b"", b""]
    for n, values in enumerate((np.diff(at, prepend=0), tfs)):
        width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
        blob[0] += bytes([width])
        blob.append(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return b"".join(blob)


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, counts, row of each) of what `pack` made, the rows one after the other."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for blob in blobs:
        widths, start, own = (blob[0], blob[1]), 2, []
        size = (len(blob) - 2) // sum(widths)
        for width in widths:
            planes = np.frombuffer(blob, np.uint8, size * width, start).reshape(width, size)
            own.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
            start += size * width
        parts.append((np.cumsum(own[0]), own[1]))
    row = np.repeat(np.arange(len(parts)), [len(at) for at, _ in parts])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(at for at, _ in parts)]), np.concatenate([none, *(tfs for _, tfs in parts)]), row


class Weigher:
    """Turns texts into normalised sparse rows inside a task."""

    def __init__(self, words: Words, lower: bool):
        self.words, self.lower = words, lower
        if words.grams is None:  # more characters than there are numbers for
            positions = {term: n for n, term in enumerate(words.terms.to_pylist())}
            self.by_word = Grams(positions.get, lower)
        else:
            self.numbers = words.numbers()

    def _counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, counts, row of each) of the known terms of texts."""
        words = self.words
        if words.grams is None:
            rows = [distinct(self.by_word.of(text)) for text in texts]
            at, tfs = (np.concatenate(column) for column in zip(*rows))
            return at, tfs, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        grams, tfs, ends = packed_grams(spaced(texts, self.lower), self.numbers)
        if not len(words.grams):
            grams, tfs, ends = grams[:0], tfs[:0], 0 * ends
        place = np.minimum(np.searchsorted(words.grams, grams), len(words.grams) - 1)
        known = words.grams[place] == grams
        return words.at[place[known]], tfs[known], np.repeat(np.arange(len(texts)), np.diff(ends))[known]

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term positions, weights tf x idf / norm, row of each), the rows one after the other."""
        at, tfs, row = self._counted(texts)
        return at, self.words.weights(at, tfs, row, len(texts)), row

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term positions, ascending within a row, their counts, row of each)."""
        at, tfs, row = self._counted(texts)
        order = np.argsort(row * len(self.words.idfs) + at)
        return at[order], tfs[order], row[order]


def share_vocabulary(vocab: DataFrame) -> Broadcast:
    """Broadcast `Words`, in the order of `place` if there is one; callers have checked the size."""
    table = (vocab.orderBy("place") if "place" in vocab.columns else vocab).select("term", "idf").toArrow()
    words = Words(pa.array(table.column("term").to_pylist(), pa.string()), table.column("idf").to_numpy())
    return vocab.sparkSession.sparkContext.broadcast(words)


def _weigh_in_task(texts: DataFrame, vocab: DataFrame, key: str, text: str, lower: bool) -> DataFrame:
    shared = share_vocabulary(vocab)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher, terms = Weigher(shared.value, lower), shared.value.terms
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for part in text_slices(bodies):
                at, weights, row = weigher.rows(bodies[part])
                sizes = np.bincount(row, minlength=part.stop - part.start)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        pa.ListArray.from_arrays(offsets, terms.take(pa.array(at))),
                        pa.ListArray.from_arrays(offsets, pa.array(weights, pa.float64())),
                    ],
                    [key, "terms", "weights"],
                )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(weigh, f"{key} {kind}, terms array<string>, weights array<double>")


def _count_in_task(texts: DataFrame, vocab: DataFrame, key: str, text: str, lower: bool) -> DataFrame:
    shared = share_vocabulary(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(shared.value, lower)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for part in text_slices(bodies):
                rows = part.stop - part.start
                at, tfs, row = weigher.counted(bodies[part])
                ends = np.searchsorted(row, np.arange(rows + 1)).tolist()
                packed = [pack(at[low:high], tfs[low:high]) for low, high in zip(ends, ends[1:])]
                columns = [batch.column(0).slice(part.start, rows), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [key, "counts"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(count, f"{key} {kind}, counts binary")


def _weigh_by_join(
    texts: DataFrame, vocab: DataFrame, key: str, text: str, lower: bool, hot_terms: int = 10_000
) -> DataFrame:
    """For vocabularies beyond the broadcast bound: joins only.

    The `hot_terms` most frequent terms are few by construction and are joined by
    broadcast; the rest have no hot keys left and shuffle evenly.
    """
    hot = vocab.orderBy(F.desc("df"), F.asc("term")).limit(hot_terms).select("term", F.col("idf").alias("_hot"))
    # a row's n-grams stay in its own partition, so counting them does not shuffle again
    rows = texts.select(key, text).repartition(key)
    grams = rows.select(key, F.explode(char_ngrams(F.col(text), lower=lower)).alias("term"))
    marked = grams.groupBy(key, "term").agg(F.count("*").alias("tf")).join(F.broadcast(hot), "term", "left")
    easy = marked.filter(F.col("_hot").isNotNull()).select(key, "term", (F.col("tf") * F.col("_hot")).alias("w"))
    rest = (
        marked.filter(F.col("_hot").isNull())
        .join(vocab.select("term", "idf"), "term")
        .select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    )
    pairs = easy.unionByName(rest).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("term", "w"))).alias("_p"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )
    found = pairs.select(
        F.col(key).alias("_key"),
        F.col("_p.term").alias("terms"),
        F.transform("_p", lambda p: p["w"] / F.col("_norm")).alias("weights"),
    )
    # texts without any known term have an empty row, as on the other route
    whole = rows.select(key).join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    return whole.select(
        key,
        F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
    )


def tfidf_vectors(
    texts: DataFrame,
    vocab: DataFrame,
    key: str = "chunk_id",
    text: str = "text",
    lower: bool = True,
    broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """(key, terms, weights): tf x idf, L2-normalised per row, unknown terms dropped.

    With a `numbered` vocabulary the rows are (key, counts), places and counts as `pack` puts them: the same in a
    tenth of the bytes, as weights follow from counts and idf.
    """
    weigh = _weigh_in_task if fits(vocab, broadcast_terms) else _weigh_by_join
    if weigh is _weigh_in_task and "place" in vocab.columns:
        weigh = _count_in_task
    return weigh(texts, vocab, key, text, lower)


def postings(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Long form (term, key, weight) of the chunk-major rows."""
    pairs = F.arrays_zip(F.col("terms"), F.col("weights"))
    return vectors.select(key, F.explode(pairs).alias("_p")).select(
        F.col("_p.terms").alias("term"), key, F.col("_p.weights").alias("weight")
    )


def l2_normalise(vector: Column) -> Column:
    """Unit vector in double precision; a zero vector stays zero."""
    def scale(wide: Column) -> Column:
        total = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x)
        return tx.bind(
            F.sqrt(total),
            lambda norm: F.transform(wide, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm)),
        )

    return tx.bind(vector.cast("array<double>"), scale)


def dense_gate(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: is there a vector for every chunk, and the warning otherwise."""
    total = chunks.select("chunk_id").join(
        vectors.select("chunk_id", F.lit(1).alias("_v")).distinct(), "chunk_id", "left"
    )
    counted = total.agg(F.count("*").alias("chunk_count"), F.count("_v").alias("vector_count"))
    whole = (F.col("vector_count") == F.col("chunk_count")) & (F.col("chunk_count") > 0)
    return counted.select(
        "chunk_count",
        "vector_count",
        whole.alias("has_embedding"),
        F.when(whole, F.lit("")).otherwise(F.lit("vectors incomplete, sparse index kept")).alias("embedding_warning"),
    )


def index_meta(
    chunks: DataFrame, vectors: DataFrame | None, size: int, overlap: int, backend: str = "hybrid", model: str = ""
) -> DataFrame:
    """One-row description of an index."""
    if backend not in ("hybrid", "embedding", "tfidf"):
        raise ValueError(f"unknown backend: {backend}")
    none = chunks.sparkSession.createDataFrame([], "chunk_id string")
    gate = dense_gate(chunks, vectors if vectors is not None else none)
    return gate.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "chunk_count",
        F.lit(size).alias("chunk_size"),
        F.lit(overlap).alias("overlap"),
        F.lit(backend).alias("retrieval_backend"),
        F.lit(model).alias("embedding_model"),
        "has_embedding",
        (F.col("chunk_count") > 0).alias("has_tfidf"),
        "embedding_warning",
    )


def index_files(chunks: DataFrame) -> DataFrame:
    """Indexed files with their chunk counts (X6); a table, since it grows with the corpus."""
    named = chunks.filter(F.length("source_file") > 0)
    return named.groupBy("source_file").agg(F.count("*").alias("file_chunks"))


def merge_chunks(existing: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Union by chunk_id; the old row wins unless `replace`."""
    if replace:
        existing = existing.join(new.select("chunk_id"), "chunk_id", "left_anti")
        return existing.unionByName(new, allowMissingColumns=True)
    unseen = new.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    return existing.unionByName(unseen, allowMissingColumns=True)


def merge_vocabulary(
    old: DataFrame, added: DataFrame, n_chunks: int, removed: DataFrame | None = None
) -> DataFrame:
    """Counts are additive, so only the added chunks were tokenised.

    `removed` holds the counts of chunks that a replacing merge took out; their counts are subtracted
    and terms that no chunk has any more are dropped.
    """
    both = old.select("term", "df", "cf").unionByName(added.select("term", "df", "cf"))
    if removed is not None:
        both = both.unionByName(removed.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
    merged = both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
    return merged.withColumn("idf", idf(F.col("df"), n_chunks))
