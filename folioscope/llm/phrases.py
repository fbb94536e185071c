"""Phrase collocation mining by stripes.

A stripe belongs to a prefix and counts the words that follow it.  A task counts the stripes of its
texts, cuts each in CUTS by its next words, so that a frequent prefix doesn't meet in one task, and puts
them out as compressed blocks, one per part of the shuffle; a part merges its blocks element by element.
The merged cells give everything: a cell of `word` is the frequency of the phrase one word longer, the
cell without a word is the prefix total, and the greatest cells around a phrase tell whether a longer
phrase subsumes it.

The lengths are counted one after the other.  A phrase that occurs `least` times has parts that do,
so from two words on a task counts only phrases whose first and last part are frequent.  It asks a
Bloom filter of bounded size; what passes wrongly is dropped by its count, so results are exact.

Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs; A-Z is
lower-cased.  Null text counts as empty, a null language as `und`.  An empty table gives an empty
result.  Repeated rows count repeatedly.  Other columns of the input are not looked at.  A text is
worked on in parts of a few megabytes that end at a piece's end; only a single piece of that length
is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import mix64, query, table, text_bytes
from folioscope.session import stage

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a phrase
TOP = 2000  # phrases reported per language
SLICE = 2 << 20  # bytes of text that a task cuts into words at once
HELD_CELLS = 1_000_000  # cells that a task gathers before it puts them out
HELD_WORDS = 400_000  # distinct words that a task gathers before it puts its cells out
MERGED_CELLS = 1_500_000  # cells that a part gathers before it adds equal ones
CUTS = 8  # of a stripe
HOT = 10_000  # most frequent parts, looked up by broadcast
BITS_PER_PHRASE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # 128 kB to 32 MB, whatever the corpus
PROBES = 3

END = b"\xff"  # occurs in no UTF-8 text
CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", END * 10)


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=b"phrase").digest(), "little")


def _extend(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and of its next word."""
    return mix64(state * np.uint64(0x9E3779B97F4A7C15) + words)


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield (mix64(hashes + np.uint64(0xD1B54A32D192ED03 * (i + 1) % 2**64)) & np.uint64(bits - 1)).astype(np.int64)


class PhraseFilter:
    """Bloom filter of (lang, phrase); its size is bounded, so it may be sent to every task."""

    def __init__(self, phrases: DataFrame):
        rows = phrases.count()
        self.bits = LEAST_BITS
        while self.bits < min(MOST_BITS, rows * BITS_PER_PHRASE):
            self.bits *= 2
        bits = self.bits

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = np.empty(batch.num_rows, np.uint64)
                for i, (lang, phrase) in enumerate(zip(text_bytes(batch.column(0)), text_bytes(batch.column(1)))):
                    state = np.array([_hash(lang)], np.uint64)
                    for word in phrase.split(b" "):
                        state = _extend(state, np.uint64(_hash(word)))
                    hashes[i] = state[0]
                for at in _probes(hashes, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["at"])

        blocks = (
            phrases.select("lang", "phrase")
            .mapInArrow(places, "at long")
            .groupBy(F.expr("bitmap_bucket_number(at)").alias("block"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
        )
        filled = np.zeros(bits // 8, np.uint8)
        for block, bitmap in blocks.toLocalIterator():  # at most MOST_BITS / 32768 rows of 4 kB
            start = (block - 1) * 4096
            filled[start : start + len(bitmap)] = np.frombuffer(bitmap, np.uint8)
        self.filled = phrases.sparkSession.sparkContext.broadcast(filled)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        filled, found = self.filled.value, np.ones(len(hashes), bool)
        for at in _probes(hashes, self.bits):
            found &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _parts(text: bytes) -> Iterator[bytes]:
    """Text with A-Z lower-cased and END for every piece end, in parts that end with a piece."""
    text = text.lower().translate(CUT)
    start = 0
    while len(text) - start > SLICE:
        end = text.rfind(END, start, start + SLICE)
        if end < 0:
            end = text.find(END, start + SLICE)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(language, text) of about SLICE bytes; texts are joined by END."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    for lang, text in zip(text_bytes(batch.column(0)), text_bytes(batch.column(1))):
        for part in _parts(text):
            held.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + len(part)
            if sizes[lang] >= SLICE:
                yield lang, END.join(held.pop(lang))
                del sizes[lang]
    for lang, parts in held.items():
        yield lang, END.join(parts)


class _Words(dict):
    """Number of each word of one language in a task; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _grouped(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of word numbers with their summed counts, in order of their prefix."""
    key = columns[0]
    for i, column in enumerate(columns[1:], 1):
        if i > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key << 32 | column
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = order[starts]
    return [c[first] for c in columns], np.add.reduceat(counts[order], starts)


class _Stripes:
    """Stripes of one language in one task, for phrases of `size` words."""

    def __init__(self, lang: bytes, size: int, known: PhraseFilter | None):
        self.lang, self.size, self.known = lang, size, known
        self.start = np.uint64(_hash(lang))
        self.clear()

    def clear(self) -> None:
        self.words, self.hashes, self.cells, self.rows = _Words(), np.zeros(0, np.uint64), [], 0

    def add(self, text: bytes) -> None:
        words = text.replace(END, b" \xff ").split()
        words += [END] * self.size  # every prefix has a next word or an end
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.size == 1:
            places, columns = np.flatnonzero(at), []
            following = at[places]
        else:
            fresh = [_hash(word) for word in list(self.words)[len(self.hashes) :]]
            self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
            state, whole = np.full(len(at) - self.size + 1, self.start), True
            for i in range(self.size - 1):
                state = _extend(state, self.hashes[at[i : i + len(state)]])
                whole = whole & (at[i : i + len(state)] > 0)
            held = np.zeros(len(state) + 1, bool)
            inside = np.flatnonzero(whole)
            held[inside] = self.known.holds(state[inside])
            places = np.flatnonzero(held)
            columns = [at[places + i] for i in range(self.size - 1)]
            # a next word counts only if the phrase without its first word is frequent too
            following = np.where(held[places + 1], at[places + self.size - 1], 0)
        if len(places):
            self.cells.append(_grouped([*columns, following], np.ones(len(places), np.int64)))
            self.rows += len(self.cells[-1][1])

    def full(self) -> bool:
        return self.rows > HELD_CELLS or len(self.words) > HELD_WORDS

    def table(self) -> pa.Table | None:
        """(lang, prefix, word, n, part) cells; a prefix's cell without a word is its total."""
        if not self.cells:
            return None
        columns = [np.concatenate(c) for c in zip(*[columns for columns, _ in self.cells])]
        columns, counts = _grouped(columns, np.concatenate([counts for _, counts in self.cells]))
        names, hashes, lang = pa.array(list(self.words), pa.binary()), self.hashes, self.lang
        if self.size == 1:
            hashes = np.array([_hash(word) for word in self.words], np.uint64)
        self.clear()
        # counts come in order of their prefix
        new = np.zeros(len(counts), bool)
        new[0] = True
        for column in columns[:-1]:
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        listed = np.flatnonzero(columns[-1] > 0)  # what has no counted next word is in the total only
        rows = np.concatenate([starts, listed])
        word = np.concatenate([np.full(len(starts), -1), columns[-1][listed]])
        n = np.concatenate([np.add.reduceat(counts, starts), counts[listed]])
        state = np.full(len(rows), np.uint64(_hash(lang)))
        for column in columns[:-1]:
            state = _extend(state, hashes[column[rows]])
        cut = np.where(word < 0, np.uint64(0), hashes[word] % np.uint64(CUTS))
        parts = [names.take(pa.array(c[rows])).cast(pa.string()) for c in columns[:-1]] or [pa.array([""] * len(rows))]
        return pa.table(
            {
                "lang": pa.array([lang.decode("utf-8", "replace")]).take(pa.array(np.zeros(len(rows), np.int32))),
                "prefix": pc.binary_join_element_wise(*parts, " "),
                "word": names.take(pa.array(word, mask=word < 0)).cast(pa.string()),
                "n": pa.array(n),
                "part": pa.array(mix64(state + cut)),
            }
        )


def _blocks(held: list[_Stripes], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, block): the cells of a task for each part, compressed."""
    tables = [t for t in (stripes.table() for stripes in held) if t is not None]
    if not tables:
        return
    cells = pa.concat_tables(tables)
    part = (cells.column("part").to_numpy() % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cells, part = cells.drop_columns(["part"]).take(pa.array(order)).combine_chunks(), part[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for low, high in zip(starts, np.append(starts[1:], len(part))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, cells.schema, options=options) as out:
            out.write_table(cells.slice(low, high - low).sort_by([("prefix", "ascending"), ("word", "ascending")]))
        block = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([part[low]], pa.int32()), block], ["part", "block"])


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stripes(docs: DataFrame, size: int, known: PhraseFilter | None = None) -> DataFrame:
    """(part, block) of each task: its stripes for phrases of `size` words of documents(lang, text).

    `known` holds the frequent phrases of one word less.
    """
    parts = 2 * shuffle_parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[bytes, _Stripes] = {}
        for batch in batches:
            for lang, text in _slices(batch):
                if lang not in by_lang:
                    by_lang[lang] = _Stripes(lang, size, known)
                by_lang[lang].add(text)
                if by_lang[lang].full() or sum(s.rows for s in by_lang.values()) > HELD_CELLS:
                    yield from _blocks(list(by_lang.values()), parts)
        yield from _blocks(list(by_lang.values()), parts)

    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return named.mapInArrow(count, "part int, block binary")


def merged(blocks: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, word, n): stripes added element by element; `word` null is the prefix total.

    Cells below `least` are left out, but for the number of all words, which has no prefix.
    """

    def added(tables: list[pa.Table]) -> pa.Table:
        cells = pa.concat_tables(tables).group_by(["lang", "prefix", "word"], use_threads=False)
        return cells.aggregate([("n", "sum")]).rename_columns(["lang", "prefix", "word", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(tables: list[pa.Table]) -> list[pa.RecordBatch]:
            cells = added(tables)
            whole = pc.and_(pc.is_null(cells.column("word")), pc.equal(cells.column("prefix"), ""))
            enough = pc.greater_equal(cells.column("n"), least)
            return cells.filter(pc.or_(enough, whole)).combine_chunks().to_batches()

        at, held, rows = None, [], 0
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at and held:
                    yield from frequent(held)
                    held, rows = [], 0
                at = part
                held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
                rows += held[-1].num_rows
                if rows > max(MERGED_CELLS, 2 * held[0].num_rows):
                    held = [added(held)]
                    rows = held[0].num_rows
        if held:
            yield from frequent(held)

    # a fixed number of tasks: blocks are several times larger when decompressed
    ordered = blocks.repartition(shuffle_parts(blocks), "part").sortWithinPartitions("part")
    return ordered.mapInArrow(merge, "lang string, prefix string, word string, n long")


def _phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))


def frequent_cells(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """Merged cells of at least `least`, one staged table per length from 1 to `longest`."""
    levels, known = [], None
    for size in range(1, longest + 1):
        levels.append(stage(merged(stripes(docs, size, known), least), f"stripes-{size}"))
        if size < longest:
            known = PhraseFilter(levels[-1].filter(F.col("word").isNotNull() & (F.col("n") >= least)).select("lang", _phrase().alias("phrase")))
    return levels


def _look_up(rows: DataFrame, totals: DataFrame, part: str, name: str) -> DataFrame:
    """Add the frequency of the phrase in column `part`.

    The HOT most frequent phrases go by broadcast.  A phrase has no more candidates around it than its own
    frequency allows, so no key of the shuffled rest is hot.
    """
    order = F.struct(F.col("n"), F.col("lang"), F.col("phrase"))
    totals = totals.withColumn("_order", order)
    hot = totals.orderBy(F.desc("_order")).limit(HOT).select("lang", F.col("phrase").alias(part), F.col("n").alias("_hot"))
    marked = rows.join(F.broadcast(hot), ["lang", part], "left")
    easy = marked.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", name)
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot")
    found = rest.join(totals.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    return easy.unionByName(found)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""

    def wide(value: Column, digits: int = 19) -> Column:
        return value.cast(f"decimal({digits},0)")

    above = wide(wide(wide(a) * wide(n), 34) * F.lit(1000).cast("decimal(4,0)"), 38)
    return F.call_function("div", above, wide(wide(left) * wide(right), 38))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of documents(lang, text), the first `top` of each language.

    a, l and r are the frequencies of the phrase and of the parts at its weakest cut, n all words of
    the language.  Phrases that lie in a longer one of the same frequency are left out.  Equal scores go
    by a, then by the phrase in byte order.
    """
    levels = frequent_cells(docs, longest, least)
    words = levels[0].filter(F.col("word").isNull()).select("lang", F.col("n").alias("n_all"))
    longer = reduce(DataFrame.unionByName, levels[1:])
    totals = longer.filter(F.col("word").isNull()).select("lang", F.col("prefix").alias("phrase"), "n")
    found = longer.filter(F.col("word").isNotNull()).select(
        "lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), "prefix", F.col("n").alias("a")
    )
    found = stage(found, "phrases")
    # a phrase is inside a longer one of its frequency only if it is inside one of a single word more
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    around = found.select("lang", F.explode(F.array("prefix", rest)).alias("phrase"), F.col("a").alias("above"))
    around = around.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    kept = found.join(around, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (F.col("above") < F.col("a")))
    parts = kept.withColumn("_w", F.split("phrase", " ")).select(
        "lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k")
    )
    cuts = parts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w")), " ").alias("rest"),
    )
    cuts = _look_up(_look_up(cuts, totals, "first", "l"), totals, "rest", "r").join(F.broadcast(words), "lang")

    scored = cuts.withColumn("score", score(F.col("a"), F.col("n_all"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", F.col("n_all").alias("n"), "score"), F.struct("score", "k")).alias("_b")
    )
    ranked = best.select("lang", "phrase", "_b.*").withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long")
    )
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
    SELECT lang, len(parts) AS m, array_to_string(parts, ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w[i : i + m - 1] AS parts
          FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
                FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m))
    GROUP BY ALL
), sizes AS (
    SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), candidates AS (
    SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 100
), inside AS (
    SELECT DISTINCT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, a
    FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i
          FROM (SELECT lang, w, a, m, unnest(range(2, m)) AS k FROM candidates))
), longer AS (
    SELECT lang, phrase, max(a) AS above FROM inside GROUP BY ALL
), kept AS (
    SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE above IS NULL OR 100 * above < 100 * a
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail
    FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n,
        ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head
    JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail JOIN sizes s ON s.lang = c.lang
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
        phrase, a, l, r, n, score
    FROM best WHERE place = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""


@query("op13_phrases", OP13_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
