"""Ranked lexical search: Block-Max MaxScore over an inverted index in shards.

Every task cuts its texts into terms once and writes one inverted index per shard of documents.  A
posting list is a row: blocks of BLOCK postings, each compressed (gaps and counts as variable-length
bytes) and described by its first document, greatest count and least document length.  Those two bound
every score in the block, whatever the corpus statistics turn out to be.

A table of queries is answered shard by shard.  The bounds of whole lists part a query's terms into
essential lists, whose documents are candidates, and the others, which alone could not lift a document
into the result.  On the others, block bounds reject candidates before a block is decompressed.  A task
carries the best k of each query from shard to shard, so the bar rises; the tasks' results are merged.

Scores are 64-bit integers.  Null and empty texts have no terms and are never found; they don't count
as documents.  Queries without a known term have no rows.  Every row of the table is a document of its
own, also where ids repeat; documents without an id come last among equal scores.  Other columns of
the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import query, table, text_bytes
from folioscope.session import stage, stage_all

BLOCK = 128  # postings
SHARD_DOCS = 32_768
SHARD_TERMS = 4_000_000  # term occurrences; a longer text is a shard of its own
SLICE = 1 << 20  # bytes of text cut into terms at once
QUERY_TERMS = 100_000  # (query, term) pairs that one pass over the index answers
TOP = 20

# A-Z to lower case, everything that is no term character to a blank
_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLD = bytes(c if c in _TERM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

DIRECTORY = np.dtype([("first", "<i4"), ("max_tf", "<i4"), ("min_n", "<i4"), ("end", "<i4")])
SCHEMA = "shard long, term string, df int, total long, directory binary, data binary"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms with their repeats, in lists of about SLICE bytes."""
    text, start = text.translate(FOLD), 0
    while len(text) - start > SLICE and (end := text.find(b" ", start + SLICE)) >= 0:
        yield text[start:end].split()
        start = end
    yield text[start:].split()


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variable-length bytes of all values, number of bytes of each): seven bits a byte, low ones first."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        more = values >> np.uint64(shift) > 0
        if not more.any():
            break
        sizes += more
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        byte = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[starts[has] + i] = byte.astype(np.uint8) | ((sizes[has] > i + 1).astype(np.uint8) << 7)
    return out, sizes


def from_bytes(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


class _Shard:
    """Inverted index of some documents, in a task's memory."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # (term << 32 | document, count)
        self.terms = 0

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        numbers, parts = self.numbers, []
        for doc, text in enumerate(texts, len(self.ids)):
            self.lengths.append(0)
            for words in terms_of(text):
                for word in set(words).difference(numbers):
                    numbers[word] = len(numbers)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) << 32 | doc)
                self.lengths[-1] += len(words)
                self.terms += len(words)
        self.ids += ids
        if sum(map(len, parts)):
            keys = np.sort(np.concatenate(parts))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.held.append((keys[starts], np.diff(starts, append=len(keys))))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.terms >= SHARD_TERMS

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row of the shard's documents, without a term, then one per term in byte order."""
        lengths = np.array(self.lengths, "<i4")
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        about = ids.tobytes() + lengths.tobytes() + known.tobytes()
        yield self._batch([shard], [None], [int((lengths > 0).sum())], [self.terms], [b""], [about])
        if not self.held:
            return
        words = sorted(self.numbers)
        order = np.empty(len(words), np.int64)
        order[[self.numbers[w] for w in words]] = np.arange(len(words))
        keys, tf = (np.concatenate(x) for x in zip(*self.held))
        keys = order[keys >> 32] << 32 | keys & 0xFFFFFFFF
        by = np.argsort(keys, kind="stable")
        keys, tf = keys[by], tf[by]
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        df = np.bincount(term, minlength=len(words))
        lists = np.cumsum(df) - df
        place = np.arange(len(term)) - lists[term]
        starts = np.flatnonzero(place % BLOCK == 0)
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0
        packed, sizes = to_bytes(np.stack([gaps, tf - 1], axis=1).ravel())
        upto = np.concatenate([[0], np.cumsum(sizes)])[::2]  # bytes before each posting, and all
        blocks = np.zeros(len(starts), DIRECTORY)
        blocks["first"] = doc[starts]
        blocks["max_tf"] = np.maximum.reduceat(tf, starts)
        blocks["min_n"] = np.minimum.reduceat(lengths[doc], starts)
        block_ends = upto[np.append(starts[1:], len(term))]
        blocks["end"] = block_ends - upto[lists][term[starts]]
        own = (df + BLOCK - 1) // BLOCK
        directory, data = blocks.tobytes(), packed.tobytes()
        at_block = np.concatenate([[0], np.cumsum(own)]) * DIRECTORY.itemsize
        at_data = upto[np.append(lists, len(term))]
        for low in range(0, len(words), 50_000):
            high = min(low + 50_000, len(words))
            yield self._batch(
                np.full(high - low, shard),
                pa.array(words[low:high], pa.binary()).cast(pa.string()),
                df[low:high].astype(np.int32),
                np.zeros(high - low, np.int64),
                _cut(directory, at_block[low : high + 1]),
                _cut(data, at_data[low : high + 1]),
            )

    def _batch(self, shard, term, df, total, directory, data) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip((shard, term, df, total, directory, data), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "total", "directory", "data"])


def _cut(whole: bytes, ends: np.ndarray) -> pa.Array:
    """Values of a binary column, one after the other in `whole`."""
    part = whole[ends[0] : ends[-1]]
    offsets = (ends - ends[0]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part)])


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Index rows (shard, term, df, total, directory, data) of all documents.

    The row without a term describes the shard: documents with terms, all terms, then ids and lengths.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, body in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ids.append(doc_id)
                texts.append(body)
                size += len(body)
                if size >= SLICE or len(shard.ids) + len(ids) >= SHARD_DOCS:
                    shard.add(ids, texts)
                    ids, texts, size = [], [], 0
                    if shard.full():
                        yield from shard.batches(number)
                        number, shard = number + 1, _Shard()
            shard.add(ids, texts)
        if shard.ids:
            yield from shard.batches(number)

    # written once: the numbers of shards are those of the tasks that ran
    return stage(docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(build, SCHEMA), "lexical-index")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class _List:
    """Posting list of one term in a shard; blocks are decompressed on demand and once."""

    def __init__(self, df: int, directory: bytes, data: bytes, measure: np.ndarray, relative):
        self.blocks = np.frombuffer(directory, DIRECTORY)
        self.data, self.df, self.measure = np.frombuffer(data, np.uint8), df, measure
        self.first = self.blocks["first"]
        self.ends = np.concatenate([[0], self.blocks["end"].astype(np.int64)])
        self.bounds = impact(self.blocks["max_tf"].astype(np.int64), relative(self.blocks["min_n"].astype(np.int64)))
        self.bound = int(self.bounds.max())
        self.docs, self.impacts = np.empty(df, np.int64), np.empty(df, np.int64)
        self.have = np.zeros(len(self.blocks), bool)

    def load(self, wanted: np.ndarray) -> None:
        """Decompress the wanted blocks that are not yet there."""
        missing = np.flatnonzero(wanted & ~self.have)
        if not len(missing):
            return
        raw = np.concatenate([self.data[self.ends[b] : self.ends[b + 1]] for b in missing])
        values = from_bytes(raw).reshape(-1, 2)
        sizes = np.minimum(BLOCK, self.df - missing * BLOCK)
        starts = np.cumsum(sizes) - sizes
        run = np.cumsum(values[:, 0])
        docs = run + np.repeat(self.first[missing] - run[starts], sizes)
        at = np.repeat(missing * BLOCK - starts, sizes) + np.arange(len(docs))
        self.docs[at] = docs
        self.impacts[at] = impact(values[:, 1] + 1, self.measure[docs])
        self.have[missing] = True

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        self.load(np.ones(len(self.blocks), bool))
        return self.docs, self.impacts

    def at(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of sorted documents, zero where the list doesn't hold them; their blocks must be loaded."""
        found = np.zeros(len(docs), np.int64)
        for b in np.unique(block[block >= 0]):
            low, high = b * BLOCK, min((b + 1) * BLOCK, self.df)
            inside = np.flatnonzero(block == b)
            at = low + np.searchsorted(self.docs[low:high], docs[inside])
            hit = at < high
            hit[hit] = self.docs[at[hit]] == docs[inside][hit]
            found[inside[hit]] = self.impacts[at[hit]]
        return found


class _Best:
    """The k best documents of one query so far, by score and then id; `bar` is the k-th score or zero."""

    def __init__(self, k: int):
        self.k, self.bar = k, 0
        self.scores, self.ids, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.k:
            self.bar = int(self.scores[-1])


def max_score(lists: list[tuple[int, _List]], n_docs: int, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among a query's best k; `lists` has weight and list.

    Every document of a score above zero that is at least `bar` and among the k best of the shard is
    there with its whole score.
    """
    lists = sorted((pair for pair in lists if pair[0] * pair[1].bound > 0), key=lambda pair: pair[0] * pair[1].bound)
    upto = np.concatenate([[0], np.cumsum([weight * found.bound for weight, found in lists])])
    scores = np.zeros(n_docs, np.int64)
    essential = int(np.searchsorted(upto[1:], bar, "left"))  # lists before it cannot reach the bar together
    if essential == len(lists):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for weight, found in lists[essential:]:
        docs, impacts = found.whole()
        scores[docs] += weight * impacts
    docs = np.flatnonzero(scores)
    for i in range(essential - 1, -1, -1):
        if len(docs) > k:  # final scores are no less than these
            bar = max(bar, int(np.partition(scores[docs], len(docs) - k)[len(docs) - k]))
        docs = docs[scores[docs] + upto[i + 1] >= bar]
        weight, found = lists[i]
        block = np.searchsorted(found.first, docs, "right") - 1
        limit = np.where(block >= 0, weight * found.bounds[block], 0) + upto[i]
        alive = scores[docs] + limit >= bar
        docs, block = docs[alive], block[alive]
        wanted = np.zeros(len(found.blocks), bool)
        wanted[block[block >= 0]] = True
        found.load(wanted)
        scores[docs] += weight * found.at(docs, block)
    docs = docs[scores[docs] >= max(bar, 1)]
    return docs, scores[docs]


def _search(rows: DataFrame, asked: dict, weights: dict[str, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Best k of each task for `asked`, a dict of query number to (id, terms with their counts)."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, weights))

    def relative(n: np.ndarray) -> np.ndarray:
        return 75 + 25 * n * n_docs // n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        best = {q: _Best(k) for q in queries}

        def answer(shard: list[dict]) -> None:
            about = next(r["data"] for r in shard if r["term"] is None)
            n = len(about) // 13
            ids, lengths = np.frombuffer(about, "<i8", n), np.frombuffer(about, "<i4", n, 8 * n)
            known = np.frombuffer(about, np.uint8, n, 12 * n).astype(bool)
            measure = relative(lengths.astype(np.int64))
            lists = {
                r["term"]: _List(r["df"], r["directory"], r["data"], measure, relative) for r in shard if r["term"] is not None
            }
            for q, (_, terms) in queries.items():
                own = [(count * weight[t], lists[t]) for t, count in terms.items() if t in lists]
                docs, scores = max_score(own, n, k, best[q].bar)
                if len(docs):
                    best[q].add(scores, ids[docs], known[docs])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    answer(held)
                    held = []
                held.append(row)
        if held:
            answer(held)
        for q, (item, _) in queries.items():
            found = best[q]
            if len(found.scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(found.scores), pa.int64()),
                        pa.array(found.ids, mask=~found.known),
                        pa.array(found.scores),
                    ],
                    ["item_id", "doc_id", "score"],
                )

    ordered = rows.repartition("shard").sortWithinPartitions("shard")
    return ordered.select("shard", "term", "df", "directory", "data").mapInArrow(run, "item_id long, doc_id long, score long")


def _query_terms(queries: DataFrame, id_column: str, text: str) -> DataFrame:
    """(number, item_id, terms) where terms are written with their repeats."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[t.decode() for words in terms_of(body) for t in words] for body in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["item_id", "terms"])

    asked = queries.select(F.col(id_column).cast("long"), F.col(text))
    return asked.mapInArrow(cut, "item_id long, terms array<string>").filter(F.size("terms") > 0)


def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above zero for each query.

    Queries are taken in blocks of at most about QUERY_TERMS terms, one pass over the index each.
    """
    spark = index.sparkSession
    asked = stage(_query_terms(queries, id_column, text), "query-terms")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    about = index.filter(F.col("term").isNull()).agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
    parts = []
    blocks = -(-total // QUERY_TERMS) if about.terms else 0
    for block in range(blocks):
        of_block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block
        items = {}
        for number, row in enumerate(asked.filter(of_block).collect()):  # about QUERY_TERMS terms
            counts: dict[str, int] = {}
            for term in row.terms:
                counts[term] = counts.get(term, 0) + 1
            items[number] = (row.item_id, counts)
        wanted = spark.createDataFrame([(t,) for t in sorted({t for _, c in items.values() for t in c})], "term string")
        rows = index.filter(F.col("term").isNotNull()).join(F.broadcast(wanted), "term")
        weights = {
            r.term: math.floor(1000 * math.log((2 * about.docs + 2) / (2 * r.df + 1)))
            for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()
        }
        rows = rows.select(index.columns).unionByName(index.filter(F.col("term").isNull()))
        parts.append(_search(rows, items, weights, about.docs, about.terms, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = stage_all(parts, "hits")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


OP11_SQL = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), lengths AS (
    SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), corpus AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tfs, corpus GROUP BY term
), impacts AS (
    SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS impact
    FROM tfs JOIN lengths USING (doc_id), corpus
), scored AS (
    SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
    FROM item_terms JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
