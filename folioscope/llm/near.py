"""Near-duplicate documents by b-bit MinHash, exact in its links and components.

One pass over the texts makes, per document, the set of word shingles, its minima under 288 hashes,
a key for each of 48 bands of 6 minima, and the two low bits of 256 minima packed into eight longs.
Documents with equal sets are one class from then on, so exact copies are never compared.  Two
documents of similarity 0.8 share no band with a probability below 1e-6.

In a band's bucket every class is first paired with the bucket's smallest only.  Pairs whose sizes
allow the similarity and whose estimate from bit counts, corrected for chance agreement, is not far
below it are confirmed on full sets.  Filters of bounded size leave out the bands without a bucket and the
texts without a candidate before they are shuffled; joins drop the few others that pass.  Buckets whose classes are then still in several components are
compared block by block inside tasks by their estimates, which tells what components may be linked.  The
full sets of such families of components meet in blocks of bounded size; tasks compare them and put out
one link for each two components they join.  No bucket is capped, none is gathered whole and no list of
all pairs is made.

Null, empty and blank texts have empty sets and are linked with nothing.  Rows without an id are
linked with nothing either.  Rows that repeat an id are one document.  Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bloom import Bloom
from folioscope.llm.common import WordHash, blobs, free_name, mix64, query, table, text_bytes
from folioscope.llm.graph_links import components
from folioscope.session import small_batches, stage

BANDS, ROWS = 48, 6
PACKED = 256  # minima of which two low bits are kept
PLANES = PACKED // 64
MARGIN = 0.20  # of the estimate; six and a half standard deviations at 0.8: a link is lost with 7e-10
BLOCK = 1024  # classes of a bucket that are compared at a time
BLOCK_BYTES = 1 << 19  # of full sets that are compared at a time
CHUNK = 1 << 16  # shingles hashed at a time, so that they stay in cache
BATCH = 512  # whole texts or full sets that a task holds at a time


def shingle_set(words: list[bytes], hashes: WordHash, size: int) -> np.ndarray:
    """Distinct shingles of `size` words as sorted 64-bit hashes; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes.of(words)
    size = min(size, len(ids))
    count = len(ids) - size + 1
    made = np.full(count, size, np.uint64)
    for i in range(size):
        made = mix64(made ^ ids[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(made)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    made = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (made >> np.uint64(32)).astype(np.uint32), made.astype(np.uint32) | np.uint32(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 [hashes, documents]: the least value of every hash over each (non-empty) set."""
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    shift, times = _seeds()
    out = np.empty((len(times), len(sets)), np.uint32)
    work = np.empty_like(flat)
    for k in range(len(times)):
        np.bitwise_xor(flat, shift[k], out=work)
        np.multiply(work, times[k], out=work)
        np.minimum.reduceat(work, offsets, out=out[k])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """int64 [documents, bands]: one key per band, different bands never equal by design."""
    keys = np.empty((least.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(least.shape[1], band + 1, np.uint64)
        for row in least[band * ROWS : (band + 1) * ROWS]:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ row)
        keys[:, band] = key
    return keys.view(np.int64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """int64 [documents, 2 * PLANES]: first and second low bit of the kept minima."""
    mixed = mix64(least[:PACKED].astype(np.uint64)).T
    planes = [np.packbits((mixed >> np.uint64(bit)).astype(np.uint8) & 1, axis=1) for bit in (0, 1)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def _batches(texts: Iterator[bytes], hashes: WordHash, size: int) -> Iterator[list[np.ndarray]]:
    group, held = [], 0
    for text in texts:
        group.append(shingle_set(text.lower().split(), hashes, size))
        held += len(group[-1])
        if held >= CHUNK:
            yield group
            group, held = [], 0
    if group:
        yield group


_SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>, bits array<long>"


def _rows(values: np.ndarray, full: np.ndarray) -> pa.Array:
    """One list per row of `values`, null where `full` is false."""
    ends = np.concatenate(([0], np.cumsum(full))) * values.shape[1]
    offsets = pa.array(ends, pa.int32(), mask=np.append(~full, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _signed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Signatures of a group of sets, which _batches keeps small; lists are made from arrays."""
    counts = np.array([len(s) for s in sets], np.int64)
    full = counts > 0
    least = minima([s for s in sets if len(s)]) if full.any() else np.empty((BANDS * ROWS, 0), np.uint32)
    digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
    columns = [ids, pa.array(counts), pa.array(digests, pa.binary())]
    columns += [_rows(band_keys(least), full), _rows(low_bits(least), full)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_hash", "bands", "bits"])


def signatures(df: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """doc_id, n_shingles, hash of the whole set, band keys and packed bits of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            at = 0
            for sets in _batches(text_bytes(batch.column(1)), hashes, size):
                yield _signed(batch.column(0).slice(at, len(sets)), sets)
                at += len(sets)

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, _SIGNED)


def estimate(left: Column, right: Column) -> Column:
    """Similarity from the packed bits, less what agrees by chance (a quarter)."""
    agree = F.lit(0)
    for i in range(PLANES):
        differ = F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i))).bitwiseOR(
            F.get(left, F.lit(PLANES + i)).bitwiseXOR(F.get(right, F.lit(PLANES + i)))
        )
        agree = agree + 64 - F.bit_count(differ)
    return (agree / PACKED - 0.25) / 0.75


def _sizes_allow(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _sets(df: DataFrame, wanted: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """(doc_id, packed set) of the wanted documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                sets = [shingle_set(t.lower().split(), hashes, size) for t in text_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), blobs(sets)], ["doc_id", "members"])

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = wanted.select("doc_id").distinct()
    made = _may_be(texts, "doc_id", wanted).mapInArrow(run, "doc_id long, members binary")
    return made.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _may_be(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose `column` is wanted and few others, without a shuffle of `df`; a join drops the others."""
    found = Bloom(wanted, column, wanted.count())
    return df.filter(found.holds(F.col(column)))


def _similar(m: np.ndarray, n: np.ndarray, percent: int) -> bool:
    both = np.concatenate((m, n))
    both.sort(kind="stable")  # two sorted runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(m) + len(n) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _with_signs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose estimate doesn't rule it out."""
    a = classes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("m"), F.col("bits").alias("x"))
    b = classes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("bits").alias("y"))
    near = estimate(F.col("x"), F.col("y")) >= percent / 100 - MARGIN
    return pairs.join(a, "a").join(b, "b").filter(_sizes_allow(F.col("m"), F.col("n"), percent) & near).select("a", "b")


class _Joined:
    """Which components a task has joined already."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _pairs_of_blocks(rows: DataFrame, key: str, blocks: Column, columns: list[str]) -> DataFrame:
    """Rows of a key cut into blocks; every block meets every block of its key once, as arrays."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    grouped = rows.groupBy(key, "block").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    grouped = grouped.select(key, "block", *[F.col(f"rows.{c}").alias(c) for c in columns])
    left = grouped.select(key, *[F.col(c).alias(f"l_{c}") for c in grouped.columns[1:]])
    right = grouped.select(key, *[F.col(c).alias(f"r_{c}") for c in grouped.columns[1:]])
    return left.join(right, key).filter("l_block <= r_block").drop(key, "l_block", "r_block")


def _near(left: list, right: list, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the left block, rows of the right one) that may be links between components."""
    (ids, parts, sizes, bits), (others, other_parts, other_sizes, other_bits) = left[:4], right[:4]
    for i in range(len(ids)):
        small, large = np.minimum(sizes[i], other_sizes), np.maximum(sizes[i], other_sizes)
        at = np.flatnonzero((parts[i] != other_parts) & (100 * small >= percent * large))
        if len(at):
            xor = bits[i] ^ other_bits[at]
            differ = np.bitwise_count(xor[:, :PLANES] | xor[:, PLANES:]).sum(axis=1)
            at = at[((PACKED - differ) / PACKED - 0.25) / 0.75 >= percent / 100 - MARGIN]
            if len(at):
                yield i, at


def _cells(batch: pa.RecordBatch, row: int) -> list:
    """The arrays of a pair of blocks; bits as rows, sets as they are."""
    cells = []
    for column in batch.columns:
        values = column[row].values
        if pa.types.is_list(values.type):
            cells.append(np.asarray(values.flatten()).reshape(-1, 2 * PLANES).view(np.uint64))
        else:
            cells.append(values if pa.types.is_binary(values.type) else np.asarray(values))
    return cells


def _open(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that classes in one bucket (key, doc_id, component, size) may link.

    A task puts out a pair of components only if it has not joined them before, so what comes out
    grows with the components, not with the pairs.
    """
    columns = ["doc_id", "component", "n_shingles", "bits"]
    rows = members.join(classes.select("doc_id", "n_shingles", "bits"), "doc_id")
    meet = _pairs_of_blocks(rows, "key", F.ceil(F.col("size") / BLOCK), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                cells = _cells(batch, row)
                for i, at in _near(cells[:4], cells[4:], percent):
                    own = int(cells[1][i])
                    found += [(own, o) for o in np.unique(cells[5][at]).tolist() if joined.join(own, o)]
            yield _two(found)

    return meet.mapInArrow(run, "a long, b long")


def _two(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components of a group (rows: family, doc_id, component, n_shingles, bits, members).

    Blocks of a bounded number of bytes meet; inside a task every pair across components that the
    estimate allows is compared on its full sets, unless links found before have joined the two.
    """
    sizes = rows.groupBy("family").agg(F.sum(F.length("members")).alias("bytes"))
    columns = ["doc_id", "component", "n_shingles", "bits", "members"]
    rows = rows.join(sizes, "family")
    meet = _pairs_of_blocks(rows, "family", F.ceil(F.col("bytes") / BLOCK_BYTES), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                cells = _cells(batch, row)
                for i, at in _near(cells[:4], cells[5:9], percent):
                    own = np.frombuffer(cells[4][i].as_buffer(), np.uint64)
                    for j in at.tolist():
                        a, b = int(cells[1][i]), int(cells[6][j])
                        if joined.find(a) != joined.find(b):
                            if _similar(own, np.frombuffer(cells[9][j].as_buffer(), np.uint64), percent):
                                joined.join(a, b)
                                found.append((a, b))
            yield _two(found)

    return meet.mapInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id, kept.

    `words` is the shingle length and `percent` the least similarity.  `component_id` is the smallest
    id that can be reached by links; `kept` marks the documents that are their component's smallest.
    """
    # every step that sends texts or sets to Python is staged, so it runs in here
    with small_batches(df.sparkSession, BATCH):
        return _near_duplicates(df, id_column, text, words, percent)


def _near_duplicates(df: DataFrame, id_column: str, text: str, words: int, percent: int) -> DataFrame:
    signed = stage(signatures(df, id_column, text, words), "signed")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_hash").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    )
    classes = stage(classes, "classes")

    banded = classes.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    buckets = stage(buckets.filter("size > 1"), "buckets")
    members = stage(_may_be(banded, "key", buckets).join(buckets, "key"), "members")
    stars = members.filter("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    stars = stage(_with_signs(stars, classes, percent), "stars")

    # every class of a bucket of three or more may still be compared with another than its smallest
    wanted = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id")))
    sets = stage(_sets(df, wanted, id_column, text, words), "sets")
    links = stage(_confirmed(stars, sets, percent), "links")
    parts = components(links)

    larger = members.filter("size > 2").select("key", "doc_id", "size")
    larger = larger.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    larger = stage(larger.withColumn("component", F.coalesce("component", "doc_id")), "larger")
    open_keys = larger.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    mixed = larger.join(open_keys.select("key"), "key", "left_semi")
    families = stage(components(_open(mixed, classes, percent)), "families")
    if not families.isEmpty():
        # all classes of the components that may be linked; the sets made before are used again
        named = classes.select("doc_id", "n_shingles", "bits").join(parts, F.col("doc_id") == F.col("node"), "left")
        named = named.withColumn("part", F.coalesce(F.col("component"), F.col("doc_id"))).drop("node", "component")
        found = families.select(F.col("node").alias("part"), F.col("component").alias("family"))
        named = stage(named.join(found, "part").withColumnRenamed("part", "component"), "named")
        rest = named.select("doc_id").join(sets.select("doc_id"), "doc_id", "left_anti")
        more = sets.unionByName(_sets(df, rest, id_column, text, words))
        between = _linked(named.join(more, "doc_id"), percent)
        # links between components and links to their smallest: the same components
        parts = components(links.unionByName(between))

    # equal sets share their class's component
    named = classes.select("set_hash", F.col("doc_id").alias("node")).join(parts, "node", "left")
    named = named.select("set_hash", F.coalesce("component", "node").alias("component_id"))
    found = signed.drop("bands", "bits").join(named, "set_hash", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def keep_representatives(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """`df` without the documents that are near duplicates of one with a smaller id."""
    groups = near_duplicates(df, id_column, text, words, percent)
    name = free_name(df, "dropped_id")
    dropped = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return df.join(dropped, df[id_column] == dropped[name], "left_anti")


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
