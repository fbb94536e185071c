"""Token files: one wavelet matrix per shard of documents.

Texts are encoded by a tokenizer of the tokenizers library, an end id is appended to each, and the ids
of all documents, in order of their document id, are cut into shards.  A shard is one file: the bits of
its ids, plane by plane from the highest, where each plane is ordered by the bits above (zeros first).
Planes are kept in compressed blocks with the number of ones before each, so that an id at a place, the
number of occurrences of an id before a place and the place of its n-th occurrence read a block or two
per plane.  Nothing else is stored of the ids.

File: header, zeros of each plane, document ids, their validity and the starts of documents, ones
before each block, ends of blocks, blocks; all little-endian.  A block that compression would not
shorten is stored as it is.

Files are written beside their final name and renamed; names and contents follow from the rows alone,
so a task that runs again writes the same files.  The table of shards is what Spark has committed.

Null text counts as empty and has the end id only.  Rows without an id come first; rows that repeat an
id are ordered by a hash of their text, equal rows stand next to each other.  An empty table gives no
files.  Other columns of the input are not looked at.  Texts are encoded in parts of about a megabyte,
cut where no token can cross.
"""

from __future__ import annotations

import array
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import query, table
from folioscope.session import stage, staging_root

SHARD = 2_000_000  # ids; a shard ends with the document that reaches them
BLOCK = 8192  # bytes of a plane that are compressed together
HELD_BLOCKS = 512  # decompressed blocks that a reader keeps
CACHED = 400_000  # pieces of text whose ids a worker keeps, twice
PART = 1 << 20  # characters encoded at once
HEAD = "<4sBBHQQ"
MAGIC = b"WMX1"


# encoding

DOUBLE_BLANK = re.compile(r"\s[ \n]").search
AT_BLANK = re.compile(r"(?<=\S)(?=[ \n])")
# letters, perhaps with marks behind them, that every cut leaves together
SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
ID = attrgetter("id")
# byte-level tokenizers write bytes as characters: printable Latin-1 as itself, the rest from 256 on
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
_others = [b for b in range(256) if b not in _plain]
BYTE_SIGNS = {b: b for b in _plain} | {b: 256 + i for i, b in enumerate(_others)}


class _Remembered(dict):
    """Ids of pieces; a full table becomes the old one and what is asked again moves over."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Ids of texts as little-endian numbers of `width` bytes, as the tokenizer gives them.

    A byte-level tokenizer lets no token cross a place between a character and a blank, so pieces
    between blanks are encoded once and remembered.  Any other tokenizer gets whole texts.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width, self.kind = (2, "H") if size <= 1 << 16 else (4, "I")
        self.levels = max(1, (size - 1).bit_length())
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = re.compile("|".join(added)).search if added else lambda text: None
        self.by_pieces = self._is_byte_level()
        self.spaced = _Remembered(self._spaced)  # after a blank that the key leaves out, or from a line end on
        self.bare = _Remembered(self._bare)
        self.model = self.tokenizer.model

    def _is_byte_level(self) -> bool:
        import json

        kind = json.loads(self.tokenizer.to_str())
        cut, model = kind.get("pre_tokenizer") or {}, kind["model"]
        return (
            kind.get("normalizer") is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and (model.get("type"), model.get("dropout")) == ("BPE", None)
        )

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _word(self, signs: str) -> bytes:
        return array.array(self.kind, map(ID, self.model.tokenize(signs))).tobytes()

    def _letters(self, word: str, blank: str) -> bytes:
        return self._word(blank + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)))

    def _cut(self, piece: str) -> bytes:
        return b"".join([self._word(signs) for signs, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)])

    def _bare(self, piece: str) -> bytes:
        simple = SIMPLE(piece)
        if simple is None:
            return self._cut(piece)
        word, marks = simple.groups()
        return self.bare[word] + self.bare[marks] if marks else self._letters(word, "")

    def _spaced(self, piece: str) -> bytes:
        if piece[:1] == "\n":
            alone = piece[1:2].strip()  # a line end before another blank belongs to it
            return self.bare["\n"] + self.bare[piece[1:]] if alone else self._cut(piece)
        simple = SIMPLE(piece)
        if simple is None:
            return self._cut(" " + piece)
        word, marks = simple.groups()
        return self.spaced[word] + self.bare[marks] if marks else self._letters(word, "Ġ")

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, text: str) -> bytes:
        if DOUBLE_BLANK(text):
            return b"".join([self.bare[piece] for piece in AT_BLANK.split(text)])
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0], first = "", self.bare[pieces[0]] if pieces[0] else b""
        return first + b"".join(map(self.spaced.__getitem__, pieces[1:]))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_pieces or self.has_added(text):
            return self._whole(text)
        if len(text) <= PART:
            return self._part(text)
        parts, start = [], 0
        while len(text) - start > PART and (cut := AT_BLANK.search(text, start + PART)):
            parts.append(self._part(text[start : cut.start()]))
            start = cut.start()
        return b"".join([*parts, self._part(text[start:])])


class SharedEncoder:
    """Sent to the workers as the tokenizer's definition; a worker builds its encoder once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.definition = file.read()
        self.built: Encoder | None = None

    def __getstate__(self) -> dict:
        return {"definition": self.definition, "built": None}

    def get(self) -> Encoder:
        if self.built is None:
            self.built = Encoder(self.definition)
        return self.built


# the file


def _where(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Ids whose bit in the packed mask is set; twice as fast as by an array of truth values."""
    chosen = pa.BooleanArray.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(mask)])
    return pa.array(ids).filter(chosen).to_numpy(zero_copy_only=False)


def compress(ids: np.ndarray, levels: int, documents: list[int | None], starts: np.ndarray) -> bytes:
    """The file of a shard: `starts` has the first place of each document and the number of ids."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    zeros, ones, ends, blocks = [], [], [], []
    blocks_per_plane = -(-len(ids) // (8 * BLOCK))
    for level in range(levels - 1, -1, -1):
        packed = np.packbits(ids & ids.dtype.type(1 << level) != 0, bitorder="little")
        per_block = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), BLOCK)) if len(packed) else []
        ones.append(np.concatenate([[0], np.cumsum(per_block)]))
        for at in range(0, len(packed), BLOCK):
            raw = packed[at : at + BLOCK].tobytes()
            short = squeeze(raw)
            blocks.append(short if len(short) < len(raw) else raw)
            ends.append(len(blocks[-1]))
        low, high = (_where(ids, mask) for mask in (~packed, packed))
        zeros.append(len(low))
        ids = np.concatenate([low, high])
    known = np.array([d is not None for d in documents], np.uint8)
    head = struct.pack(HEAD, MAGIC, levels, 1, 0, len(ids), len(documents))
    sections = [
        np.array(zeros, "<u8"),
        np.array([d or 0 for d in documents], "<i8"),
        known,
        starts.astype("<u8"),
        np.concatenate(ones).astype("<u8") if blocks_per_plane else np.zeros(levels, "<u8"),
        np.concatenate([[0], np.cumsum(ends)]).astype("<u8"),
    ]
    return b"".join([head, *(s.tobytes() for s in sections), *blocks])


class WaveletMatrix:
    """Reader of a shard; `read(offset, size)` gives bytes of its file.

    Places are counted within the shard.  Blocks are read and decompressed when asked for.
    """

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.levels, version, _, self.n, docs = struct.unpack(HEAD, read(0, struct.calcsize(HEAD)))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file of this kind")
        at = struct.calcsize(HEAD)

        def section(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(read(at, count * np.dtype(kind).itemsize), kind)
            at += values.nbytes
            return values

        self.blocks = -(-self.n // (8 * BLOCK))
        self.zeros = section("<u8", self.levels).astype(np.int64)
        self.documents = section("<i8", docs)
        self.known = section("u1", docs).astype(bool)
        self.starts = section("<u8", docs + 1).astype(np.int64)
        self.ones = section("<u8", self.levels * (self.blocks + 1)).astype(np.int64).reshape(self.levels, -1)
        self.ends = section("<u8", self.levels * self.blocks + 1).astype(np.int64)
        self.data, self.held = at, {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        """Packed bits of one block."""
        key = plane * self.blocks + block
        if key not in self.held:
            import zstandard

            if len(self.held) >= HELD_BLOCKS:
                self.held.clear()
            raw = self.read(self.data + int(self.ends[key]), int(self.ends[key + 1] - self.ends[key]))
            size = min(BLOCK, -(-self.n // 8) - block * BLOCK)
            if len(raw) < size:
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
            self.held[key] = np.frombuffer(raw, np.uint8)
        return self.held[key]

    def _ranked(self, plane: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at each place, ones before it); a place may be the end, its bit is zero then."""
        bits, before = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        block = places // (8 * BLOCK)
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            before[own] = self.ones[plane, b]
            if b == self.blocks:
                continue
            packed = self._block(plane, int(b))
            inside = places[own] - b * 8 * BLOCK
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            byte = np.append(packed, 0)[inside >> 3].astype(np.int64)
            before[own] += counts[inside >> 3] + np.bitwise_count(byte & ((1 << (inside & 7)) - 1))
            bits[own] = byte >> (inside & 7) & 1
        return bits, before

    def access(self, places: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        places = np.asarray(places, np.int64)
        ids = np.zeros(len(places), np.int64)
        for plane in range(self.levels):
            bits, before = self._ranked(plane, places)
            ids = ids << 1 | bits
            places = np.where(bits == 1, self.zeros[plane] + before, places - before)
        return ids

    def _run(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of `token` in places low to high stand below the last plane."""
        if token < 0 or token >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            (before, upto) = self._ranked(plane, np.array([low, high]))[1]
            if token >> (self.levels - 1 - plane) & 1:
                low, high = int(self.zeros[plane] + before), int(self.zeros[plane] + upto)
            else:
                low, high = int(low - before), int(high - upto)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of `token` in places from `low` to before `high`."""
        start, end = self._run(token, low, self.n if high is None else high)
        return end - start

    def select(self, token: int, nth: np.ndarray | None = None) -> np.ndarray:
        """Places of the n-th occurrences of `token`, from 0 on; of all of them without `nth`."""
        start, end = self._run(token, 0, self.n)
        places = np.arange(start, end) if nth is None else start + np.asarray(nth, np.int64)
        if len(places) and (places.min() < start or places.max() >= end):
            raise IndexError("no such occurrence")
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            wanted = places - bit * self.zeros[plane]  # the how-manieth one or zero of the plane
            sizes = np.arange(self.blocks + 1) * 8 * BLOCK
            sums = self.ones[plane] if bit else sizes - self.ones[plane]
            block = np.searchsorted(sums, wanted, "right") - 1
            places = np.empty(len(wanted), np.int64)
            for b in np.unique(block):
                own = np.flatnonzero(block == b)
                at = np.flatnonzero(np.unpackbits(self._block(plane, int(b)), bitorder="little") == bit)
                places[own] = b * 8 * BLOCK + at[wanted[own] - sums[b]]
        return places

    def all(self) -> np.ndarray:
        """Ids of the whole shard in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for plane in range(self.levels - 1, -1, -1):
            packed = [self._block(plane, b) for b in range(self.blocks)]
            bits = np.unpackbits(np.concatenate(packed), count=self.n, bitorder="little").view(bool) if packed else np.zeros(0, bool)
            above, zeros = np.empty_like(ids), self.zeros[plane]
            above[~bits] = ids[:zeros]
            above[bits] = ids[zeros:] | kind(1 << (self.levels - 1 - plane))
            ids = above
        return ids


# Spark


def _files(folder: str):
    """(file system, path) of a folder; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, content: bytes) -> None:
    store, path = _files(folder)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    try:
        store.move(draft, f"{path}/{name}")
    except OSError:  # some stores do not replace: an earlier attempt has written the same
        if not store.get_file_info(f"{path}/{name}").is_file:
            raise
        store.delete_file(draft)


def open_shard(folder: str, name: str, whole: bool = False) -> WaveletMatrix:
    """Reader of one file; `whole` reads it at once."""
    store, path = _files(folder)
    file = store.open_input_file(f"{path}/{name}")
    if whole:
        with file:
            content = file.read()
        return WaveletMatrix(lambda at, size: content[at : at + size])
    return WaveletMatrix(lambda at, size: file.read_at(size, at))


@dataclass
class TokenFiles:
    """`folder` of files and `shards(shard, n_tokens, n_documents, bytes, start)`, one row per file."""

    folder: str
    shards: DataFrame

    def _each(self, work: Callable[[WaveletMatrix, int], Iterator[pa.RecordBatch]], schema: str, whole: bool) -> DataFrame:
        """`work` on the reader and the first place of every shard."""
        folder, spark = self.folder, self.shards.sparkSession
        count = self.shards.count()
        tasks = min(count, max(4 * spark.sparkContext.defaultParallelism, count // 64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield from work(open_shard(folder, name, whole), start)

        names = self.shards.select("shard", "start")
        return (names.repartitionByRange(tasks, "shard") if tasks > 1 else names).mapInArrow(run, schema)

    def documents(self, value: Callable[[np.ndarray], object], name: str, kind: str) -> DataFrame:
        """(doc_id, start, n_tokens, `name`): `value` is made from a document's ids, read from the files.

        Whole numbers are long.
        """

        def work(matrix: WaveletMatrix, base: int) -> Iterator[pa.RecordBatch]:
            ids, starts = matrix.all(), matrix.starts
            for low in range(0, len(matrix.documents), 10_000):
                cut = slice(low, low + 10_000)
                begin, end = starts[:-1][cut], starts[1:][cut]
                values = [value(ids[a:b]) for a, b in zip(begin, end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.documents[cut], mask=~matrix.known[cut]), pa.array(base + begin), pa.array(end - begin), pa.array(values)],
                    ["doc_id", "start", "n_tokens", name],
                )

        return self._each(work, f"doc_id long, start long, n_tokens long, {name} {kind}", True)

    def counts(self, tokens: list[int]) -> DataFrame:
        """(token, n): occurrences of each id in all files."""

        def work(matrix: WaveletMatrix, base: int) -> Iterator[pa.RecordBatch]:
            found = [matrix.count(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(found, pa.int64())], ["token", "n"])

        return self._each(work, "token long, n long", False).groupBy("token").agg(F.sum("n").alias("n"))

    def occurrences(self, tokens: list[int]) -> DataFrame:
        """(token, doc_id, at): every place of each id, counted within its document."""

        def work(matrix: WaveletMatrix, base: int) -> Iterator[pa.RecordBatch]:
            for token in tokens:
                for low in range(0, matrix.count(token), 100_000):
                    places = matrix.select(token, np.arange(low, min(low + 100_000, matrix.count(token))))
                    doc = np.searchsorted(matrix.starts, places, "right") - 1
                    ids = pa.array(matrix.documents[doc], mask=~matrix.known[doc])
                    columns = [pa.array(np.full(len(places), token)), ids, pa.array(places - matrix.starts[doc])]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "doc_id", "at"])

        return self._each(work, "token long, doc_id long, at long", False)


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 0, id_column: str = "doc_id", text: str = "text"
) -> TokenFiles:
    """Encode all texts and write the token files in ascending order of the id.

    `folder` must be one that all executors see; by default it is a new one in the shared folder.
    """
    spark = docs.sparkSession
    if folder is None:
        root = staging_root(spark)
        if root is None:
            raise ValueError("name a folder that all executors see, or set spark.checkpoint.dir")
        folder = f"{root}/tokens-{uuid.uuid4().hex}"
    store, path = _files(folder)
    store.create_dir(path, recursive=True)
    shared = spark.sparkContext.broadcast(SharedEncoder(tokenizer))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared.value.get(), TaskContext.get().partitionId()
        last, kind = encoder.pack([end]), f"<u{encoder.width}"
        ids, documents, starts, number = [], [], [0], 0

        def close() -> pa.RecordBatch:
            nonlocal number
            name = f"part-{part:08d}-{number:06d}.wmx"
            content = compress(np.frombuffer(b"".join(ids), kind), encoder.levels, documents, np.array(starts))
            _put(folder, name, content)
            row = [[name], [starts[-1]], [len(documents)], [len(content)]]
            ids.clear(), documents.clear(), starts.clear(), starts.append(0)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["shard", "n_tokens", "n_documents", "bytes"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1)):
                ids.append(encoder.ids(body.as_py() or "") + last)
                documents.append(doc_id.as_py())
                starts.append(starts[-1] + len(ids[-1]) // encoder.width)
                if starts[-1] >= SHARD:
                    yield close()
        if documents:
            yield close()

    # equal ids are ordered by their text, so that they neither meet in one task nor change places
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = stage(ordered.mapInArrow(write, "shard string, n_tokens long, n_documents long, bytes long"), "token-shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return TokenFiles(folder, shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))))


def ids_crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return files.documents(ids_crc32, "ids_crc32", "long")
