"""Byte-level BPE in linear time.

Token bytes are read as Latin-1, so that one character is one byte, and go into an Aho-Corasick
automaton.  A piece is cut by taking the longest token at each place and stepping back to a shorter
one where two neighbours could not both be left over by the merges; whether they could is remembered
per pair of tokens.  The only sequence in which all neighbours agree is the one the merges make.

Null text is empty; an empty text has no ids.  Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import query, table

# entries that a worker remembers in each of two generations
CACHED_PARTS = 250_000
CACHED_PIECES = 100_000
CACHED_PAIRS = 500_000
LONGEST = 64  # characters of a remembered part
SLICE_BYTES = 4 << 20  # of text that a worker turns into ids at a time

TWO_BLANKS = re.compile(r"\s ").search
CUT = re.compile(r"(?<=\S)(?= )").split


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Lines of base64 token and rank, as a list in order of rank."""
    with open(path, "rb") as lines:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
    return sorted(pairs, key=lambda pair: pair[1])


class Remembered(dict):
    """Values made on demand.  When `limit` are held they become the old generation, from which what is
    asked for again moves back: frequent keys stay, and no more than twice `limit` are held."""

    def __init__(self, make: Callable, limit: int, holds: Callable = lambda key: True):
        super().__init__()
        self.make, self.limit, self.holds = make, limit, holds
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if not self.holds(key):
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _short(part: str) -> bool:
    return len(part) < LONGEST


class Codec:
    """Encoder and decoder for ranks; `ranks` is bounded by the vocabulary, so it may be broadcast."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.rank = {token.decode("latin-1"): r for token, r in ranks}
        self.bytes_of = dict((r, token) for token, r in ranks)
        self.length = {r: len(token) for token, r in ranks}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.agreeing = Remembered(self._longest_beside, CACHED_PAIRS)
        self.shorter: dict[int, int] = {}  # the longest token it begins with; -1 if none
        # ids as packed 32-bit integers: of pieces, of parts, of parts that follow a space
        self.packed = Remembered(self._pack, CACHED_PIECES, _short)
        self.known = Remembered(self._cut, CACHED_PARTS, _short)
        self.after = Remembered(lambda part: self._cut(" " + part), CACHED_PARTS, _short)
        self.automaton = ahocorasick.Automaton()
        for token, r in ranks:
            word = token.decode("latin-1")
            if len(word) > 1 and not self._split(word, r):
                continue  # no merge makes it: only a whole piece can be this token
            self.automaton.add_word(word, r)
        self.automaton.make_automaton()
        for word, r in self.rank.items():
            prefixes = (word[:n] for n in range(len(word) - 1, 0, -1))
            self.shorter[r] = next((self.rank[p] for p in prefixes if p in self.automaton), -1)

    def _split(self, word: str, r: int) -> bool:
        """Find the two tokens whose merge is `word`: lower ranks that the merges leave side by side."""
        for at in range(1, len(word)):
            a, b = self.rank.get(word[:at], r), self.rank.get(word[at:], r)
            if a < r and b < r and self._whole(a) and self._whole(b) and self._neighbours(a, b):
                self.halves[r] = (a, b)
                self.merged[a, b] = r
                return True
        return False

    def _whole(self, r: int) -> bool:
        return self.length[r] == 1 or r in self.halves

    def _neighbours(self, left: int, right: int) -> bool:
        """Would the merges leave these two tokens side by side?

        Undo the merges of both from the last one on.  At each step the pair that meets at the border
        must not merge earlier than the merge that was undone there.
        """
        before = float("inf")  # the border pair must not have a merge that comes before this
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            if left > right:
                if self.length[left] == 1:
                    return True
                before, left = left, self.halves[left][1]
            elif self.length[right] == 1:
                # bytes have no halves; go on with the left side if it still has some
                if self.length[left] == 1:
                    return True
                before, left = left, self.halves[left][1]
            else:
                # equal ranks merge from left to right, so a tie goes to the left pair
                before, right = right + 0.5, self.halves[right][0]

    def _longest_beside(self, pair: tuple[int, int]) -> int:
        """The longest beginning of the second token that the merges leave beside the first; -1 if none."""
        left, right = pair
        while right >= 0 and not self._neighbours(left, right):
            right = self.shorter[right]
        return right

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size, length, agreeing = len(piece), self.length, self.agreeing
        longest = self.automaton.iter_long(piece)  # longest tokens from `at` on
        dead = None  # places from which nothing goes on
        ids: list[int] = []
        last, at = -1, 0
        _, token = next(longest)
        while True:
            if last >= 0 and token >= 0:
                fitting = agreeing[last, token]
                if fitting != token:
                    token, longest = fitting, None
            if token < 0:  # shorten the token before
                if dead is None:
                    dead = bytearray(size + 1)
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                last = ids[-1] if ids else -1
                token, longest = self.shorter[token], None
                continue
            end = at + length[token]
            if dead is not None and dead[end]:
                token, longest = self.shorter[token], None
                continue
            ids.append(token)
            if end == size:
                return ids
            last, at = token, end
            if longest is None:
                longest = self.automaton.iter_long(piece, at)
            _, token = next(longest)

    def _pack(self, piece: str) -> bytes:
        return array("i", self.encode_piece(piece.encode("utf-8").decode("latin-1"))).tobytes()

    def _cut(self, part: str) -> bytes:
        pieces = self.pieces(part)
        if len(pieces) == 1:  # the part itself is remembered
            return self._pack(part)
        return b"".join(map(self.packed.__getitem__, pieces))

    def packed_ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers.

        No piece goes on past a non-blank into a blank, so the text may be cut before each space that
        follows a non-blank; what lies between such cuts is remembered.
        """
        if TWO_BLANKS(text):
            return b"".join(map(self.known.__getitem__, CUT(text)))
        first, *rest = text.split(" ")
        return self.known[first] + b"".join(map(self.after.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed_ids(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_held: dict[str, Codec] = {}


def _codec(ranks: list[tuple[bytes, int]], pattern: str, name: str) -> Codec:
    """The process's codec; it stays for later batches and tasks, and only one is held."""
    codec = _held.get(name)
    if codec is None:
        _held.clear()
        codec = _held[name] = Codec(ranks, pattern)
    return codec


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:]):
        yield batch.slice(start, end - start)


def _ids(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, and the ids of all of them one after the other."""
    made = [codec.packed_ids(value.as_py() or "") for value in texts]
    offsets = np.zeros(len(made) + 1, np.int32)
    np.cumsum([len(m) // 4 for m in made], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(made), np.int32)


def _token_table(ranks: list[tuple[bytes, int]]) -> pa.Array:
    """Token bytes at the place of their id; ids without a token are null."""
    tokens: list[bytes | None] = [None] * (1 + max(r for _, r in ranks))
    for token, r in ranks:
        tokens[r] = token
    return pa.array(tokens, pa.large_binary())


def _joined(tokens: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The bytes of each row's ids: the tokens laid side by side, cut where the rows end."""
    taken = tokens.take(pa.array(ids, pa.int32()))
    if taken.null_count:
        raise ValueError(f"{taken.null_count} ids have no token")
    places, data = (taken.buffers()[i] for i in (1, 2))
    ends = np.frombuffer(places, np.int64, len(ids) + 1)[offsets]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), data])
    return whole.cast(pa.binary())


def _with(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns at its end, in place of those of the same names."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in made]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(made.values()), [n for n, _ in kept] + list(made))


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """`df` with the array column `ids`: the token ids of every whole text (null text: no ids).

    With `decoded`, also with a binary column of that name: the bytes that the ids stand for, made in
    the same pass.  It may be the text's own column.  Columns of the new names are replaced.  Runs in
    the scan task, without a shuffle; the ranks, whose size is that of the vocabulary, are broadcast.
    """
    name = f"{path}\n{pattern}"
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern, name)
        tokens = _token_table(ranks.value) if decoded is not None else None
        for batch in batches:
            for part in _slices(batch, text):
                offsets, flat = _ids(codec, part.column(text))
                made = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
                if decoded is not None:
                    made[decoded] = _joined(tokens, offsets, flat)
                yield _with(part, made)

    new = {ids: "array<int>"} | ({} if decoded is None else {decoded: "binary"})
    base = df.drop(*[c for c in new if c != text])
    shape = base.drop(*new).withColumns({c: F.lit(None).cast(t) for c, t in new.items()})
    return base.mapInArrow(run, shape.schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the binary column `decoded`: the bytes of the ids (null ids: no bytes)."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_table(ranks.value)
        for batch in batches:
            rows = batch.column(ids)
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            yield _with(batch, {decoded: _joined(tokens, offsets, flat)})

    base = df.drop(decoded) if decoded in df.columns else df
    return base.mapInArrow(run, base.withColumn(decoded, F.lit(None).cast("binary")).schema)


def vocabulary() -> tuple[str, str]:
    """Path of the public ranks and the pattern that cuts text into pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, path, pattern, decoded="text")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
