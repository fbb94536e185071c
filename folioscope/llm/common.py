"""What the operators share: tables, words, word hashes and Arrow batches of whole documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII blanks; bytes.split() without an argument cuts at exactly these
BLANKS = r"[\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL where SQL can express it."""

    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def utf8_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't use, whatever columns the caller brings."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


class WordHash(dict):
    """64-bit hash per word, kept for as many words as `limit`; the same in every process."""

    def __init__(self, limit: int = 150_000, salt: bytes = b"word"):
        super().__init__()
        self.limit, self.salt = limit, salt

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=self.salt).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of every string of an Arrow column, without decoding; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow of a generator over batches; batches without rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(b for b in batches if b.num_rows)

    return df.mapInArrow(run, schema)
