"""Words, hashes of words and word shingles of whole texts, over Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed: the 64-bit golden ratio, odd
_KEPT = 1 << 18


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words met before; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        return self.setdefault(word, xxhash.xxh64_intdigest(word))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


@functools.lru_cache(maxsize=1)
def process_own(kind: Callable, *args):
    """One object of a kind for the process, so that the tasks of a Python worker share what they have met. It gives way to
    the next kind, so a worker that runs several stages holds one cache at a time."""
    return kind(*args)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after seeing to it that its session hands at most so many rows at once to Python (10,000 are usual): whole texts can be
    long. This sets spark.sql.execution.arrow.maxRecordsPerBatch of the session, and leaves it so: Spark reads it when the plan
    is carried out, which is later than this call. The setting stays as it is where it is lower already."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def numbered(df: DataFrame) -> DataFrame:
    """df with plain column names, under which any column can be handed to Python, whatever its own name holds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def runs(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts that together have at most so many characters, or of one that has more."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads neighbours (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is the one shingle; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)  # a shorter sequence never equals a whole shingle
    for j in range(width):
        h = scramble(h * _MIX + words[j : n - width + 1 + j])
    return np.unique(h)
