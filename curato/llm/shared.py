"""Scratch tables in the cluster's shared folder, and hashing of whole Arrow text columns in numpy.

Words are maximal runs of bytes outside space and tab..carriage return, which in UTF-8 is the same as the pattern
``[^\\x20\\x09-\\x0D]+`` over code points. All of them are hashed at once: bytes weighted by drawn odd numbers, one a place,
are summed per word, and word hashes weighted by powers of an odd base are summed per window (Rabin-Karp), all modulo 2**64.
Powers would not do for bytes: words built like the Thue-Morse sequence have equal sums under any odd base. A long document
is hashed in pieces that end at blanks, so arrays of a byte's size never follow the length of a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curato.session import shared_folder

#: Text bytes hashed at a time; temporary arrays take about thirty times as much.
BLOCK_BYTES = 2 << 20
GOLD, ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: no lineage is left, and losing an executor loses nothing."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by keep()."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split("/")[-2] == shared_folder(spark).rsplit("/", 1)[-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK_BYTES; a longer document is a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def place_weights(n: int) -> np.ndarray:
    """An odd number for each place of a byte in its word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def pieces(data: np.ndarray, blank: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many bytes that end behind a blank, or at the end; a longer run without blanks is one range."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + most)
        if hi < len(data):
            if len(gap := np.flatnonzero(blank[data[lo:hi]])):
                hi = lo + int(gap[-1]) + 1
            else:
                while hi < len(data) and not blank[data[hi - 1]]:
                    at = np.flatnonzero(blank[data[hi : hi + most]])
                    hi = hi + int(at[0]) + 1 if len(at) else min(len(data), hi + most)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of the first word of each document (one more at the end)."""
    hashes, starts = hashed_words(data, offsets, lower, SPACE)
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of bytes that are not blank, and the byte at which it starts; runs end with their document."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for lo, hi in pieces(data, blank, 2 * BLOCK_BYTES):
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        hashes, starts = _hashed_piece(LOWER[data[lo:hi]] if lower else data[lo:hi], inner, blank)
        parts.append((hashes, starts + lo))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hashed_piece(data: np.ndarray, inner: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~blank[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    opens[inner] = word[inner]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # bytes before the first word are blank; the others count from the start of the word before them
    inside = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    inside[~word] = 0
    value = (data.astype(np.uint64) + np.uint64(1)) * place_weights(int(inside.max()) + 1)[inside]
    value[~word] = 0
    return mix(np.add.reduceat(value, starts)), starts


def windows(words: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the number of the first run of each document.

    short: a document of 1 to k-1 words counts as one run of all its words; else it has none.
    """
    n = np.diff(first)
    runs = np.maximum(n - k + 1, 0)
    if short:
        runs[(n > 0) & (n < k)] = 1
    begin = np.r_[0, np.cumsum(runs)]
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    start = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], runs)
    out = np.zeros(len(start), np.uint64)
    left = np.repeat(first[1:], runs) - start
    weight = powers(ROLL, k)
    for i in range(k):
        if short:
            out += np.where(left > i, words[np.minimum(start + i, len(words) - 1)] * weight[i], np.uint64(0))
        else:
            out += words[start + i] * weight[i]
    return mix(out + np.repeat(np.minimum(n, k).astype(np.uint64), runs)), begin


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted inside it, and where each document begins."""
    values, begin = windows(words, first, k, short=True)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])][: len(values)]
    return values[new], np.searchsorted(doc[new], np.arange(len(begin)))


def range_bucket(value, bounds: list[int]):
    """How many of the ascending bounds are <= value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))
