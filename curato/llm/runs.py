"""Periodic runs of words, found by probing a harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least LEAST words and TIMES times q long, which no
neighbouring word extends. For each period p, words are compared at jp and (j+1)p only: a run with period p has at least
2p places that equal the one p further on, hence two grid points side by side whose comparisons hold. All periods of a text
take about n ln n comparisons, made in numpy. Many survivors are first thinned by places between their grid points, all at
once; those left are extended to both sides by comparing chunks that double. Grid points of the same period inside a stretch already
extended are skipped, and so are those of a multiple of a found run's period inside that run: as periods come in ascending
order, each stretch is met first with its smallest period (a run of three periods p with a smaller period q has one that
divides p, and both extend equally far).

Words are compared as numbers given to distinct words in a dictionary, so equality is exact. Probes are made for some periods
at a time, so that arrays stay bounded however long a text is.

Defined results: a null text has no words. A null doc_id has no number to fold words by, so its words stay as they are. Rows
that repeat a doc_id are each searched. Texts without runs have n_runs 0, nulls for the longest, and the digest of no bytes.
An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST, TIMES = 24, 3
#: Probes of a text that are made at a time, words numbered before numbers start afresh, and bounds of a compared chunk.
PROBES, NUMBERED, CHUNK, LARGEST = 1 << 19, 1 << 20, 32, 1 << 14
#: Places between grid points that many survivors are tested at; few are extended at once.
BETWEEN, FEW = 64, 16


def probes(codes: np.ndarray, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and grid points, ascending, at which this and the next comparison of the grid hold."""
    n = len(codes)
    most, low = n // times, 1
    while low <= most:
        # the first period of a batch has the most grid points
        high = min(most, low + max(1, PROBES // max(1, (n - 1) // low)) - 1)
        p = np.arange(low, high + 1)
        points = (n - 1) // p
        begin = np.cumsum(points) - points
        period = np.repeat(p, points)
        at = (np.arange(len(period)) - np.repeat(begin, points)) * period
        same = codes[at] == codes[at + period]
        hit = np.flatnonzero(same[:-1] & same[1:] & (period[:-1] == period[1:]))
        period, at = period[hit], at[hit]
        if len(at):
            yield period, at
        low = high + 1


def thinned(codes: np.ndarray, period: np.ndarray, at: np.ndarray, found: dict[int, tuple[list, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Survivors outside found runs whose period divides theirs, as long as the places up to the next grid point agree too.

    Where a few words make up most of a text nearly all probes hold, and are told apart here, all at once, one place a round.
    """
    for q, (starts, ends) in found.items():
        fit = np.flatnonzero(period % q == 0)
        if len(fit):
            own = np.searchsorted(starts, at[fit], "right") - 1
            out = fit[(own >= 0) & (at[fit] + period[fit] < np.array(ends)[own])]
            period, at = np.delete(period, out), np.delete(at, out)
    for place in (0.5, 0.25, 0.8, *range(1, BETWEEN)):
        if len(at) <= FEW:
            break
        there = at + (period * place).astype(np.int64) if place < 1 else at + np.minimum(place, period)
        agree = codes[there] == codes[there + period]
        period, at = period[agree], at[agree]
    return period, at


def stretch(codes: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The first place and the one behind the last of the places around at that equal the one p further on."""
    n, hi, size = len(codes) - p, at, CHUNK
    while hi < n:
        to = min(n, hi + size)
        differ = codes[hi:to] != codes[hi + p : to + p]
        step = int(differ.argmax())
        if differ[step]:
            hi += step
            break
        hi, size = to, min(2 * size, LARGEST)
    lo, size = at, CHUNK
    while lo > 0:
        to = max(0, lo - size)
        differ = (codes[to:lo] != codes[to + p : lo + p])[::-1]
        step = int(differ.argmax())
        if differ[step]:
            lo -= step
            break
        lo, size = to, min(2 * size, LARGEST)
    return lo, hi


def find_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. times is at least 2."""
    found: dict[int, tuple[list, list]] = {}  # by period: where runs start, and end
    for period, at in probes(codes, times):
        period, at = thinned(codes, period, at, found)
        edges = np.flatnonzero(np.r_[True, period[1:] != period[:-1], True]) if len(at) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            p, points = int(period[a]), at[a:b]
            for q, (starts, ends) in found.items():
                if p % q == 0:
                    own = np.searchsorted(starts, points, "right") - 1
                    points = points[(own < 0) | (points + p >= np.array(ends)[own])]
            points, i = points.tolist(), 0
            while i < len(points):
                lo, hi = stretch(codes, points[i], p)
                if hi - lo + p >= max(least, times * p):
                    starts, ends = found.setdefault(p, ([], []))
                    starts.append(lo)
                    ends.append(hi + p)
                i = max(i + 1, bisect_left(points, hi))
    return sorted((lo, hi - lo, p) for p, (starts, ends) in found.items() for lo, hi in zip(starts, ends, strict=True))


def after_first(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        steps[start + p] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, compared exactly; of equal ones the first start, then the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def folded(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a text whose words repeat from some place on, or None if all stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


class Numbers(defaultdict):
    """A number for each distinct word, in the order of coming."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > NUMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _searched(df: DataFrame, schema: T.StructType, row, doc_id: str, text: str) -> DataFrame:
    """mapInArrow of row(doc_id, words, numbers of the words), which gives the other columns of schema."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, names = Numbers(), [f.name for f in schema.fields]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for key, value in zip(part.column(0), part.column(1), strict=True):
                    # bytes.split() cuts at space and tab to carriage return, and at nothing else
                    words = (value.as_py() or "").encode().split()
                    out.append(row(key.as_py(), words, numbers.of(words)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(RUN): pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))}
    types = [kinds[f.dataType] for f in schema.fields[1:]]
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    return rows.mapInArrow(work, schema)


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
DIGEST = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)


def runs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, all runs, and the text without what repeats in them, for every row."""
    if times < 2:
        raise ValueError("times: at least 2")

    def row(_, words: list[bytes], codes: np.ndarray) -> tuple:
        runs = find_runs(codes, least, times)
        kept = [words[i] for i in np.flatnonzero(~after_first(runs, len(words)))] if runs else words
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept).decode()

    return _searched(docs, FOUND, row, doc_id, text)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The strongest run and digests of all runs and of the collapsed text, for every row, words folded by doc_id."""

    def row(key: int | None, words: list[bytes], codes: np.ndarray) -> tuple:
        places = folded(key, len(words))
        if places is not None:
            codes = codes[places]
        runs = find_runs(codes)
        kept = np.flatnonzero(~after_first(runs, len(codes))) if runs else np.arange(len(codes))
        collapsed = words if places is None and not runs else [words[i] for i in (kept if places is None else places[kept])]
        best = strongest(runs)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        return len(runs), *told, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed)).hexdigest()

    return _searched(docs, DIGEST, row, doc_id, text)
