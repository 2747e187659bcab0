"""Substring dedup: Rabin-Karp hashes of every window of 20 words, repeated ones found in Spark and merged to removal intervals.

A window goes if its words also start earlier, by (doc_id, start). Tasks hash all windows of a block of texts in numpy and
deal them by hash to buckets; a window that recurs in a block is sent once, with its first start, and the others are known
to go. So a passage that a third of all texts hold sends as many rows as there are blocks. Per block and bucket one row is
sent: arrays of text numbers, starts and the hash bits that the bucket does not tell, split into byte planes. A bucket's
task sorts its hashes and sends, for each group of texts, the starts of windows that are not the first of their kind. Groups
merge the starts of all buckets into maximal runs of removed words, and a last join brings runs and texts together.

The number of buckets follows from the bytes of text, so that a bucket has about BUCKET_WINDOWS windows at any size. So do the
bits of a hash: they and the bucket's number are so many that all windows together hold two different ones of equal hash with
a chance of 2**-SURE, whatever the size; past 64 bits a second hash of another base gives the rest.

Defined results: a null text has no words; texts under 20 words lose none. A null doc_id counts as the smallest. Rows that
repeat a doc_id are ordered by a hash of their text, and rows that also have equal texts are one document. An empty table
gives an empty table. Other columns are kept by remove_repeats() and ignored by the digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.llm import shared

#: Bytes of text whose windows are sorted at a time; arrays take about fifty times as much.
RUN_BYTES = 4 << 20
WINDOW, BUCKET_WINDOWS, LEAST_BUCKETS, GROUP_TEXTS, SURE = 20, 1 << 20, 64, 512, 8
NULL_ID = -(2**63)
#: Least bytes of text a word takes in practice; it only sizes the number of buckets.
WORD_BYTES = 6
MESSAGE = "bucket int, ids binary, tids binary, counts binary, starts binary, hashes binary, more binary, dead binary"


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of unsigned numbers, plane by plane: high planes are mostly zero and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8") if n else np.zeros(0, np.uint64)


def gaps(ids: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as planes of their differences."""
    return planes(np.diff(ids.view(np.uint64), prepend=np.uint64(0)), 8)


def from_gaps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, 8), dtype=np.uint64).view(np.int64)


def hash_bytes(words: int, buckets: int) -> tuple[int, int]:
    """Bytes of a window's first hash, beside the bits that the bucket tells, and of its second one: of words**2 / 2 pairs
    one collides with a chance of 2**-SURE."""
    width = -(-math.ceil(2 * math.log2(max(words, 2)) - 1 + SURE - math.log2(buckets)) // 8)
    first = (64 - math.ceil(math.log2(buckets))) // 8
    return (max(4, width), 0) if width <= first else (first, width - first)


def deal(batches: Iterator[pa.RecordBatch], buckets: int, width: tuple[int, int], k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("ids", "tids", "counts", "starts", "hashes", "more", "dead")]])
    first_bytes, second = width
    for batch in batches:
        data, offsets = shared.text_buffers(batch.column(2))
        ids, tids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo, hi in _runs(offsets):
            # texts of a run in (doc_id, text hash) order, so the first start in the run is the first of all in it
            order = lo + np.lexsort((tids[lo:hi], ids[lo:hi]))
            values, others, begin = [], [], [np.zeros(1, np.int64)]
            for a, b in shared.blocks(offsets[lo : hi + 1]):
                words, first = shared.word_hashes(data[offsets[lo + a] : offsets[lo + b]], offsets[lo + a : lo + b + 1] - offsets[lo + a])
                v, at = shared.windows(words, first, k, short=False)
                values.append(v)
                if second:
                    others.append(shared.windows(shared.mix(words ^ shared.GOLD), first, k, short=False)[0])
                begin.append(at[1:] + begin[-1][-1])
            values, begin = np.concatenate(values), np.concatenate(begin)
            others = np.concatenate(others) if second else np.zeros(len(values), np.uint64)
            if not len(values):
                continue
            counts = np.diff(begin)
            place = np.empty(hi - lo, np.int64)
            place[order - lo] = np.arange(hi - lo)
            doc = np.repeat(place, counts)  # number in order
            start = np.arange(len(values)) - np.repeat(begin[:-1], counts)
            by = np.lexsort((start, doc, others, values)) if second else np.lexsort((start, doc, values))
            values, others, doc, start = values[by], others[by], doc[by], start[by]
            new = np.r_[True, (values[1:] != values[:-1]) | (others[1:] != others[:-1])]
            # equal rows are one document: same start, same place in the order of all
            named_ids, named_tids = ids[order], tids[order]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            dead = ~new & ~((named_ids[doc] == named_ids[doc[head]]) & (named_tids[doc] == named_tids[doc[head]]) & (start == start[head]))
            bucket = (values >> np.uint64(32)).astype(np.int64) * buckets >> 32
            send = new | dead
            values, others, doc, start, dead, bucket = (x[send] for x in (values, others, doc, start, dead, bucket))
            by = np.lexsort((start, doc, dead, bucket))
            values, others, doc, start, dead, bucket = (x[by] for x in (values, others, doc, start, dead, bucket))
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                x, y = edges[b], edges[b + 1]
                for flag in (False, True):
                    own = slice(x + np.searchsorted(dead[x:y], flag, "left"), x + np.searchsorted(dead[x:y], flag, "right"))
                    d, s = doc[own], start[own]
                    if not len(d):
                        continue
                    at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    gap = np.diff(s, prepend=0)
                    gap[at] = s[at]
                    rows.append((int(b), gaps(named_ids[d[at]]), planes(named_tids[d[at]].view(np.uint64), 8), np.diff(np.r_[at, len(d)]).astype("<u4").tobytes(), planes(gap, 4), *((b"", b"", b"1") if flag else (planes(values[own], first_bytes), planes(others[own], second), b""))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)


def _runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1))
        yield first, last
        first = last


def unfold(ids, tids, counts, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    steps = unplanes(starts, 4).astype(np.int64)
    total = np.cumsum(steps)
    begin = np.r_[0, np.cumsum(n)[:-1]]
    return np.repeat(from_gaps(ids), n), np.repeat(unplanes(tids, 8).view(np.int64), n), total - np.repeat(total[begin] - steps[begin], n)


def folded(ids, tids, starts, groups: int) -> Iterator[tuple]:
    """Starts by group of texts: group, ids, tids, counts and starts."""
    if not len(ids):
        return
    group = (shared.mix(ids.view(np.uint64) ^ shared.mix(tids.view(np.uint64))) % np.uint64(groups)).astype(np.int64)
    by = np.lexsort((starts, tids, ids, group))
    ids, tids, starts, group = ids[by], tids[by], starts[by], group[by]
    edges = np.searchsorted(group, np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(edges)):
        i, t, s = (x[edges[g] : edges[g + 1]] for x in (ids, tids, starts))
        at = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])])
        gap = np.diff(s, prepend=0)
        gap[at] = s[at]
        yield int(g), gaps(i[at]), planes(t[at].view(np.uint64), 8), np.diff(np.r_[at, len(i)]).astype("<u4").tobytes(), planes(gap, 4)


STARTS = "grp int, ids binary, tids binary, counts binary, starts binary"
STARTS_TYPES = pa.schema([("grp", pa.int32()), *[(n, pa.binary()) for n in ("ids", "tids", "counts", "starts")]])


def later(table: pa.Table, width: tuple[int, int], groups: int) -> pa.Table:
    """Of a bucket's windows, the starts of all that are not the first of their hash."""
    out, parts = [], []
    for ids, tids, counts, starts, hashes, more, dead in zip(*(table.column(n).to_pylist() for n in ("ids", "tids", "counts", "starts", "hashes", "more", "dead")), strict=True):
        i, t, s = unfold(ids, tids, counts, starts)
        if dead:
            out.extend(folded(i, t, s, groups))
        else:
            parts.append((unplanes(hashes, width[0]), unplanes(more, width[1]) if width[1] else np.zeros(len(i), np.uint64), i, t, s))
    if parts:
        h, m, i, t, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((m, h)) if width[1] else np.argsort(h, kind="stable")
        again = (h[by][1:] == h[by][:-1]) & (m[by][1:] == m[by][:-1])
        both = np.zeros(len(h), bool)
        both[:-1] |= again
        both[1:] |= again
        by = by[both]  # only windows of which there are two or more
        by = by[np.lexsort((s[by], t[by], i[by], m[by], h[by]))]
        h, m, i, t, s = h[by], m[by], i[by], t[by], s[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])][: len(h)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        gone = (i != i[head]) | (t != t[head]) | (s != s[head])
        out.extend(folded(i[gone], t[gone], s[gone], groups))
    return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), STARTS_TYPES.types, strict=True)], schema=STARTS_TYPES) if out else STARTS_TYPES.empty_table()


def merged(table: pa.Table, k: int) -> pa.Table:
    """For each text of a group, maximal runs [from, to) of words that a later window covers."""
    parts = [unfold(*x) for x in zip(*(table.column(n).to_pylist() for n in ("ids", "tids", "counts", "starts")), strict=True)]
    i, t, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((s, t, i))
    i, t, s = i[by], t[by], s[by]
    text = np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])]
    run = text | np.r_[True, s[1:] > s[:-1] + k]
    heads = np.flatnonzero(run)
    last = np.r_[heads[1:], len(s)] - 1
    of = np.flatnonzero(text[heads])
    offsets = pa.array(np.r_[of, len(heads)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (s[heads], s[last] + k)]
    return pa.Table.from_arrays([pa.array(i[heads][of]), pa.array(t[heads][of]), *lists], names=["at", "tid", "opens", "closes"])


def removal_intervals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, repeated: bool = True) -> DataFrame:
    """at, tid, opens, closes: runs of words to remove, for each text that has any; at and tid are as keys() has them.

    repeated: whether any doc_id occurs twice; see keys().
    """
    own = docs.select(*keys(docs, doc_id, text, repeated), docs[text].cast("string").alias("text"))
    size, n = own.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    words = (size or 0) // WORD_BYTES + 1
    buckets, groups = max(LEAST_BUCKETS, -(-words // BUCKET_WINDOWS)), max(1, n // GROUP_TEXTS)
    width = hash_bytes(words, buckets)
    sent = own.mapInArrow(lambda b: deal(b, buckets, width, k), MESSAGE)
    late = sent.groupBy("bucket").applyInArrow(lambda t: later(t, width, groups), STARTS)
    return late.groupBy("grp").applyInArrow(lambda t: merged(t, k), "at long, tid long, opens array<int>, closes array<int>")


def keys(docs: DataFrame, doc_id: str, text: str, repeated: bool) -> list:
    """What tells texts apart: doc_id, and a hash of the text if doc_ids repeat; it is 0 else, which costs no room in messages."""
    at = F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID))
    tid = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) if repeated else F.lit(0).cast("long")
    return [at.alias("at"), tid.alias("tid")]


def repeats_id(docs: DataFrame, doc_id: str) -> bool:
    return shared.has_rows(docs.groupBy(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("at")).count().where("count > 1"))


def kept_words(text: str | None, opens: list[int] | None, closes: list[int] | None) -> tuple[int, int, bytes]:
    words = (text or "").encode().split()
    if not opens:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for a, b in zip(opens, closes, strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """docs and three columns called as `names` says: number of words, of removed ones, and the kept words joined by one space."""
    repeated = repeats_id(docs, doc_id)
    runs = removal_intervals(docs, doc_id, text, k, repeated)
    at, tid, opens, closes = (shared.free_name(docs, f"__{n}") for n in ("at", "tid", "opens", "closes"))
    keyed = docs.select(*[docs[c] for c in docs.columns], *[x.alias(n) for x, n in zip(keys(docs, doc_id, text, repeated), (at, tid), strict=True)])
    both = keyed.join(runs.toDF(at, tid, opens, closes), [at, tid], "left").select(*[F.col(f"`{c}`") for c in docs.columns], opens, closes)
    given, place = docs.columns, docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                done = [kept_words(*x) for x in zip(*(part.column(i).to_pylist() for i in (place, len(given), len(given) + 1)), strict=True)]
                cols = [*part.columns[: len(given)], pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2].decode() for d in done], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*given, *names])

    schema = both.select(*[F.col(f"`{c}`") for c in given]).schema.add(names[0], "long").add(names[1], "long").add(names[2], "string")
    return both.mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated words cut out of their texts; a text that loses nothing keeps its blanks, one that loses all is empty."""
    names = tuple(shared.free_name(docs, f"__{n}") for n in ("n_words", "n_removed", "kept"))
    cut = remove_repeats(docs, doc_id, text, names=names)
    new = F.when(F.col(names[1]) > 0, F.col(names[2])).otherwise(F.col(f"`{text}`"))
    return cut.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return remove_repeats(slim).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
