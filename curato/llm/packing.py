"""Optimal length buckets: boundaries that pad least, and token-budget batches inside each bucket.

Lengths are counted in words. The global histogram is added up in Spark and has a row for each length that occurs, so it is
bounded by the words of the longest text. Dynamic programming over it finds the boundaries: the least padding of the first j
lengths in b buckets is the least over i of that of the first i lengths in b-1 buckets and the padding of lengths i+1..j to
the longest of them. Padding of a range follows from running sums, and the best i never falls as j grows, so the middle j of a
stretch is settled first and halves what is looked at for those on both sides: O(buckets * n log n) in all, whole levels of
the halving at a time in numpy.

A batch of a bucket holds floor(budget / length of the bucket) texts, at least one. Texts are batched in the order of a
seeded hash. A bucket may hold most of the texts, so positions are not counted in one task: texts are dealt to SLICES
slices by hash, slices are counted first, and row numbers inside a slice are added to the counts before it.

Defined results: a null or empty text has length 0 and is batched like others; a text longer than the budget is a batch of
its own. Fewer different lengths than buckets make fewer buckets. Rows that repeat everything get positions of their own. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm import shared
from curato.llm.mixing import words_of

BUCKETS, BUDGET, SLICES, SEED = 16, 16_384, 256, 29


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending padded lengths of at most so many buckets, those of least padding; lengths ascend."""
    n = len(lengths)
    if not n:
        return []
    lengths = lengths.astype(np.int64)
    many, words = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    best = (many * np.r_[0, lengths] - words).astype(np.float64)  # one bucket
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        best, at = _one_more(best, lengths, many, words)
        back.append(at)
    out, j = [], n
    for at in reversed(back):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(at[j])
    return out[::-1]


def _one_more(best: np.ndarray, lengths: np.ndarray, many: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least padding of the first j lengths in one bucket more than best has, and where its last bucket begins."""
    n = len(lengths)
    out, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    out[0] = 0
    # stretches of j, and of the i among which their best one is
    lo, hi, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        j = (lo + hi) // 2
        last = np.minimum(most, j - 1)
        runs = last - least + 1
        heads = np.r_[0, np.cumsum(runs)[:-1]]
        i = np.arange(runs.sum()) - np.repeat(heads - least, runs)
        to = np.repeat(j, runs)
        cost = best[i] + (many[to] - many[i]) * lengths[to - 1] - (words[to] - words[i])
        out[j] = np.minimum.reduceat(cost, heads)
        # of equally good ones the first
        first = np.minimum.reduceat(np.where(cost == np.repeat(out[j], runs), i, n), heads)
        at[j] = first
        left, right = lo < j, j < hi
        lo, hi, least, most = np.r_[lo[left], j[right] + 1], np.r_[j[left] - 1, hi[right]], np.r_[least[left], first[right]], np.r_[first[left], most[right]]
    return out, at


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lengths that occur, and how often."""
    found = sorted(rows.groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).collect())
    return tuple(np.array([r[c] for r in found], np.int64) for c in ("n_words", "n"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_words, bucket, padded_words, batch (inside the bucket), slot (inside the batch) of every row."""
    rows = shared.keep(docs.select(docs[doc_id].alias("doc_id"), words_of(docs[text].cast("string")).alias("n_words")), "lengths")
    ends = boundaries(*histogram(rows), buckets)
    if not ends:
        ends = [0]
    bucket = shared.range_bucket(F.col("n_words"), [e + 1 for e in ends[:-1]])
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n_words", F.lit(SEED))
    dealt = rows.withColumn("bucket", bucket).withColumn("key", key).withColumn("slice", F.shiftrightunsigned("key", 64 - (SLICES - 1).bit_length()).cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most SLICES rows a bucket
    counted = dealt.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n")).select("bucket", "slice", before.alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("key", F.col("doc_id").asc_nulls_first())) - 1
    placed = dealt.withColumn("padded_words", F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("bucket") + 1).cast("long"))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded_words")))).cast("long")
    ranked = placed.join(F.broadcast(counted), ["bucket", "slice"]).withColumn("rank", rank).withColumn("per", per)
    return ranked.select("doc_id", "n_words", "bucket", "padded_words", F.floor(F.col("rank") / F.col("per")).cast("long").alias("batch"), (F.col("rank") % F.col("per")).cast("int").alias("slot"))
