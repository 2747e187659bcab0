"""Near-duplicate groups of documents by SuperMinHash, banding, verification on full shingle sets and union-find.

Signatures: an element walks a permutation of the slots, drawing at step j a slot it has not visited and a rank between j and
j+1; a slot keeps the smallest rank. As ranks of step j are below those of step j+1, all elements of a block of documents take
step j together in numpy, and documents whose slots are all filled stop there.

Documents with equal sets form a class, found by an order-free digest of the set in a partial aggregation, so copies never
meet in one task and only classes go on. Bands of four slots give a class 32 buckets; a pair at similarity 0.75 shares none
with probability 5e-6. A bucket of n classes makes n-1 pairs, each class with the bucket's centre; four different orders
choose centres. Pairs are verified on full sets, and links are joined into components. Where a bucket still holds several
components, pairs between different components remain that no centre has settled: while those are many, more rounds use
other centres; at last the classes outside the bucket's commonest component are compared with all classes of other
components in it, a part of the former with a part of the latter, each of bounded size. Nothing is capped: every pair that shares a bucket ends up verified or already joined.

Defined results: a null text is empty; documents without words have no shingles, are linked with nothing and kept. A null
doc_id counts as the smallest and is returned as null. Rows that repeat a doc_id are told apart by their sets; with equal
sets they share everything. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm import shared
from curato.llm.components import components

SLOTS, BAND, WORDS, THRESHOLD = 128, 4, 5, 75
ORDERS, MEMBERS_PER_PART = 4, 1024
NULL_ID = -(2**63)
FULL = np.uint64(2**64 - 1)
#: Elements that walk their permutations at a time.
WALKERS = 1 << 16


def superminhash(values: np.ndarray, begin: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures of sets of distinct 64-bit values; set i is values[begin[i]:begin[i+1]]. An empty set's slots stay FULL."""
    out = np.full((len(begin) - 1, m), FULL, np.uint64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + WALKERS, "right")) - 1)
        _walk(values[begin[lo] : begin[hi]], np.diff(begin[lo : hi + 1]), out[lo:hi], m)
        lo = hi
    return out


def _walk(values: np.ndarray, counts: np.ndarray, out: np.ndarray, m: int) -> None:
    flat, doc = out.reshape(-1), np.repeat(np.arange(len(counts)), counts)
    mask, half = np.uint64(2**32 - 1), np.uint64(32)
    way = None
    for j in range(m):
        drawn = shared.mix(values + np.uint64(int(shared.GOLD) * (j + 1) % 2**64))
        k = (j + (((drawn & mask) * np.uint64(m - j)) >> half)).astype(np.int64)
        if way is None:
            slot = k
        else:
            row = np.arange(len(values))
            slot = way[row, k]
            way[row, k], way[row, j] = way[:, j], slot
        np.minimum.at(flat, doc * m + slot, (drawn >> half) | (np.uint64(j) << half))
        open_ = (out == FULL).any(axis=1)[doc]
        if not open_.any():
            return
        if j == 0:
            values, doc, k = values[open_], doc[open_], k[open_]
            way = np.tile(np.arange(m, dtype=np.uint8), (len(values), 1))
            row = np.arange(len(values))
            way[row, k], way[:, 0] = 0, k
        elif open_.sum() < 0.8 * len(values):
            values, doc, way = values[open_], doc[open_], way[open_]


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: the first one's number, distinct shingles and where each text's begin."""
    data, offsets = shared.text_buffers(column)
    for lo, hi in shared.blocks(offsets):
        words, first = shared.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        yield lo, *shared.shingle_sets(words, first, k)


def class_ids(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    n = np.diff(begin)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        once = shared.mix(values ^ shared.GOLD)
        out[some] = shared.mix(np.add.reduceat(once, begin[some]) ^ shared.mix(np.bitwise_xor.reduceat(shared.mix(once), begin[some]) + n[some].astype(np.uint64)))
    return out.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch], k: int = WORDS) -> Iterator[pa.RecordBatch]:
    """at, h, n, c (class), bands (a bucket key of eight bytes for each band)."""
    for batch in batches:
        for lo, values, begin in sets_of(batch.column(1), k):
            n = np.diff(begin)
            sig = superminhash(values, begin).reshape(len(n), SLOTS // BAND, BAND)
            keys = np.arange(1, SLOTS // BAND + 1, dtype=np.uint64)[None, :] * shared.GOLD
            for i in range(BAND):
                keys = shared.mix(keys + sig[:, :, i])
            ids, h = (batch.column(i).slice(lo, len(n)) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, h, pa.array(n, pa.int64()), pa.array(class_ids(values, begin)), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["at", "h", "n", "c", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch], k: int = WORDS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, values, begin in sets_of(batch.column(1), k):
            rows = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(values, begin)), rows], names=["c", "s"])


def settle(table: pa.Table) -> pa.Table:
    """Links between the classes of a bucket's part that are outside its main component (rest) and those of other components
    in another part of it."""
    c, label, rest = (table.column(x).to_numpy() for x in ("c", "label", "rest"))
    sets = table.column("s").combine_chunks()
    sizes = sets.value_lengths().to_numpy()
    ends = np.r_[0, np.cumsum(sizes)]
    # shingles get numbers once; a set is then a mask over them that all others are looked up in
    shingles, every = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    here, found = np.zeros(len(shingles), bool), []
    side = table.column("side").to_numpy(zero_copy_only=False)
    for u in np.flatnonzero(rest & side):
        own = every[ends[u] : ends[u + 1]]
        here[own] = True
        both = np.add.reduceat(here[every].astype(np.int64), ends[:-1])
        here[own] = False
        hit = ~side & (label != label[u]) & (100 * both >= THRESHOLD * (sizes + sizes[u] - both))
        found += [(c[u], c[v]) for v in np.flatnonzero(hit)[np.unique(label[hit], return_index=True)[1]]]
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are alike; row by row, so no task holds more than two sets besides its sorts."""
    x, y, n, m = sets.toDF("a", "x"), sets.toDF("b", "y"), F.size("x"), F.size("y")
    met = pairs.join(y, "b").join(x, "a").where(100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m))
    # 100 * both >= THRESHOLD * (n + m - both)
    return met.where((100 + THRESHOLD) * F.size(F.array_intersect("x", "y")) >= THRESHOLD * (n + m)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    out = grouped(docs, doc_id, text, k)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("at").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"), (F.col("at") == F.col("least")).alias("kept"))


def text_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def grouped(docs: DataFrame, doc_id: str, text: str, k: int = WORDS) -> DataFrame:
    """at, h (of the text), n, least (id of its group), label (of its group; null without words) of every row."""
    own = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("at"), docs[text].cast("string").alias("text"), text_hash(docs[text]).alias("h"))
    sketched = shared.keep(own.mapInArrow(lambda b: sketch(b, k), "at long, h long, n long, c long, bands array<long>"), "sketch")
    classes = sketched.where("n > 0").groupBy("c").agg(F.min("at").alias("at"))
    # equal sets have equal bands; a class is told by one of its rows
    banded = sketched.where("n > 0").groupBy("c").agg(F.first("bands").alias("bands")).select("c", F.posexplode("bands").alias("band", "key"))
    centres = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("c", F.col("band") % ORDERS).alias("h"), F.col("c").alias("c"))).alias("first")).where("size > 1")
    # written, so that Spark can split the join at a bucket that holds a large part of the classes
    buckets = shared.keep(banded.join(shared.keep(centres, "centres"), "key").select("key", "c", F.col("first.c").alias("centre"), "size"), "buckets")
    label = None
    if shared.has_rows(buckets):
        wanted = buckets.select("c").distinct().join(classes, "c")
        sets = shared.keep(own.join(wanted.select("at").distinct(), "at", "left_semi").mapInArrow(lambda b: full_sets(b, k), "c long, s array<long>").join(wanted.select("c"), "c", "left_semi").groupBy("c").agg(F.first("s").alias("s")), "sets")
        label = joined(buckets, sets)
    table = classes.select("c", F.col("at").alias("smallest"), F.col("c").alias("label"))
    if label is not None:
        whole = label.join(table.select("c", "smallest"), label["v"] == F.col("c")).groupBy("label").agg(F.min("smallest").alias("least"))
        table = table.select("c", "smallest").join(label.join(whole, "label").select(F.col("v").alias("c"), "least", "label"), "c", "left").select("c", F.coalesce("least", "smallest").alias("smallest"), F.coalesce("label", "c").alias("label"))
    # written, so that Spark can split the join at a class that holds a large part of all rows
    out = sketched.select("at", "h", "n", "c").join(shared.keep(table, "classes"), "c", "left")
    return out.select("at", "h", "n", F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("at")).alias("least"), F.when(F.col("n") > 0, F.col("label")).alias("label"))


def joined(buckets: DataFrame, sets: DataFrame, pairs_per_row: int = 1024) -> DataFrame:
    """v, label of the classes that are linked with any other."""
    links = shared.keep(checked(buckets.where("c != centre").select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct(), sets), "pairs")
    label = shared.keep(components(links), "labels")
    total, before, turn = buckets.count(), None, 0
    while True:
        turn += 1
        # buckets of two are settled; in others, classes of different components may not have met
        marked = buckets.where("size > 2").join(label.withColumnRenamed("v", "c"), "c", "left").select("key", "c", F.coalesce("label", "c").alias("label"))
        sizes = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        main = shared.keep(main, "main")
        if not shared.has_rows(main):
            return label
        openings = shared.keep(marked.join(main, "key").select("key", "c", "label", (F.col("label") != F.col("most.label")).alias("rest"), "size", (F.col("size") - F.col("most.n")).alias("n_rest")), "open")
        todo = openings.where("rest").agg(F.sum("size")).first()[0]
        # once a round has brought little, what is left is compared one by one
        if todo <= pairs_per_row * total or before is not None and todo > 0.7 * before:
            break
        before = todo
        # other centres of the main component, for the rest; and of the rest, for all; buckets choose by one order, so those
        # that hold the same classes choose the same centres and their pairs are few
        ends = openings.groupBy("key").agg(F.min(F.when(~F.col("rest"), F.struct(F.xxhash64("c", F.lit(turn)).alias("h"), "c", "label"))).alias("p"), F.min(F.when(F.col("rest"), F.struct(F.xxhash64("c", F.lit(turn)).alias("h"), "c", "label"))).alias("q"))
        more = openings.join(ends, "key").select("c", "label", F.explode(F.array("p", "q")).alias("e")).where("label != e.label").select(F.least("c", "e.c").alias("a"), F.greatest("c", "e.c").alias("b")).distinct()
        links = shared.keep(links.union(checked(more, sets)), "pairs")
        label = shared.keep(components(links), "labels")
    # parts of the rest meet parts of the whole bucket, so that no task holds more than two parts
    parts = lambda size: F.greatest(F.lit(1), F.ceil(F.col(size) / MEMBERS_PER_PART)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("c", F.lit(n)), F.col(n)).cast("int")
    dealt = openings.withColumn("parts", parts("size")).withColumn("rests", parts("n_rest"))
    asking = dealt.where("rest").select("key", own("rests").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("side"), "c", "label", "rest")
    asked = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), own("parts").alias("j"), F.lit(False).alias("side"), "c", "label", "rest")
    found = asking.union(asked).join(sets, "c").groupBy("key", "i", "j").applyInArrow(settle, "a long, b long")
    return shared.keep(components(links.union(found)), "labels")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that are not kept; of rows of one group that share a kept doc_id, or have none, one stays.

    Groups under one doc_id, or without, keep a row each; of a group's different texts it is the first by hash. Different texts
    without words are groups of their own.
    """
    at, h, turn = (shared.free_name(docs, x) for x in ("__at", "__h", "__turn"))
    # ids and decisions come from one table, so each row of docs finds that of its doc_id and text
    alone = F.when(F.col("label").isNull(), F.col("h"))
    stay = grouped(docs, doc_id, text).where("at = least").groupBy("at", "label", alone.alias("alone")).agg(F.min("h").alias(h)).select(F.col("at").alias(at), h)
    keyed = docs.select(*[docs[c] for c in docs.columns], F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias(at), text_hash(docs[text]).alias(h))
    first = F.row_number().over(Window.partitionBy(at, h).orderBy(text))
    return keyed.join(stay, [at, h], "left_semi").withColumn(turn, first).where(F.col(turn) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
