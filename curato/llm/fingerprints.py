"""MinHash fingerprints of whole texts, neighbours and edited texts, and near pairs by signature bands.

A text's shingles are its runs of five words (all its words, if fewer). Each of PERMUTATIONS universal hash functions
x -> a*x + b (modulo 2**64, a odd) is taken over all shingles of a block of texts at once in numpy; a fingerprint holds the
top 16 bits of each minimum, as hexadecimal digits. The share of equal components estimates the Jaccard similarity; two
different minima agree by chance once in 65,536.

A text's neighbour is the one with the next smaller doc_id. Texts are dealt out by ranges of doc_id, one range a partition,
in one shuffle; the first text of each range also goes to the range before it, so no task sees more than its range and one
text more. Range bounds come from a quantile sketch of doc_id and are as many as there are shuffle partitions.

Defined results: a null text is empty; an empty text has no shingles and all components ffff; likeness of equal fingerprints
is 1. A null doc_id comes last. Rows that repeat a doc_id follow each other by text. A table of one row is its own neighbour;
an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.llm import shared
from curato.llm.neardup import class_ids

PERMUTATIONS, WORDS, SEED = 128, 5, 20240229
NULL_ID = -(2**63)
#: Classes of a bucket that are compared with as many others at a time.
MEMBERS = 256
SCHEMA = "doc_id long, n_chars long, edited_text string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def signatures(data: np.ndarray, offsets: np.ndarray, n: int = PERMUTATIONS, k: int = WORDS) -> np.ndarray:
    """One row of n 16-bit components for each text."""
    a, b = permutations(n)
    out = np.full((len(offsets) - 1, n), 0xFFFF, np.uint16)
    for lo, hi in shared.blocks(offsets):
        words, first = shared.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        values, begin = shared.windows(words, first, k, short=True)
        some = np.flatnonzero(np.diff(begin))
        if not len(some):
            continue
        heads = begin[some]
        room = np.empty_like(values)
        for j in range(n):
            np.multiply(values, a[j], out=room)
            room += b[j]
            out[lo + some, j] = np.minimum.reduceat(room, heads) >> np.uint64(48)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1)


def hexed(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def of_texts(texts: list[str], n: int = PERMUTATIONS) -> np.ndarray:
    return signatures(*shared.text_buffers(pa.array(texts, pa.large_string())), n)


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """SCHEMA for every row: its fingerprint, and those of its edited text and its neighbour as compared with it."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("at"), docs[text].cast("string").alias("text"))
    n = shared.partitions(spark)
    bounds = sorted({int(x) for x in rows.stat.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    last = len(bounds)
    bucket = F.lit(last) - shared.range_bucket(F.col("at"), bounds)
    heads = sorted((r[0], r[1]) for r in rows.select("at").groupBy(bucket.alias("b")).agg(F.max("at")).collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
    ghosts = spark.createDataFrame(list(before.items()), "at long, before int")
    # ghosts has one row a partition at most
    dealt = (
        rows.join(F.broadcast(ghosts), "at", "left").withColumn("bucket", bucket)
        .withColumn("copy", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ghost"))))
            .otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("to"), F.lit(True).alias("ghost"))))))
        .select("at", "text", F.col("copy.to").alias("to"), F.col("copy.ghost").alias("ghost"))
    )
    dealt = dealt.repartitionById(last + 1, F.col("to")).sortWithinPartitions("ghost", F.desc("at"), "text").drop("to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # id, text and signature of a text whose neighbour has not come yet
        done = False
        for batch in batches:
            ids, texts, ghost = (batch.column(i).to_pylist() for i in range(3))
            step, size, i = [], 0, 0
            while i < len(ids) and not done:
                step.append((ids[i], texts[i] or ""))
                size += len(step[-1][1])
                done = ghost[i]
                i += 1
                if size > shared.BLOCK_BYTES or i == len(ids) or done:
                    own = of_texts([t for _, t in step])
                    chain = ([held] if held else []) + [(d, t, s) for (d, t), s in zip(step, own, strict=True)]
                    held, step, size = chain[-1], [], 0
                    if len(chain) > 1:
                        yield told(chain)
            if done:
                break
        for _ in batches:
            pass

    def told(chain: list[tuple]) -> pa.RecordBatch:
        changed = [edited(a[1], b[1]) for a, b in zip(chain, chain[1:], strict=False)]
        sigs, new = np.stack([c[2] for c in chain]), of_texts(changed)
        return pa.RecordBatch.from_pydict({
            "doc_id": [None if c[0] == NULL_ID else c[0] for c in chain[:-1]], "n_chars": [len(c[1]) for c in chain[:-1]], "edited_text": changed if with_text else [None] * len(changed),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed], "fingerprint": hexed(sigs[:-1]), "edited_fingerprint": hexed(new), "near_edited": likeness(sigs[:-1], new), "near_next": likeness(sigs[:-1], sigs[1:]),
        }, schema=OUT)

    return dealt.mapInArrow(work, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.75, rows: int = 4) -> DataFrame:
    """a, b, jaccard (a <= b) of texts whose verified shingle sets are alike.

    Texts with equal sets form a class, told by its smallest doc_id; each copy is paired with that one. Of different classes that
    share a band of `rows` components all pairs are verified, in the first band they share, in blocks of about 2 * MEMBERS classes.
    So two rows are alike if their classes are the same or paired. a = b tells of two texts under one doc_id. Texts without words
    or doc_id pair with nothing.
    """
    n = PERMUTATIONS

    def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        data, offsets = shared.text_buffers(batch.column(1))
        for lo, hi in shared.blocks(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            values, begin = shared.shingle_sets(*shared.word_hashes(part, at), WORDS)
            yield lo, part, at, values, begin

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets, values, begin in sets_of(batch):
                full = np.flatnonzero(np.diff(begin))
                keys = signatures(data, offsets, n)[full].reshape(len(full), n // rows, rows).astype(np.uint64)
                keys = shared.mix(sum(keys[:, :, i] << np.uint64(16 * i) for i in range(rows)) + np.arange(n // rows, dtype=np.uint64) * shared.GOLD)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + full)), pa.array(class_ids(values, begin)[full]), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["at", "c", "bands"])

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, values, begin in sets_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(values, begin)), pa.array([values[x:y].tobytes() for x, y in zip(begin, begin[1:], strict=False)], pa.binary())], names=["c", "s"])

    def compare(table: pa.Table) -> pa.Table:
        at, part = table.column("at").to_numpy(), table.column("part").to_numpy()
        band, i, j = (table.column(x)[0].as_py() for x in ("band", "i", "j"))
        keys = np.array(table.column("bands").to_pylist())
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("s")]
        ends = np.r_[0, np.cumsum([len(x) for x in sets])]
        # shingles get numbers once; a set is then a mask over them that the others are looked up in
        shingles, every = np.unique(np.concatenate(sets), return_inverse=True)
        here, found = np.zeros(len(shingles), bool), []
        for u in np.flatnonzero(part == i):
            meets = (part == j) & ((keys == keys[u]).argmax(axis=1) == band)
            if i == j:
                meets[: u + 1] = False
            own = every[ends[u] : ends[u + 1]]
            here[own] = True
            for v in np.flatnonzero(meets):
                both = int(here[every[ends[v] : ends[v + 1]]].sum())
                alike = both / (len(sets[u]) + len(sets[v]) - both)
                if alike >= threshold:
                    found.append((min(at[u], at[v]), max(at[u], at[v]), alike))
            here[own] = False
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64()), "jaccard": pa.array([x[2] for x in found], pa.float64())})

    own = docs.select(docs[doc_id].cast("long").alias("at"), docs[text].cast("string").alias("text")).where("at is not null")
    sketched = shared.keep(own.mapInArrow(sketch, "at long, c long, bands array<long>"), "sketch")
    classes = sketched.groupBy("c").agg(F.min("at").alias("first"), F.first("bands").alias("bands"))
    copies = sketched.select("at", "c").join(classes.select("c", "first"), "c").where("at > first").select(F.col("first").alias("a"), F.col("at").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    banded = classes.select("c", "first", "bands", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"), F.count(F.lit(1)).alias("size")).where("size > 1")
    part = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    dealt = banded.join(sizes, ["band", "key"]).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = shared.keep(dealt.select("band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "c", F.col("first").alias("at"), "bands"), "buckets")
    wanted = dealt.select("c").distinct()
    texts = own.join(dealt.select("at").distinct(), "at", "left_semi")
    sets = texts.mapInArrow(full_sets, "c long, s binary").join(wanted, "c", "left_semi").groupBy("c").agg(F.first("s").alias("s"))
    return dealt.join(sets, "c").groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long, jaccard double").union(copies)


def digest(docs: DataFrame) -> DataFrame:
    return fingerprint_neighbours(docs, with_text=False).drop("edited_text")
