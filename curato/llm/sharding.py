"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions only.

Each (key, shard) pair draws a number from md5 and the shard with the best draw takes the record, so a new shard only
takes records into itself and moves about 1/(n+1) of them. Shards of weight w draw -ln(u)/w and the smallest wins, which
gives each shard its share of the weights.

Slots number the records of a shard without gaps. A shard may hold billions of records, so no task sees a whole shard:
records are spread over 256 sub-buckets by a hash of key and text, so that a key which many records share is spread too; sub-buckets are
counted first (a table of at most 256 x shards rows, which is broadcast), and row numbers inside a sub-bucket are added to the
counts before it.

Defined results: a null key counts as the empty string; a null text has 0 bytes and the CRC-32 of no bytes (0); rows that
repeat a key share its shard and get slots of their own; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4
SLOT_BUCKETS = 256


def draw(digest: Column, s: int) -> Column:
    """The 32-bit draw of shard s from its digest, which has four."""
    return F.conv(F.substring(digest, 1 + 8 * (s % DRAWS_PER_DIGEST), 8), 16, 10).cast("long")


def winner(drawn: list[Column], weights: list[float]) -> Column:
    """The shard of the best draw; of equal ones the smallest."""
    if len(set(weights)) == 1:
        best = F.greatest(*[x * 65536 + (65535 - s) for s, x in enumerate(drawn)]) if len(drawn) > 1 else drawn[0] * 65536 + 65535
        return (F.lit(65535) - F.pmod(best, F.lit(65536))).cast("int")
    scored = [F.struct((-F.log((x + 0.5) / float(1 << 32)) / F.lit(float(w))).alias("score"), F.lit(s).alias("s")) for s, (x, w) in enumerate(zip(drawn, weights, strict=True)) if w > 0]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["s"].cast("int")


def rendezvous(df: DataFrame, key: str, weights: list[float], new_weight: float | None = None) -> DataFrame:
    """df's columns and shard; grown_shard with one more shard of new_weight. Weights are at least 0, one above 0; up to 65535 shards."""
    if not weights or min(weights) < 0 or max(weights) <= 0 or len(weights) > 65535:
        raise ValueError("weights: 1 to 65535 numbers, none negative, one above 0")
    text = F.coalesce(df[key].cast("string"), F.lit(""))
    n = len(weights) + (new_weight is not None)
    digests = [F.md5(F.concat(text, F.lit(f":{g}"))).alias(f"__g{g}") for g in range(math.ceil(n / DRAWS_PER_DIGEST))]
    kept = [c for c in df.columns if c not in ("shard", "grown_shard")]
    base = df.select(*[df[c] for c in kept], *digests)
    drawn = base.select(*kept, *[draw(F.col(f"__g{s // DRAWS_PER_DIGEST}"), s).alias(f"__d{s}") for s in range(n)])
    cols = [F.col(f"__d{s}") for s in range(n)]
    return drawn.select(*kept, winner(cols[: len(weights)], weights).alias("shard"), *([winner(cols, [*weights, new_weight]).alias("grown_shard")] if new_weight is not None else []))


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    weights = weights or [1.0] * shards
    raw = F.coalesce(F.encode(df[text].cast("string"), "UTF-8"), F.lit(b""))
    rows = df.select(df[key].alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    mixed = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    placed = rendezvous(rows, "doc_id", weights, sum(weights) / len(weights)).withColumn("bucket", F.substring(F.md5(mixed), 1, 2))
    before = (
        placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32"))
    return (
        placed.withColumn("local", local).join(F.broadcast(before), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("local") - 1).cast("long").alias("slot"), "grown_shard")
    )


def oracle_sql(shards: int = 24) -> str:
    """The same in DuckDB's SQL, whose CRC-32 is folded byte by byte over a table built from the polynomial 0xEDB88320."""
    groups = math.ceil((shards + 1) / DRAWS_PER_DIGEST)
    best = lambda n: f"65535 - list_max([drawn[s + 1] * 65536 + 65535 - s for s in range({n})]) % 65536"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"
    return f"""
WITH crc AS (SELECT {table} AS t),
rows_ AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(hex(encode(text)), '') AS h FROM documents),
folded AS (SELECT doc_id, k, length(h) // 2 + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT for i in range(length(h) // 2)]),
        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS text_crc32 FROM rows_, crc),
drawn_ AS (SELECT doc_id, size, text_crc32, md5(k || '/' || text_crc32)[1:2] AS bucket,
    [('0x' || md5(k || ':' || (s // {DRAWS_PER_DIGEST}))[1 + 8 * (s % 4) : 8 + 8 * (s % 4)])::BIGINT for s in range({DRAWS_PER_DIGEST * groups})] AS drawn FROM folded),
placed AS (SELECT doc_id, size, text_crc32, bucket, ({best(shards)})::INT AS shard, ({best(shards + 1)})::INT AS grown_shard FROM drawn_)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""
