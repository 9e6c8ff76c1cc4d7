"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank
(rank - 1/2) / rows-of-its-source spreads every source evenly over [0, 1). Sorting all rows by the
fractional rank and cutting into equal runs gives every shard the corpus mixture.

No rank is taken over a whole source or the whole table in one task: rows are first counted per
(source, hash bucket) and per (rank bucket), running sums over those small count tables give each
bucket its offset, and the exact rank is the offset plus the rank inside a bucket. The number of
buckets grows with the rows, so buckets keep their size. The running sum over the rank buckets is one
task's work on one row per BUCKET_ROWS rows: 100 TB of 2 kB documents make 50 million rows of 16 bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that one bucket holds on average; a source with a third of all rows is cut into many.
BUCKET_ROWS = 1024


def _running(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds base: the rows in earlier buckets. One row per bucket, so the window is over counts only."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard sizes differ by one at most; slots are 0.. without gaps in the interleaved
    order. A null text has no bytes, a null source is a source of its own, null ids hash as one key;
    repeated rows are interchangeable. Texts of any length count whole. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        h.alias("h"),
    ))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).withColumn("b", bucket)

    per = rows.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n"))
    per = _running(per, ["source"], "b").withColumn("of", F.sum("n").over(Window.partitionBy("source"))).drop("n")
    inside = Window.partitionBy("source", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = (
        rows.withColumn("r", F.row_number().over(inside))
        .join(per, ["source", "b"])
        .withColumn("frac", (2 * (F.col("base") + F.col("r")) - 1) / (2 * F.col("of")))
        .select("doc_id", "size", "text_crc32", "source", "h", "frac", F.least(F.floor(F.col("frac") * buckets), F.lit(buckets - 1)).cast("long").alias("f"))
    )
    ranked = cut(ranked)
    offs = _running(ranked.groupBy("f").agg(F.count(F.lit(1)).alias("n")), [], "f").select("f", "base")
    along = Window.partitionBy("f").orderBy("frac", "source", "h", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = (
        ranked.withColumn("r", F.row_number().over(along)).join(offs, "f")
        .withColumn("p", F.col("base") + F.col("r") - 1)
        .withColumn("shard", F.expr(f"(p * {shards}L) div {max(total, 1)}L"))
    )
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")  # the first position p of a shard
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("p") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _sql(shards: int = 8, seed: int = 17) -> str:
    crc = "list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return f"""
WITH t AS (SELECT {crc} AS crc),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS x, md5('{seed}:' || doc_id) AS h FROM documents),
e AS (SELECT d.* EXCLUDE (x), xor(CAST(4294967295 AS UBIGINT), list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
  list_transform(range(size - 1), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS UBIGINT))), lambda c, b: xor(c >> 8, t.crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) AS text_crc32 FROM d, t),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS frac, count(*) OVER () AS n FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source, h, doc_id) - 1 AS p FROM r),
s AS (SELECT *, (p * {shards}) // n AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  p - (shard * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


SQL = _sql()
