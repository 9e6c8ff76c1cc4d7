"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. One scan turns every row into (id, row number, 32-byte digest); texts leave the plan here.
2. A Misra-Gries summary (``freqItems``, at most 1/support counters) names every digest that may
   hold over ``support`` of the rows. Its size is bounded whatever the input, so it is broadcast.
3. The named digests are counted exactly (map-side partial sums) and their winners broadcast:
   the hot rows get their answer on the map side and are never shuffled.
4. All other digests take an ordinary shuffle of partial minima and counts, so no task holds the rows of
   a digest. Digests that occur more than once are joined back to their rows: broadcast if they are few,
   else shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, small

#: Rows that share a digest beyond this fraction of the input leave the shuffle; 1/SUPPORT counters.
SUPPORT = 1e-3


def text_digest(text):
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256))


def _found(docs: DataFrame, id_col: str, text_col: str, support: float) -> DataFrame:
    """doc_id, text_key (a hash of the raw text), row, first (id and row of the row that stays), group_size and digest of every row."""
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"),
        text_digest(F.col(text_col)).alias("digest"),
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("digest")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    counted = [F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")]

    named = rows.stat.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key"))
    hot = cut(rows.join(F.broadcast(named), "key", "left_semi").groupBy("digest").agg(*counted))  # at most 1/support rows: read twice below
    in_hot = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    copied = small(rest.groupBy("digest").agg(*counted).where("group_size > 1"))
    rest = rest.join(copied, "digest", "left").withColumns({"first": F.coalesce("first", order), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return in_hot.unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and texts of any length are read whole. Of equal texts the smallest id
    stays; a null id comes last. If the winner's id occurs on several equal rows, exactly one of them is
    kept. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    return _found(docs, id_col, text_col, support).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """docs without the later copies; all its columns stay as they are.

    Rows that go are told by id and text; they are broadcast if they are few, so texts stay where they
    are. Of rows repeated whole, id and text, one stays.
    """
    found = cut(_found(docs, id_col, text_col, support).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("doc_id").eqNullSafe(F.col("first.id")).alias("same")))
    gone = found.where("not kept").select("i", "k").distinct()
    again = found.where("not kept and same").select("i", "k").distinct()  # the winner's id: maybe the winner repeated
    again = cut(found.where("kept").select(F.col("i").alias("wi"), F.col("k").alias("wk")).join(again, F.col("wi").eqNullSafe(F.col("i")) & (F.col("wk") == F.col("k"))).select("i", "k"))
    some = not again.isEmpty()
    if some:
        gone = gone.join(again.select(F.col("i").alias("wi"), F.col("k").alias("wk")), F.col("wi").eqNullSafe(F.col("i")) & (F.col("wk") == F.col("k")), "left_anti")
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("k"))

    def matched(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("i").alias("wi"), F.col("k").alias("wk"))
        return df.join(small(keys), F.col("i").eqNullSafe(F.col("wi")) & (F.col("k") == F.col("wk")), how)

    out = matched(marked, gone, "left_anti")
    if some:
        out = matched(out, again, "left_anti").unionByName(matched(out, again, "left_semi").dropDuplicates(["i", "k"]))
    return out.select("doc.*")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
