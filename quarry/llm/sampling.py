"""Bounded, repeatable samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for

#: Sampled documents that one task of a fit takes on average.
TASK_DOCS = 125


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_fold: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int | None = None
) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most per_class documents of either class, and all labelled ids per class.

    Only ids outside the held-out fold count. The sample is the smallest by a hash of the id, so it is
    the same after a retry; it has 2 * per_class ids at most, which are broadcast. An id with several
    labels counts once, under the largest, and of rows that repeat an id the smallest text counts, so
    the bound holds whatever the ids. Texts are whole. With max_bytes, a class takes its documents in
    the order of the hash as long as they fit into so many bytes; one that does not fit is left out,
    never cut. The sample is written once, so the documents are scanned once.
    """
    usable = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_fold))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    )
    counts = {int(r["__label"]): r["count"] for r in usable.groupBy("__label").count().collect()}  # two rows
    picked = None
    for k in (0, 1):
        some = usable.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "__id")
    one = found.groupBy("__id", "__label").agg(F.min("text").alias("text"))  # repeats are dropped before the shuffle
    sample = cut(one.repartition(parts_for(docs.sparkSession, 2 * per_class, TASK_DOCS), "__id"))
    if max_bytes is not None:
        room, out = {0: max_bytes, 1: max_bytes}, []
        for r in sample.select("__id", "__label", F.octet_length("text").alias("n"), F.xxhash64("__id").alias("h")).orderBy("h", "__id").collect():  # 2 * per_class rows
            if r["n"] <= room[r["__label"]]:
                room[r["__label"]] -= r["n"]
            else:
                out.append(r["__id"])
        if out:
            sample = sample.where(~F.col("__id").isin(out))
    return sample.select(F.col("__label").alias("label"), "text"), counts
