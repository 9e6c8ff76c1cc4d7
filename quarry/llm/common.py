"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, ready_checkpoints  # noqa: F401

#: ASCII blanks: space and the five control characters 0x09-0x0D.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the runs of non-blank characters."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def unit_hash(key: Column, seed: int) -> Column:
    """Uniform double in [0, 1) from 52 bits of an md5, the same in every SQL engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions so that each holds at most per_part rows, and no fewer than the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


#: Rows that are broadcast at most: some tens of megabytes of ids and hashes.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, cut, and marked for broadcast if its counted rows are few; beyond that joins shuffle. For narrow rows of fixed width."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
