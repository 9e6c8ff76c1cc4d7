"""Change feeds into the catalog: each micro-batch is a plain upsert or price patch of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sync


def latest(batch: DataFrame, stored: DataFrame, order: str = "updated_at") -> DataFrame:
    """The last row per product of a batch, without what is older than the stored row (late data)."""
    last = sync.last_of_batch(batch.withColumn("__o", F.struct(F.col(order), F.col("event_id"))), "__o").drop("__o", "event_id")
    old = stored.select(sync.KEY, F.col(order).alias("__old"))
    return last.join(old, sync.KEY, "left").where(F.col("__old").isNull() | (F.col(order) >= F.col("__old"))).drop("__old")


def merge_batch(batch: DataFrame, stored: DataFrame, order: str = "updated_at") -> DataFrame:
    """stored(external_id, price, in_stock, updated_at) after a batch with the same columns and event_id; nulls leave a value as it is."""
    news = latest(batch, stored, order)
    cols = [c for c in stored.columns if c != sync.KEY]
    joined = stored.join(news.select(sync.KEY, *[F.col(c).alias(f"n_{c}") for c in cols]), sync.KEY, "full")
    return joined.select(sync.KEY, *[F.coalesce(f"n_{c}", c).alias(c) for c in cols])


def run(stream: DataFrame, store: sync.Store, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = merge_batch):
    """Starts the feed; a replayed batch changes nothing, as the merge is by key and time."""

    def apply(batch: DataFrame, _: int) -> None:
        store.write(merge(batch, store.read()))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
