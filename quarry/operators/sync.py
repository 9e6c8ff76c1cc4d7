"""Catalog changes as pure functions of DataFrames, and a versioned Parquet store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "external_id"


def last_of_batch(batch: DataFrame, order: str, key: str = KEY) -> DataFrame:
    """One row per key: the last by the order column."""
    cols = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in cols])


def change_split(batch: DataFrame, stored: DataFrame, reembed: bool = False) -> DataFrame:
    """batch with action: embed (new or changed content) or refresh. Both sides have content_hash."""
    old = stored.select(KEY, F.col("content_hash").alias("old_hash"))
    same = F.col("old_hash").isNotNull() & (F.col("old_hash") == F.col("content_hash")) & F.lit(not reembed)
    return batch.join(old, KEY, "left").withColumn("action", F.when(same, "refresh").otherwise("embed")).withColumn("is_new", F.col("old_hash").isNull()).drop("old_hash")


REFRESHED = ("price", "currency", "in_stock")


def upserted(batch: DataFrame, stored: DataFrame, as_of: Column, reembed: bool = False) -> DataFrame:
    """The stored table after an upsert of unique rows: refreshed rows keep all but price, currency, stock, status and time."""
    split = change_split(batch, stored, reembed)
    stamp = {"status": F.lit("active"), "updated_at": as_of}
    fresh = split.where(F.col("action") == "embed").drop("action", "is_new").withColumns(stamp).select(*stored.columns)
    news = split.where(F.col("action") == "refresh").select(KEY, *[F.col(c).alias(f"new_{c}") for c in REFRESHED])
    kept = stored.join(fresh.select(KEY), KEY, "left_anti").join(news.withColumn("hit", F.lit(True)), KEY, "left")
    for c in REFRESHED:
        kept = kept.withColumn(c, F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)))
    for c, v in stamp.items():
        kept = kept.withColumn(c, F.when(F.col("hit"), v).otherwise(F.col(c)))
    return kept.select(*stored.columns).unionByName(fresh)


def price_patched(patch: DataFrame, stored: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """patch(external_id, has_price, price, has_stock, in_stock), unique. (stored after it, one report row per id)."""
    p = patch.select(KEY, "has_price", F.col("price").alias("new_price"), "has_stock", F.col("in_stock").alias("new_stock"))
    hit = stored.join(p, KEY, "left")
    any_ = F.coalesce(F.col("has_price") | F.col("has_stock"), F.lit(False))
    after = (
        hit.withColumn("price", F.when(F.coalesce(F.col("has_price"), F.lit(False)), F.col("new_price")).otherwise(F.col("price")))
        .withColumn("in_stock", F.when(F.coalesce(F.col("has_stock"), F.lit(False)), F.col("new_stock")).otherwise(F.col("in_stock")))
        .withColumn("updated_at", F.when(any_, as_of).otherwise(F.col("updated_at"))).select(*stored.columns)
    )
    return after, report(patch.select(KEY), stored)


def report(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """external_id, ok, error for unique ids."""
    known = stored.select(KEY, F.lit(True).alias("known"))
    return ids.select(KEY).distinct().join(known, KEY, "left").select(KEY, F.col("known").isNotNull().alias("ok"), F.when(F.col("known").isNull(), "Product not found").alias("error"))


def archived(ids: DataFrame, stored: DataFrame, flag: bool, as_of: Column) -> DataFrame:
    hit = stored.join(ids.select(KEY).distinct().withColumn("hit", F.lit(True)), KEY, "left")
    return hit.withColumn("status", F.when(F.col("hit"), F.lit("archived" if flag else "active")).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("hit"), as_of).otherwise(F.col("updated_at"))).drop("hit")


def deleted(ids: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(ids.select(KEY).distinct(), KEY, "left_anti")


def orphans(snapshot: DataFrame, stored: DataFrame, started: Column) -> DataFrame:
    """Stored, not archived, not in the snapshot, and not written since the snapshot was started."""
    old = F.col("updated_at").isNull() | (F.col("updated_at") < started)
    return stored.where((F.coalesce(F.col("status"), F.lit("active")) != "archived") & old).join(snapshot.select(KEY).distinct(), KEY, "left_anti")


class TooManyOrphans(ValueError):
    pass


def reconcile(snapshot: DataFrame, stored: DataFrame, started: Column, as_of: Column, dry_run: bool = True, max_archived: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(orphans, stored after it). Archives, never deletes; over max_archived it refuses, dry run or not."""
    found = orphans(snapshot, stored, started).select(KEY)
    if max_archived is not None and (n := found.count()) > max_archived:
        raise TooManyOrphans(f"{n} products would be archived, {max_archived} are allowed")
    return found, stored if dry_run else archived(found, stored, True, as_of)


def diff(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """external_id, side: missing_in_index or extra_in_index."""
    s, t = snapshot.select(KEY).distinct(), stored.select(KEY)
    return s.join(t, KEY, "left_anti").withColumn("side", F.lit("missing_in_index")).unionByName(t.join(s, KEY, "left_anti").withColumn("side", F.lit("extra_in_index")))


def stats(stored: DataFrame) -> DataFrame:
    gone = F.count_if(F.coalesce(F.col("status"), F.lit("active")) == "archived")
    return stored.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - gone).alias("active"), gone.alias("archived"))


class SchemaMismatchError(RuntimeError):
    pass


class ConcurrentWrite(RuntimeError):
    pass


class Store:
    """A table of Parquet versions; the highest one with a _SUCCESS marker is the current one.

    All files go through Spark's file system, so any store that Spark reads will do. One writer at a time: a write that began
    from a version that is no longer the current one is refused. KEPT versions stay for readers, older ones are removed.
    """

    KEPT = 5


    def __init__(self, spark: SparkSession, path: str, meta: dict[str, str]):
        self.spark, self.path, self.meta = spark, path.rstrip("/"), meta
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        row = [(k, str(v)) for k, v in sorted(meta.items())]
        if self._fs.exists(self._at("_meta")):
            found = {r["key"]: r["value"] for r in spark.read.parquet(f"{self.path}/_meta").collect()}
            if found != dict(row):
                raise SchemaMismatchError(f"stored {found}, wanted {dict(row)}")
        else:
            spark.createDataFrame(row, "key string, value string").coalesce(1).write.parquet(f"{self.path}/_meta")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> str | None:
        names = self._names()
        return names[-1] if names else None

    def _names(self) -> list[str]:
        """The finished versions, the oldest first."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(".")) if s.getPath().getName().startswith("v"))
        return [n for n in names if self._fs.exists(self._at(f"{n}/_SUCCESS"))]

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"nothing is stored at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame) -> str:
        """The next version; readers see it when its _SUCCESS marker stands."""
        now = self.version()
        name = f"v{(int(now[1:9]) + 1 if now else 1):08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        if sum(n[:9] == name[:9] for n in self._names()) > 1:
            self._fs.delete(self._at(name), True)
            raise ConcurrentWrite(f"another writer made version {name[:9]}")
        for old in [n for n in self._names() if n < name][: 1 - self.KEPT]:
            self._fs.delete(self._at(old), True)
        return name


def first_seen_order(batch: DataFrame) -> DataFrame:
    """batch with ord, the order of its rows in the input."""
    return batch.withColumn("ord", F.monotonically_increasing_id())


def evict_jobs(jobs: DataFrame, keep: int = 500) -> DataFrame:
    """The jobs that stay: finished ones go first, the oldest first. jobs(job_id, status, seq)."""
    open_ = ~F.col("status").isin("completed", "failed")
    return jobs.orderBy(open_.desc(), F.desc("seq")).limit(keep)


def reap_jobs(jobs: DataFrame) -> DataFrame:
    stale = F.col("status").isin("pending", "running")
    return jobs.withColumn("error", F.when(stale, "interrupted by a service restart").otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


class JobStore:
    """Import jobs in a Store of their own, JOBS at most. What was open when the store is opened has been interrupted."""

    JOBS = 500
    SCHEMA = "job_id string, filename string, status string, total long, processed long, failed long, errors array<string>, detail string, error string, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path, {"schema": "jobs-1"})
        if self.store.version() is None:
            self.store.write(spark.createDataFrame([], self.SCHEMA))
        elif not self.list().where(F.col("status").isin("pending", "running")).isEmpty():
            self._replace([r.asDict() for r in reap_jobs(self.list()).collect()])

    def list(self) -> DataFrame:
        return self.store.read()

    def get(self, job_id: str) -> dict | None:
        row = self.list().where(F.col("job_id") == job_id).first()
        return row.asDict() if row else None

    def _replace(self, rows: list[dict]) -> None:
        df = self.spark.createDataFrame([tuple(r[c.split()[0]] for c in self.SCHEMA.split(", ")) for r in rows], self.SCHEMA)
        self.store.write(evict_jobs(df, self.JOBS).coalesce(1))

    def create(self, filename: str) -> str:
        rows = [r.asDict() for r in self.list().collect()]  # JOBS at most
        job = {"job_id": uuid.uuid4().hex, "filename": filename, "status": "pending", "total": 0, "processed": 0, "failed": 0, "errors": [], "detail": None, "error": None, "seq": max([r["seq"] for r in rows], default=0) + 1}
        self._replace([*rows, job])
        return job["job_id"]

    def save(self, job_id: str, **change) -> None:
        self._replace([r.asDict() | (change if r["job_id"] == job_id else {}) for r in self.list().collect()])
