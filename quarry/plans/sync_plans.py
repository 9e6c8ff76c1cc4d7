"""Catalog changes, imports, enrichment and jobs, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..checkpoints import ready_checkpoints
from ..functions import text
from ..operators import enrich, sync
from ..sources import imports
from ..streaming import feed
from .views import AS_OF, CATALOG, START, catalog, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add




def _as_of():
    return F.lit(AS_OF).cast("timestamp")


_COLS = ["external_id", "name", "brand", "category", "price", "currency", "in_stock", "status", "updated_at", "content_hash"]


def _with_hash(c):
    entries = F.array(F.struct(F.lit("size").alias("key"), F.col("size").alias("value")))
    return c.withColumn("content_hash", text.content_hash([F.col(x) for x in ("name", "brand", "category", "article", "product_code", "ean13")], entries))


def _stored(spark, sf_dir):
    return _with_hash(catalog(spark, sf_dir)).select(*_COLS)


def _batch(spark, sf_dir):
    """Every product again: a third as it was, a third dearer, a third renamed; and each once more under a new id."""
    c = catalog(spark, sf_dir)
    k = F.col("p_partkey") % 3
    c = c.withColumn("price", F.when(k == 1, F.col("price") + 1).otherwise(F.col("price"))).withColumn("name", F.when(k == 2, F.concat("name", F.lit(" new"))).otherwise(F.col("name")))
    both = c.unionByName(c.withColumn("external_id", F.concat(F.lit("new-"), F.col("external_id"))))
    return _with_hash(both).select(*_COLS)


_BATCH = """batch AS (SELECT * REPLACE (CASE WHEN p_partkey % 3 = 1 THEN price + 1 ELSE price END AS price, CASE WHEN p_partkey % 3 = 2 THEN name || ' new' ELSE name END AS name),
  CASE WHEN p_partkey % 3 = 2 THEN 'embed' ELSE 'refresh' END AS action FROM catalog)"""
_STAMP = "strftime(updated_at, '%Y-%m-%d %H:%M:%S')"


def _stamped(df):
    return df.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {CATALOG}, {_BATCH} SELECT external_id, action, false AS is_new FROM batch UNION ALL SELECT 'new-' || external_id, 'embed', true FROM batch")
def upsert_split(spark, sf_dir):
    return sync.change_split(_batch(spark, sf_dir), _stored(spark, sf_dir)).select("external_id", "action", "is_new")


@query(f"""WITH {CATALOG}, {_BATCH}, r AS (SELECT external_id, name, price, in_stock FROM batch UNION ALL SELECT 'new-' || external_id, name, price, in_stock FROM batch)
SELECT *, 'active' AS status, '{AS_OF}' AS updated_at FROM r""")
def upsert_result_state(spark, sf_dir):
    after = sync.upserted(_batch(spark, sf_dir), _stored(spark, sf_dir), _as_of())
    return _stamped(after).select("external_id", "name", "price", "in_stock", "status", "updated_at")


def _feed(spark, sf_dir):
    """Price and stock events of products: a purchase tells the price, an error that it is gone."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.concat(F.lit("part-"), (F.col("user_id") * 20).cast("string")).alias("external_id"),
        F.when(F.col("event_type") == "purchase", F.col("value") + F.lit(0.0)).alias("price"),
        F.when(F.col("event_type") == "error", F.lit(False)).alias("in_stock"),
        F.col("ts").cast("timestamp").alias("updated_at"), "event_id",
    )


_FEED = """feed AS (SELECT 'part-' || (user_id * 20) AS external_id, CASE WHEN event_type = 'purchase' THEN value + 0.0 END AS price, CASE WHEN event_type = 'error' THEN false END AS in_stock, ts AS updated_at, event_id
  FROM events WHERE event_type IN ('purchase', 'error'))"""
_LAST = f"{_FEED}, last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY updated_at DESC, event_id DESC) = 1)"


def _patch(spark, sf_dir):
    f = _feed(spark, sf_dir).withColumn("o", F.struct("updated_at", "event_id"))
    last = sync.last_of_batch(f, "o")
    return last.select("external_id", F.col("price").isNotNull().alias("has_price"), "price", F.col("in_stock").isNotNull().alias("has_stock"), "in_stock")


@query(f"""WITH {CATALOG}, {_LAST} SELECT c.external_id, coalesce(l.price, c.price) AS price, coalesce(l.in_stock, c.in_stock) AS in_stock,
  CASE WHEN l.external_id IS NOT NULL THEN '{AS_OF}' ELSE strftime(c.updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM catalog c LEFT JOIN last l ON l.external_id = c.external_id""")
def price_patch(spark, sf_dir):
    after, _ = sync.price_patched(_patch(spark, sf_dir), _stored(spark, sf_dir), _as_of())
    return _stamped(after).select("external_id", "price", "in_stock", "updated_at")


def _ids(spark, sf_dir):
    """Products named by customers' keys, known and unknown ones."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("part-"), (F.col("c_custkey") * 3).cast("string")).alias("external_id"))


_IDS = "ids AS (SELECT DISTINCT 'part-' || (c_custkey * 3) AS external_id FROM customer)"


@query(f"WITH {CATALOG}, {_IDS} SELECT external_id, CASE WHEN external_id IN (SELECT external_id FROM ids) THEN 'archived' ELSE status END AS status FROM catalog")
def archive_restore(spark, sf_dir):
    return sync.archived(_ids(spark, sf_dir), _stored(spark, sf_dir), True, _as_of()).select("external_id", "status")


@query(f"WITH {CATALOG}, {_IDS} SELECT external_id, external_id IN (SELECT external_id FROM catalog) AS ok, CASE WHEN external_id NOT IN (SELECT external_id FROM catalog) THEN 'Product not found' END AS error FROM ids")
def delete_report(spark, sf_dir):
    return sync.report(_ids(spark, sf_dir), _stored(spark, sf_dir))


@query(f"WITH {CATALOG}, {_IDS} SELECT external_id FROM catalog WHERE external_id NOT IN (SELECT external_id FROM ids)")
def delete_rest(spark, sf_dir):
    return sync.deleted(_ids(spark, sf_dir), _stored(spark, sf_dir)).select("external_id")


def _snapshot(spark, sf_dir):
    """The snapshot that is reconciled: what is ordered as a first line of more than 45 pieces, by all orders, and as many unknown ids."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 45").select("l_partkey")
    return line.union(line.select(F.col("l_partkey") + 1_000_000)).select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("external_id"))


_SNAP = "snap AS (SELECT DISTINCT 'part-' || k AS external_id FROM (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45 UNION ALL SELECT l_partkey + 1000000 FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45))"


@query(f"WITH {CATALOG}, {_SNAP} SELECT external_id FROM catalog WHERE status <> 'archived' AND updated_at < TIMESTAMP '2024-03-01' AND external_id NOT IN (SELECT external_id FROM snap)")
def reconcile_orphans(spark, sf_dir):
    return sync.reconcile(_snapshot(spark, sf_dir), _stored(spark, sf_dir), F.lit("2024-03-01").cast("timestamp"), _as_of())[0]


@query(f"WITH {CATALOG}, {_SNAP} SELECT external_id, 'missing_in_index' AS side FROM snap WHERE external_id NOT IN (SELECT external_id FROM catalog) UNION ALL SELECT external_id, 'extra_in_index' FROM catalog WHERE external_id NOT IN (SELECT external_id FROM snap)")
def catalog_diff(spark, sf_dir):
    return sync.diff(_snapshot(spark, sf_dir), _stored(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT count(*) AS total, CAST(count_if(status <> 'archived') AS BIGINT) AS active, CAST(count_if(status = 'archived') AS BIGINT) AS archived FROM catalog")
def catalog_stats(spark, sf_dir):
    return sync.stats(_stored(spark, sf_dir))


@query(f"""WITH {CATALOG}, {_LAST}, s AS (SELECT external_id, price, in_stock, CAST('{START}' AS TIMESTAMP) AS updated_at FROM catalog)
SELECT coalesce(l.external_id, s.external_id) AS external_id, coalesce(l.price, s.price) AS price, coalesce(l.in_stock, s.in_stock) AS in_stock,
  strftime(coalesce(l.updated_at, s.updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM s FULL JOIN last l ON l.external_id = s.external_id""")
def stream_upsert(spark, sf_dir):
    """The feed as a stream of files into a fresh store in the shared folder; the stored state after it."""
    base = f"{ready_checkpoints(spark)}/feed-{uuid.uuid4().hex}"
    store = sync.Store(spark, f"{base}/store", {"schema": "1"})
    store.write(catalog(spark, sf_dir).select("external_id", "price", "in_stock", F.lit(START).cast("timestamp").alias("updated_at")))
    _feed(spark, sf_dir).write.parquet(f"{base}/in")
    schema = "external_id string, price double, in_stock boolean, updated_at timestamp, event_id long"
    feed.run(spark.readStream.schema(schema).parquet(f"{base}/in"), store, f"{base}/progress").awaitTermination()
    return _stamped(store.read())


# ---- imports


def _file_rows(spark, sf_dir):
    """Products as a supplier's file has them: other column names, blanks, and values that break the rules."""
    c = catalog(spark, sf_dir)
    k = F.col("p_partkey")
    return c.select(
        k.alias("row"), F.col("external_id").alias("id"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("  "), "name", F.lit("  x "))).alias("Назва"), F.col("brand").alias("Бренд"),
        F.col("article").alias("Артикул"), F.concat(F.lit("EAN "), "ean13").alias("barcode"), F.when(k % 13 == 0, "cheap").otherwise(F.col("price").cast("string")).alias("ЦІНА"),
        F.when(k % 17 == 0, "maybe").otherwise(F.when(F.col("in_stock"), "Yes").otherwise("0")).alias("in_stock"), F.col("size").cast("string").alias("Розмір"), F.when(k % 2 == 0, "").otherwise("red").alias("color"),
    )


def _imported(spark, sf_dir):
    rows = _file_rows(spark, sf_dir)
    keyed = rows.withColumnRenamed("row", "__row")
    mapped = imports.map_columns(keyed)
    return imports.split_valid(imports.checked(mapped))


_VALID = "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0"


@query(f"WITH {CATALOG} SELECT external_id, name || ' x' AS name, brand, article, ean13, price, currency, in_stock, CAST(size AS VARCHAR) AS size, CASE WHEN p_partkey % 2 = 1 THEN 'red' END AS color FROM catalog WHERE {_VALID}")
def import_map_rows(spark, sf_dir):
    good, _ = _imported(spark, sf_dir)
    at = lambda k: F.try_element_at("attributes", F.lit(k))["s"]
    return good.select("external_id", "name", "brand", "article", "ean13", "price", "currency", "in_stock", at("Розмір").alias("size"), at("color").alias("color"))


@query(f"""WITH {CATALOG} SELECT p_partkey AS row, array_to_string(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'name: missing' END, CASE WHEN p_partkey % 13 = 0 THEN 'price: not a number' END,
  CASE WHEN p_partkey % 17 = 0 THEN 'in_stock: not a truth value' END], lambda x: x IS NOT NULL), '; ') AS error FROM catalog WHERE NOT ({_VALID}) ORDER BY 1 LIMIT 100""")
def import_errors(spark, sf_dir):
    return _imported(spark, sf_dir)[1]


# ---- enrichment


@query(f"WITH {CATALOG} SELECT external_id, count(*) OVER (PARTITION BY name, brand, category) AS equal_cards, length('Name: ' || name || chr(10) || 'Brand: ' || brand || chr(10) || 'Category: ' || category) AS card_chars FROM catalog")
def enrich_dedup(spark, sf_dir):
    card = text.product_card(F.col("name"), F.col("brand"), F.col("category"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    done = enrich.enrich_all(catalog(spark, sf_dir), card, lambda c: F.length(c))
    counts = done.groupBy("card").agg(F.count(F.lit(1)).alias("equal_cards"))
    return done.join(counts, "card").select("external_id", "equal_cards", F.col("enrichment").cast("long").alias("card_chars"))


_ANSWER = json.dumps({"normalized_title": "  T  %s ", "synonyms": ["A", "a ", "b", ""], "attributes": {"Big Size": " %s ", "": "x"}, "use_cases": [], "spec_summary": "s"})


@query(f"""WITH {CATALOG} SELECT external_id, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'T ' || name END AS title, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'A,b' END AS synonyms,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'big_size=' || brand END AS attributes FROM catalog""")
def parse_enrichment(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 4 == 3, F.lit("no json")).otherwise(F.format_string(_ANSWER, F.col("name"), F.col("brand")))
    a = catalog(spark, sf_dir).select("external_id", enrich.parse_enrichment(raw).alias("a"))
    attrs = F.array_join(F.transform("a.attributes", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return a.select("external_id", F.col("a.normalized_title").alias("title"), F.array_join("a.synonyms", ",").alias("synonyms"), attrs.alias("attributes"))


@query(f"WITH {CATALOG} SELECT external_id, lower(name) || ',' || lower(brand) AS variants FROM catalog")
def parse_variants(spark, sf_dir):
    raw = F.format_string('{"x": ["%s", " %s ", "%s", ""], "y": []}', F.col("name"), F.col("brand"), F.upper("name"))
    m = enrich.parse_variants(raw)
    return catalog(spark, sf_dir).select("external_id", F.array_join(m["x"], ",").alias("variants"))


@query("SELECT job_id, status FROM (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderkey AS seq FROM orders) ORDER BY status = 'running' DESC, seq DESC LIMIT 500")
def job_eviction(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return sync.evict_jobs(o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderkey").alias("seq"))).select("job_id", "status")
