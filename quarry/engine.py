"""The engine: a stored catalog, changes to it, and batches of searches over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions import text
from .operators import codes, coverage, enrich, retrieval, search, sync
from .operators.filters import PRODUCT, REQUEST, Filters, as_columns, matches
from .sources import imports

ATTRIBUTES = "map<string,struct<t:string,s:string,n:double,b:boolean>>"
ENRICHMENT = "struct<normalized_title:string,synonyms:array<string>,use_cases:array<string>,spec_summary:string>"
CATALOG = f"""external_id string, name string, description string, brand string, brand_norm string, category string, article string, article_norm string,
 product_code string, product_code_norm string, ean13 string, attributes {ATTRIBUTES}, price double, currency string, in_stock boolean, status string,
 content_hash string, updated_at timestamp, embed_model string, enrichment {ENRICHMENT}, dense array<double>"""
_NAMES = [x.split()[0] for x in CATALOG.replace("\n", "").split(", ")]
MAX_QUERY, MAX_LIMIT, MAX_OFFSET = 512, 100, 1000


def hash_embedding(c: Column, size: int = 64) -> Column:
    """Counts of hashed terms: an embedder that needs no model. Another is any function of a text column."""
    at = F.transform(retrieval.terms(c), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda h: h == i)).cast("double"))


def attribute_entries(c: Column) -> Column:
    """(key, value as text) of the attributes, by key."""
    value = lambda v: F.coalesce(v["s"], F.when(v["n"] == F.floor(v["n"]), v["n"].cast("long").cast("string")).otherwise(v["n"].cast("string")), v["b"].cast("string"))
    entries = F.coalesce(F.map_entries(c), F.array().cast(f"array<struct<key:string,value:{ATTRIBUTES.split(',', 1)[1][:-1]}>>"))
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value"))))


@dataclass
class Config:
    """embed, rerank, enrich and expand are functions of columns, so any model that Spark can call will do.

    embed(text) -> vector of a product's text, embed_query(text) of a query (embed if none is given); rerank(query, card) -> score;
    enrich(card) -> a model's answer as JSON; expand(query) -> JSON of a token's variants, asked for in strict mode only. An answer
    that can't be read counts as none.
    """

    embedder: str = "hash-64"
    prefetch: int = retrieval.PREFETCH
    embed: object = field(default=hash_embedding, repr=False)
    embed_query: object = field(default=None, repr=False)
    rerank: object = field(default=None, repr=False)
    enrich: object = field(default=None, repr=False)
    expand: object = field(default=None, repr=False)


class Engine:
    """All methods take and return DataFrames; a search is a batch of requests keyed by query_id."""

    def __init__(self, store: sync.Store, config: Config):
        self.store, self.config, self.spark = store, config, store.spark

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> Engine:
        """Raises SchemaMismatchError if the store was made with another embedder or schema."""
        config = config or Config()
        store = sync.Store(spark, path, {"embedder": config.embedder, "schema": "1"})
        if store.version() is None:
            store.write(spark.createDataFrame([], CATALOG))
        return cls(store, config)

    def validated(self, products: DataFrame) -> DataFrame:
        """Product columns as they may be stored, with errors: blanks collapsed, digits of the EAN, lengths and values checked."""
        have = set(products.columns)
        strings = [c for c in imports.FIELDS if c not in ("price", "in_stock")]
        for c in strings:
            products = products.withColumn(c, F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string"))
        for c, kind in (("price", "double"), ("in_stock", "boolean"), ("attributes", ATTRIBUTES)):
            if c not in have:
                products = products.withColumn(c, F.lit(None).cast(kind))
        return imports.checked(products)

    def hashed(self, products: DataFrame) -> DataFrame:
        """validated() products with content_hash, which supplier data alone decides."""
        fields = [F.col(c) for c in ("name", "description", "brand", "category", "article", "product_code", "ean13")]
        typed = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        return products.withColumn("content_hash", text.content_hash(fields, F.coalesce(typed, F.array().cast(f"array<struct<key:string,value:{ATTRIBUTES.split(',', 1)[1][:-1]}>>"))))

    def prepared(self, products: DataFrame) -> DataFrame:
        """Stored rows of hashed() products: enriched, where a model is configured, and embedded. Supplier attributes win over a model's."""
        p = products
        if self.config.enrich is not None:
            card = text.product_card(F.col("name"), F.col("brand"), F.col("category"), F.col("article"), F.col("description"))
            p = enrich.enrich_all(p, card, lambda c: enrich.parse_enrichment(self.config.enrich(c))).drop("card")
            s = lambda v: F.struct(F.lit("s").alias("t"), v.alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))
            own = F.coalesce("attributes", F.create_map().cast(ATTRIBUTES))
            more = F.filter(F.coalesce(F.col("enrichment.attributes"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.map_contains_key(own, e["key"]))
            more = F.aggregate(more, F.create_map().cast(ATTRIBUTES), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], s(e["value"])).cast(ATTRIBUTES))))
            p = p.withColumn("attributes", F.map_concat(own, more)).withColumn("enrichment", F.when(F.col("enrichment").isNotNull(), F.struct(*[F.col(f"enrichment.{x}").alias(x) for x in ("normalized_title", "synonyms", "use_cases", "spec_summary")])))
        else:
            p = p.withColumn("enrichment", F.lit(None).cast(ENRICHMENT))
        p = p.withColumns({
            "brand_norm": F.lower("brand"), "article_norm": text.norm_code(F.col("article")), "product_code_norm": text.norm_code(F.col("product_code")),
            "status": F.lit("active"), "updated_at": F.lit(None).cast("timestamp"), "embed_model": F.lit(self.config.embedder),
        })
        return p.withColumn("dense", self.config.embed(self._dense_text())).select(*_NAMES)

    @staticmethod
    def _dense_text() -> Column:
        return text.dense_text(F.col("name"), F.col("brand"), F.col("category"), attribute_entries(F.col("attributes")), F.col("description"), F.col("enrichment.spec_summary"), F.coalesce("enrichment.use_cases", F.array().cast("array<string>")))

    def upsert(self, products: DataFrame, as_of: Column, reembed: bool = False) -> DataFrame:
        """external_id, ok, error for every input row; of valid rows with one id the last counts.

        Rows whose content is as stored are refreshed only: neither enriched nor embedded anew.
        """
        told = self.validated(sync.first_seen_order(products))
        stored = self.store.read()
        last = sync.last_of_batch(told.where(F.size("errors") == 0).drop("errors"), "ord").drop("ord")
        split = sync.change_split(self.hashed(last), stored, reembed)
        fresh = self.prepared(split.where("action = 'embed'").drop("action", "is_new"))
        same = split.where("action = 'refresh'")
        kinds = dict(fresh.dtypes)
        same = same.select(*[F.col(c) if c in same.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _NAMES])
        self.store.write(sync.upserted(fresh.unionByName(same), stored, as_of, reembed))
        return told.select("external_id", (F.size("errors") == 0).alias("ok"), F.nullif(F.array_join("errors", "; "), F.lit("")).alias("error"))

    @staticmethod
    def summary(report: DataFrame) -> DataFrame:
        """total, succeeded, failed of a report with ok."""
        return report.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))

    def setup(self, products: DataFrame, as_of: Column) -> DataFrame:
        """A corpus that holds exactly these products: an upsert, then everything else is archived."""
        report = self.upsert(products, as_of)
        self.reconcile(products.select("external_id"), as_of, as_of, dry_run=False)
        return report

    def update_prices(self, patch: DataFrame, as_of: Column) -> DataFrame:
        """patch(external_id[, price][, in_stock]): a column that is there is set, one that isn't stays."""
        has = {c: c in patch.columns for c in ("price", "in_stock")}
        if not any(has.values()):
            raise ValueError("a patch needs price or in_stock")
        last = sync.last_of_batch(sync.first_seen_order(patch), "ord").drop("ord")
        p = last.select("external_id", F.lit(has["price"]).alias("has_price"), (F.col("price") if has["price"] else F.lit(None)).cast("double").alias("price"), F.lit(has["in_stock"]).alias("has_stock"), (F.col("in_stock") if has["in_stock"] else F.lit(None)).cast("boolean").alias("in_stock"))
        after, report = sync.price_patched(p, self.store.read(), as_of)
        self.store.write(after)
        return report

    def set_archived(self, ids: DataFrame, flag: bool, as_of: Column) -> DataFrame:
        before = self.store.read()
        self.store.write(sync.archived(ids, before, flag, as_of))
        return sync.report(ids, before)

    def delete(self, ids: DataFrame) -> DataFrame:
        before = self.store.read()
        self.store.write(sync.deleted(ids, before))
        return sync.report(ids, before)

    def reconcile(self, ids: DataFrame, started: Column, as_of: Column, dry_run: bool = True, max_archived: int | None = None) -> DataFrame:
        before = self.store.read()
        found, after = sync.reconcile(ids, before, started, as_of, dry_run, max_archived)
        if not dry_run:
            self.store.write(after)
        return found

    def diff(self, ids: DataFrame) -> DataFrame:
        return sync.diff(ids, self.store.read())

    def stats(self) -> DataFrame:
        return sync.stats(self.store.read())

    def import_file(self, path: str, as_of: Column, mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(result of the upsert of the valid rows, the first errors by row number)."""
        good, bad, _ = self._imported(path, mapping)
        return self.upsert(good, as_of), bad

    def _imported(self, path: str, mapping: dict[str, str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = imports.read_rows(self.spark, path).withColumn("__row", F.monotonically_increasing_id() + 1)
        checked = imports.checked(imports.map_columns(rows, mapping))
        good, bad = imports.split_valid(checked)
        return good.orderBy("row").drop("row"), bad, checked

    def import_job(self, path: str, as_of: Column, jobs: sync.JobStore, mapping: dict[str, str] | None = None) -> str:
        """An import that jobs knows of: pending, running, then completed or failed with what it got to. Returns the job's id."""
        job = jobs.create(path)
        jobs.save(job, status="running")
        try:
            good, bad, checked = self._imported(path, mapping)
            counts = checked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") > 0).alias("failed")).first()
            jobs.save(job, total=counts["total"], failed=counts["failed"], errors=[f"row {r['row']}: {r['error']}" for r in bad.collect()])  # MAX_ERRORS at most
        except Exception as e:  # noqa: BLE001
            jobs.save(job, status="failed", detail=f"Cannot parse file: {e}")
            return job
        try:
            self.upsert(good, as_of)
            jobs.save(job, status="completed", processed=counts["total"] - counts["failed"])
        except Exception as e:  # noqa: BLE001
            jobs.save(job, status="failed", detail=f"Ingestion error after 0 rows: {e}")  # one write: all rows or none
        return job

    def _requests(self, requests: DataFrame, filters: Filters | None, limit: int, offset: int, strict: bool, rerank: bool) -> DataFrame:
        """requests with every option, from its own column or else from the call, and r, the filters."""
        have = set(requests.columns)
        options = {"limit": F.lit(limit), "offset": F.lit(offset), "rerank": F.lit(rerank), "mode": F.lit("strict" if strict else "relaxed")}
        given = as_columns(filters or Filters())
        r = requests.withColumn("query", F.regexp_replace("query", r"(?U)^\s+|\s+$", ""))
        for c, v in (options | given).items():
            r = r.withColumn(c, F.coalesce(F.col(c).cast(REQUEST.get(c, "string" if c == "mode" else "boolean" if c == "rerank" else "int")), v) if c in have else v)
        return r.select("query_id", "query", *options, F.struct(*REQUEST).alias("r"))

    def request_errors(self, requests: DataFrame, filters: Filters | None = None, limit: int = 10, offset: int = 0, strict: bool = False, rerank: bool = False) -> DataFrame:
        """query_id, error of the requests that a search leaves without hits."""
        return self._checked_requests(self._requests(requests, filters, limit, offset, strict, rerank)).where("error <> ''").select("query_id", "error")

    def _checked_requests(self, r: DataFrame) -> DataFrame:
        n = F.length(F.coalesce("query", F.lit("")))
        bad = [
            F.when((n < 1) | (n > MAX_QUERY), f"query: 1 to {MAX_QUERY} characters"), F.when(~F.col("limit").between(1, MAX_LIMIT), f"limit: 1 to {MAX_LIMIT}"),
            F.when(~F.col("offset").between(0, MAX_OFFSET), f"offset: 0 to {MAX_OFFSET}"), F.when(~F.col("mode").isin("relaxed", "strict"), "mode: relaxed or strict"),
            F.when((F.col("r.price_min") < 0) | (F.col("r.price_max") < 0), "price: not below zero"),
        ]
        if self.config.rerank is None:
            bad.append(F.when(F.col("rerank"), "rerank: no reranker is configured"))
        return r.withColumn("error", F.array_join(F.array_compact(F.array(*bad)), "; "))

    def search(self, requests: DataFrame, filters: Filters | None = None, limit: int = 10, offset: int = 0, strict: bool = False, rerank: bool = False) -> DataFrame:
        """requests(query_id, query) -> query_id, query_kind, bucket, rank, total, external_id, score, branch, matched_field, code_score, tier, reranked, query_coverage, missing_terms.

        Every option may also be a column of requests: limit, offset, mode (relaxed, strict), rerank and the filters (brand, category,
        price_min, price_max, in_stock, attributes, include_archived); a null takes the call's value. A query of codes alone with a
        strong code hit is answered by its code hits only, even if filters leave none. A request that breaks a rule has no hits, see
        request_errors().
        """
        if not 1 <= limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
            raise ValueError(f"limit is 1 to {MAX_LIMIT}, offset 0 to {MAX_OFFSET}")
        if rerank and self.config.rerank is None:
            raise ValueError("no reranker is configured")
        stored = self.store.read()
        asked = search.classify(self._checked_requests(self._requests(requests, filters, limit, offset, strict, rerank)).where("error = ''").drop("error"))
        asked = cut(asked.withColumn("k", F.greatest(F.lit(self.config.prefetch), F.col("offset") + F.col("limit"))).select("query_id", "query", "query_kind", "code_norms", "limit", "offset", "mode", "rerank", "r", "k"))
        most = asked.agg(F.max("k")).first()[0] or self.config.prefetch  # MAX_LIMIT + MAX_OFFSET at most
        products = stored.select("external_id", F.struct(*PRODUCT).alias("p"))
        wants = asked.select("query_id", "r", "k")

        def allowed(hits: DataFrame) -> DataFrame:
            return hits.join(wants, "query_id").join(products, "external_id").where(matches(F.col("r"), F.col("p"))).drop("r", "p")

        hits = cut(codes.best_per_product(codes.cascade(search.code_tokens(asked), codes.code_index(stored))))
        strong = hits.where(F.col("score") >= codes.STRONG).select("query_id").distinct().join(asked.where("query_kind = 'code_only'"), "query_id", "left_semi")
        rest = asked.join(strong, "query_id", "left_anti")
        entries = attribute_entries(F.col("attributes"))
        sparse = text.sparse_text(self._dense_text(), [F.col("article"), F.col("product_code"), F.col("ean13")], F.col("enrichment.normalized_title"), F.coalesce("enrichment.synonyms", F.array().cast("array<string>")))
        spaced = F.concat_ws(" ", "query", F.array_join("code_norms", " "))
        scored = retrieval.bm25_scores(rest.select("query_id", spaced.alias("query")), stored.select(F.col("external_id").alias("doc_id"), sparse.alias("text")))
        terms = retrieval.top_k(allowed(scored.withColumnRenamed("doc_id", "external_id")).withColumnRenamed("external_id", "doc_id"), most).where(F.col("rank") <= F.col("k"))
        embed = self.config.embed_query or self.config.embed
        near = retrieval.dense_topk(rest.select("query_id", embed(F.col("query")).alias("vector"), "r"), stored.select(F.col("external_id").alias("doc_id"), F.col("dense").alias("vector"), F.struct(*PRODUCT).alias("p")), most, matches)
        near = near.join(wants.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
        fused = retrieval.rrf([near, terms], most).join(asked.select("query_id", "query", "k", "rerank"), "query_id").where(F.col("rank") <= F.col("k")).withColumnRenamed("doc_id", "external_id")
        if self.config.rerank is not None:
            cards = stored.select("external_id", text.rerank_text(F.col("name"), F.col("brand"), F.col("category"), entries, F.col("description")).alias("card"))
            fused = retrieval.rerank(fused.join(cards, "external_id"), self.config.rerank(F.col("query"), F.col("card")), where=F.col("rerank"))
        merged = search.merge(allowed(hits).drop("k"), fused.select("query_id", "external_id", "score", "rank", *(["reranked"] if self.config.rerank is not None else [])))
        parts = [F.col(c) for c in ("name", "brand", "category", "description", "article", "product_code", "ean13")] + [F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")]
        parts += [F.col("enrichment.normalized_title"), *(F.array_join(f"enrichment.{x}", " ") for x in ("synonyms", "use_cases")), F.col("enrichment.spec_summary")]
        hay = stored.select("external_id", coverage.haystack(parts).alias("hay")).withColumn("words", coverage.haystack_words(F.col("hay"))).withColumn("groups", coverage.unit_groups(F.col("words")))
        needed = text.significant_tokens(F.col("query"))
        variants = None
        if self.config.expand is not None:
            variants = F.when(F.col("mode") == "strict", enrich.parse_variants(self.config.expand(F.when(F.col("mode") == "strict", F.col("query")))))
            variants = F.coalesce(variants, F.create_map().cast("map<string,array<string>>"))
        out = cut(merged).join(asked.select("query_id", "query_kind", "limit", "offset", "mode", coverage.requirements(needed, variants).alias("reqs")), "query_id").join(hay, "external_id")
        out = out.withColumn("missing", coverage.missing(F.col("reqs"), F.col("hay"), F.col("words"), F.col("groups")))
        hybrid = F.col("branch") == "hybrid"
        out = out.withColumn("query_coverage", F.when(hybrid, F.round(coverage.ratio(F.col("reqs"), F.col("missing")), 3))).withColumn("missing_terms", F.when(hybrid & (F.size("missing") > 0), F.array_join("missing", " ")))
        relaxed = search.page(out.where("mode = 'relaxed'").withColumn("bucket", F.lit("items")), F.col("offset"), F.col("limit"))
        split = search.strict_split(out.where("mode = 'strict'"), F.col("limit")).drop("rank").withColumnRenamed("bucket_rank", "rank")
        items = search.page(split.where("bucket = 'items'"), F.col("offset"), F.col("limit"))
        out = relaxed.unionByName(items).unionByName(split.where("bucket = 'alternatives'").withColumn("total", F.lit(None).cast("long")))
        return out.select("query_id", "query_kind", "bucket", "rank", "total", "external_id", "score", "branch", "matched_field", "code_score", "tier", "reranked", "query_coverage", "missing_terms")
