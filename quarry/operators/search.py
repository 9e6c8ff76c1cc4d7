"""Query classes, merging, strict mode and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .codes import STRONG

MIN_ALTERNATIVE = 0.5


def classify(requests: DataFrame) -> DataFrame:
    """Adds code_tokens, code_norms, text_tokens and query_kind: text, code_only or mixed."""
    r = requests.withColumn("__raw", text.tokens(F.col("query"))).withColumn("__folded", text.nfkc_each(F.col("__raw")))
    r = r.withColumn("__t", F.zip_with("__raw", "__folded", lambda t, f: F.struct(t.alias("t"), text.norm_code(f, False).alias("n"), text.is_code_like(f, False).alias("c"))))
    pick = lambda c, what: F.transform(F.filter("__t", lambda x: x["c"] == F.lit(c)), lambda x: x[what])
    r = r.withColumn("code_tokens", pick(True, "t")).withColumn("code_norms", pick(True, "n")).withColumn("text_tokens", pick(False, "t"))
    kind = F.when(F.size("code_tokens") == 0, "text").when(F.size("text_tokens") == 0, "code_only").otherwise("mixed")
    return r.withColumn("query_kind", kind).drop("__raw", "__folded", "__t")


def code_tokens(classified: DataFrame) -> DataFrame:
    """query_id, token_pos, token_norm for the code tokens."""
    return classified.select("query_id", F.posexplode("code_norms").alias("token_pos", "token_norm"))


def merge(code_hits: DataFrame, hybrid_hits: DataFrame, strong_score: float = STRONG) -> DataFrame:
    """Strong code hits first; then weak code hits and hybrid hits in turn, code first; the first place of a product counts.

    code_hits(query_id, external_id, score, code_rank, tier[, field]); hybrid_hits(query_id, external_id, score, rank[, reranked]).
    """
    field = F.col("field") if "field" in code_hits.columns else F.lit(None).cast("string")
    again = F.col("reranked") if "reranked" in hybrid_hits.columns else F.lit(False)
    strong = F.col("score") >= strong_score
    weak_rank = F.row_number().over(Window.partitionBy("query_id", strong).orderBy("code_rank"))
    code = code_hits.withColumn("w", weak_rank).select(
        "query_id", "external_id", "score", F.lit("code").alias("branch"), F.col("score").alias("code_score"), "tier", field.alias("matched_field"), F.lit(False).alias("reranked"),
        F.when(strong, 0).otherwise(1).alias("bucket"), F.when(strong, F.col("code_rank")).otherwise(2 * F.col("w")).alias("slot"),
    )
    hybrid = hybrid_hits.select(
        "query_id", "external_id", "score", F.lit("hybrid").alias("branch"), F.lit(None).cast("double").alias("code_score"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("matched_field"), again.alias("reranked"),
        F.lit(1).alias("bucket"), (2 * F.col("rank") + 1).alias("slot"),
    )
    first = Window.partitionBy("query_id", "external_id").orderBy("bucket", "slot")
    one = code.unionByName(hybrid).withColumn("rn", F.row_number().over(first)).where((F.col("rn") == 1) | F.col("external_id").isNull()).drop("rn")
    order = Window.partitionBy("query_id").orderBy("bucket", "slot")
    return one.withColumn("rank", F.row_number().over(order).cast("long")).drop("bucket", "slot")


def page(hits: DataFrame, offset: Column, limit: Column) -> DataFrame:
    """The rows offset + 1 .. offset + limit of each query, and the total before the cut."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return hits.withColumn("total", total).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def strict_split(hits: DataFrame, limit: Column) -> DataFrame:
    """Confident hits as items; others with half of the query covered, or a weak code hit, as alternatives up to limit.

    hits: query_id, rank, branch, code_score, query_coverage. A rank is given per bucket.
    """
    sure = F.when(F.col("branch") == "code", F.col("code_score") >= STRONG).otherwise(F.col("query_coverage") == 1.0)
    maybe = F.when(F.col("branch") == "code", F.lit(True)).otherwise(F.col("query_coverage") >= MIN_ALTERNATIVE)
    out = hits.withColumn("bucket", F.when(sure, "items").when(maybe, "alternatives")).where(F.col("bucket").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank")).cast("long")
    return out.withColumn("bucket_rank", rank).where((F.col("bucket") == "items") | (F.col("bucket_rank") <= limit))
