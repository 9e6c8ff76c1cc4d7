"""The catalog and its feeds as views of the star-schema tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ean, text

AS_OF = "2024-06-01 00:00:00"
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    p = p.withColumn("e12", F.concat(F.lit("482"), F.lpad(key, 9, "0")))
    return p.select(
        F.concat(F.lit("part-"), key).alias("external_id"),
        "p_partkey",
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.lower("p_brand").alias("brand_norm"),
        F.col("p_type").alias("category"),
        F.concat(F.upper(F.substring("p_type", 1, 2)), F.lit("-"), F.lpad(key, 5, "0"), F.lit("-"), F.upper(F.substring("p_name", 1, 1))).alias("article"),
        F.lpad((F.col("p_partkey") * 7919 % 100000000).cast("string"), 8, "0").alias("product_code"),
        F.concat("e12", ean.check_digit(F.col("e12"))).alias("ean13"),
        F.col("p_retailprice").alias("price"),
        F.lit("UAH").alias("currency"),
        (F.col("p_size") % 5 != 0).alias("in_stock"),
        F.when(F.col("p_partkey") % 50 == 0, "archived").otherwise("active").alias("status"),
        F.create_map(F.lit("size"), F.struct(F.lit("n").alias("t"), F.lit(None).cast("string").alias("s"), F.col("p_size").cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))).alias("attributes"),
        F.col("p_size").cast("int").alias("size"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(AS_OF)).otherwise(F.lit(START)).cast("timestamp").alias("updated_at"),
    )


def spoiled(c: DataFrame) -> DataFrame:
    """p_partkey, query: one of the product's codes as a user may type it, in four kinds."""
    kind = F.floor(F.col("p_partkey") / 100) % 4
    last = F.substring("ean13", 13, 1).cast("int")
    return c.select(
        "p_partkey",
        F.when(kind == 0, F.lower(F.replace("article", F.lit("-"), F.lit("."))))
        .when(kind == 1, F.concat(F.translate(F.substring("product_code", 1, 2), "05", "OS"), F.substring("product_code", 3, 6)))
        .when(kind == 2, F.concat(F.substring("ean13", 1, 12), ((last + 1) % 10).cast("string")))
        .otherwise(F.concat(F.substring("article", 1, 9), F.lit("X"))).alias("query"),
    )


def code_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every product whose key is divisible by 100, against all products."""
    q = spoiled(catalog(spark, sf_dir)).where(F.col("p_partkey") % 100 == 0)
    return q.select(F.col("p_partkey").alias("query_id"), "query")


def code_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_queries(spark, sf_dir).select("query_id", F.lit(0).alias("token_pos"), text.norm_code(F.col("query"), False).alias("token_norm"))


# DuckDB twins


def d_check(x: str) -> str:
    return f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({x}, i, 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))) % 10) % 10 AS VARCHAR)"


def d_valid(x: str) -> str:
    return f"(length({x}) = 13 AND {d_check(x)} = substr({x}, 13, 1))"


def d_compact(x: str) -> str:
    return rf"regexp_replace(upper({x}), '[\s\-_./\\,:;#()\[\]]+', '', 'g')"


def d_norm(x: str) -> str:
    return f"translate({d_compact(x)}, '{text.HOMOGLYPHS[0]}', '{text.HOMOGLYPHS[1]}')"


def d_skel(x: str) -> str:
    return f"translate({x}, '{text.SKELETON[0]}', '{text.SKELETON[1]}')"


def d_code_like(c: str) -> str:
    """Over a compact form."""
    code = f"translate({c}, '{text.HOMOGLYPHS[0]}', '{text.HOMOGLYPHS[1]}')"
    digits = f"length(regexp_replace({code}, '[^0-9]', '', 'g'))"
    changes = f"len(list_filter(range(1, length({code})), lambda i: (substr({code}, i, 1) BETWEEN '0' AND '9') <> (substr({code}, i + 1, 1) BETWEEN '0' AND '9')))"
    return f"""(CASE WHEN length({c}) < 4 THEN false WHEN regexp_matches({c}, '{text.MEASURE}') THEN false
      WHEN NOT regexp_matches({code}, '^[A-Z0-9]+$') THEN false WHEN {digits} = 0 THEN false
      WHEN {digits} >= 0.4 * length({code}) THEN true WHEN {changes} >= 2 THEN true
      ELSE regexp_matches({code}, '^[A-Z]{{1,4}}[0-9]{{3,}}[A-Z0-9]*$') END)"""


CATALOG = f"""catalog AS (SELECT 'part-' || p_partkey AS external_id, p_partkey, p_name AS name, p_brand AS brand, lower(p_brand) AS brand_norm, p_type AS category,
  upper(substr(p_type, 1, 2)) || '-' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '-' || upper(substr(p_name, 1, 1)) AS article,
  lpad(CAST(p_partkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS product_code, e12 || {d_check('e12')} AS ean13, p_retailprice AS price, 'UAH' AS currency,
  p_size % 5 <> 0 AS in_stock, CASE WHEN p_partkey % 50 = 0 THEN 'archived' ELSE 'active' END AS status, CAST(p_size AS INTEGER) AS size,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN '{AS_OF}' ELSE '{START}' END AS TIMESTAMP) AS updated_at
  FROM (SELECT *, '482' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS e12 FROM part))"""
SPOILED = """spoiled AS (SELECT p_partkey, CASE (p_partkey // 100) % 4 WHEN 0 THEN lower(replace(article, '-', '.'))
  WHEN 1 THEN translate(substr(product_code, 1, 2), '05', 'OS') || substr(product_code, 3, 6)
  WHEN 2 THEN substr(ean13, 1, 12) || CAST((CAST(substr(ean13, 13, 1) AS INT) + 1) % 10 AS VARCHAR)
  ELSE substr(article, 1, 9) || 'X' END AS query FROM catalog)"""
CODES = f"""codes AS (SELECT external_id, field, pos, norm, {d_skel('norm')} AS skel FROM (
  SELECT external_id, 'article' AS field, 0 AS pos, {d_norm('article')} AS norm FROM catalog
  UNION ALL SELECT external_id, 'product_code', 1, {d_norm('product_code')} FROM catalog
  UNION ALL SELECT external_id, 'ean13', 2, {d_norm('ean13')} FROM catalog))"""
TOKENS = f"tokens AS (SELECT p_partkey AS query_id, 0 AS token_pos, {d_norm('query')} AS token_norm FROM spoiled WHERE p_partkey % 100 = 0)"
