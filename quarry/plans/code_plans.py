"""Queries over scalar functions, codes and filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ean, text
from ..operators import codes, filters, search
from .views import CATALOG, CODES, SPOILED, TOKENS, catalog, code_query_tokens, d_check, d_code_like, d_compact, d_norm, d_skel, d_valid, spoiled, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {CATALOG}, {SPOILED} SELECT p_partkey, query, {d_norm('query')} AS norm FROM spoiled")
def norm_code(spark, sf_dir):
    return spoiled(catalog(spark, sf_dir)).select("p_partkey", "query", text.norm_code(F.col("query")).alias("norm"))


@query(f"WITH {CATALOG}, {SPOILED} SELECT p_partkey, {d_skel(d_norm('query'))} AS skel FROM spoiled")
def ocr_skeleton(spark, sf_dir):
    return spoiled(catalog(spark, sf_dir)).select("p_partkey", text.skeleton(text.norm_code(F.col("query"))).alias("skel"))


_WORDS = r"""words AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS token FROM conversations
  UNION SELECT query FROM spoiled UNION SELECT size || 'mm' FROM catalog UNION SELECT name FROM catalog)"""


@query(f"WITH {CATALOG}, {SPOILED}, {_WORDS}, c AS (SELECT token, {d_compact('token')} AS c FROM words) SELECT token, {d_code_like('c')} AS code_like FROM c")
def is_code_like(spark, sf_dir):
    c = catalog(spark, sf_dir)
    words = table(spark, sf_dir, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    for extra in (spoiled(c).select("query"), c.select(F.concat(F.col("size").cast("string"), F.lit("mm"))), c.select("name")):
        words = words.union(extra)
    return words.distinct().select("token", text.is_code_like(F.col("token"), False).alias("code_like"))


_CLASSIFY = rf"""q AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user' UNION ALL SELECT -p_partkey, 0, query || ' ' || name FROM spoiled JOIN catalog USING (p_partkey)
  UNION ALL SELECT -p_partkey, 1, query FROM spoiled),
t AS (SELECT conv_id, turn, list_filter(string_split_regex(query, '\s+'), lambda t: t <> '') AS ts FROM q),
k AS (SELECT conv_id, turn, len(ts) AS n, len(list_filter(list_transform(ts, lambda x: {d_compact('x')}), lambda c: {d_code_like('c')})) AS m FROM t),
kinds AS (SELECT conv_id, turn, CAST(m AS BIGINT) AS n_code, CAST(n - m AS BIGINT) AS n_text, CASE WHEN m = 0 THEN 'text' WHEN n = m THEN 'code_only' ELSE 'mixed' END AS query_kind FROM k)"""


def _classified(spark, sf_dir):
    c = catalog(spark, sf_dir)
    s = spoiled(c)
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("query"))
    q = q.union(s.join(c, "p_partkey").select(-F.col("p_partkey"), F.lit(0).cast("long"), F.concat_ws(" ", "query", "name")))
    return search.classify(q.union(s.select(-F.col("p_partkey"), F.lit(1).cast("long"), "query")))


@query(f"WITH {CATALOG}, {SPOILED}, {_CLASSIFY} SELECT conv_id, CAST(turn AS BIGINT) AS turn, n_code, n_text, query_kind FROM kinds")
def classify_queries(spark, sf_dir):
    return _classified(spark, sf_dir).select("conv_id", "turn", F.size("code_tokens").cast("long").alias("n_code"), F.size("text_tokens").cast("long").alias("n_text"), "query_kind")


@query(f"WITH {CATALOG}, {SPOILED}, {_CLASSIFY} SELECT query_kind, count(*) AS n, round(avg(n_code + n_text), 6) AS mean_tokens FROM kinds GROUP BY 1")
def kind_metrics(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("query_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("code_tokens") + F.size("text_tokens")), 6).alias("mean_tokens"))


@query(f"WITH {CATALOG}, {SPOILED}, x AS (SELECT p_partkey, {d_norm('query')} AS t, ean13 FROM spoiled JOIN catalog USING (p_partkey)) SELECT p_partkey, {d_check('ean13')} AS digit, {d_valid('ean13')} AS ok, CASE WHEN regexp_matches(t, '^[0-9]{{13}}$') THEN {d_valid('t')} ELSE false END AS query_ok FROM x")
def ean_check(spark, sf_dir):
    c = catalog(spark, sf_dir)
    x = spoiled(c).join(c.select("p_partkey", "ean13"), "p_partkey").withColumn("t", text.norm_code(F.col("query"), False))
    return x.select("p_partkey", ean.check_digit(F.col("ean13")).alias("digit"), ean.is_valid(F.col("ean13")).alias("ok"), ean.is_valid(F.col("t")).alias("query_ok"))


def _candidates(x: str) -> str:
    subs = f"flatten(list_transform(range(1, 14), lambda p: list_transform(range(0, 10), lambda d: substr({x}, 1, p - 1) || d || substr({x}, p + 1))))"
    swaps = f"list_transform(range(1, 13), lambda p: substr({x}, 1, p - 1) || substr({x}, p + 1, 1) || substr({x}, p, 1) || substr({x}, p + 2))"
    return f"list_distinct(list_filter(list_concat({subs}, {swaps}), lambda y: y <> {x} AND {d_valid('y')}))"


_WRONG = "w AS (SELECT p_partkey, substr(ean13, 1, 12) || CAST((CAST(substr(ean13, 13, 1) AS INT) + 1) % 10 AS VARCHAR) AS x, ean13, substr(ean13, 1, 12) AS x12, '1' || ean13 AS x14 FROM catalog)"


def _wrong(spark, sf_dir):
    last = F.substring("ean13", 13, 1).cast("int")
    return catalog(spark, sf_dir).select("p_partkey", F.concat(F.substring("ean13", 1, 12), ((last + 1) % 10).cast("string")).alias("x"), "ean13", F.substring("ean13", 1, 12).alias("x12"), F.concat(F.lit("1"), "ean13").alias("x14"))


@query(f"WITH {CATALOG}, {_WRONG} SELECT p_partkey, unnest({_candidates('x')}) AS candidate FROM w")
def ean_candidates(spark, sf_dir):
    return _wrong(spark, sf_dir).select("p_partkey", F.explode(ean.correction_candidates(F.col("x"))).alias("candidate"))


@query(f"""WITH {CATALOG}, {_WRONG}, v AS (SELECT p_partkey, 13 AS of_length, [ean13] AS c FROM w
  UNION ALL SELECT p_partkey, 12, list_distinct(list_concat(CASE WHEN {d_valid("('0' || x12)")} THEN ['0' || x12] ELSE [] END, [x12 || {d_check('x12')}])) FROM w
  UNION ALL SELECT p_partkey, 14, list_distinct(list_concat(CASE WHEN {d_valid('substr(x14, 2, 13)')} THEN [substr(x14, 2, 13)] ELSE [] END, CASE WHEN {d_valid('substr(x14, 1, 13)')} THEN [substr(x14, 1, 13)] ELSE [] END)) FROM w)
  SELECT p_partkey, of_length, unnest(c) AS variant FROM v""")
def ean_variants(spark, sf_dir):
    w = _wrong(spark, sf_dir)
    one = lambda n, c: w.select("p_partkey", F.lit(n).alias("of_length"), F.explode(ean.variants(F.col(c))).alias("variant"))
    return one(13, "ean13").union(one(12, "x12")).union(one(14, "x14"))


_DENSE = "name || ' Бренд: ' || brand || '. Категорія: ' || category || '. size: ' || size || '.'"


def _entries():
    return F.array(F.struct(F.lit("size").alias("key"), F.col("size").cast("string").alias("value")))


def _dense():
    return text.dense_text(F.col("name"), F.col("brand"), F.col("category"), _entries(), F.lit(None).cast("string"))


@query(f"WITH {CATALOG} SELECT external_id, {_DENSE} AS dense FROM catalog")
def compose_dense(spark, sf_dir):
    return catalog(spark, sf_dir).select("external_id", _dense().alias("dense"))


@query(f"WITH {CATALOG} SELECT external_id, {_DENSE} || ' ' || article || ' ' || replace(article, '-', '') || ' ' || product_code || ' ' || ean13 AS sparse FROM catalog")
def compose_sparse(spark, sf_dir):
    return catalog(spark, sf_dir).select("external_id", text.sparse_text(_dense(), [F.col("article"), F.col("product_code"), F.col("ean13")]).alias("sparse"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query(f"WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)) AS ts FROM conversations) SELECT conv_id, turn, CAST(len(ts) AS BIGINT) AS n, array_to_string(ts, ' ') AS tokens FROM t")
def significant_tokens(spark, sf_dir):
    ts = text.significant_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(ts).cast("long").alias("n"), F.array_join(ts, " ").alias("tokens"))


@query(f"WITH {CATALOG} SELECT count(*) AS n, min(external_id) AS first FROM catalog GROUP BY brand, category, size")
def content_hash_groups(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("h", text.content_hash([F.col("brand"), F.col("category")], _entries()))
    return c.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("external_id").alias("first")).drop("h")


_NS = "3f1d9a528c475b0e9d612a7e4c90b8f3"


@query(f"""WITH {CATALOG}, h AS (SELECT external_id, sha1(unhex('{_NS}') || encode(external_id)) AS h FROM catalog)
  SELECT external_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INT) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark, sf_dir):
    return catalog(spark, sf_dir).select("external_id", text.point_id(F.col("external_id")).alias("point_id"))


def _filtered(f):
    return lambda spark, sf_dir: catalog(spark, sf_dir).where(filters.condition(f)).select("external_id", "price")


for _name, _f, _where in (
    ("filter_brand", filters.Filters(brand="Brand#13"), "status <> 'archived' AND brand_norm = 'brand#13'"),
    ("filter_price", filters.Filters(price_min=950.0, price_max=1200.0), "status <> 'archived' AND price BETWEEN 950 AND 1200"),
    ("filter_stock", filters.Filters(in_stock=False), "status <> 'archived' AND NOT in_stock"),
    ("filter_attr", filters.Filters(attributes={"size": 7}), "status <> 'archived' AND size = 7"),
    ("filter_archived", filters.Filters(include_archived=True, price_min=0.0), "price >= 0"),
):
    QUERIES[_name] = _filtered(_f)
    ORACLE[_name] = f"WITH {CATALOG} SELECT external_id, price FROM catalog WHERE {_where}"

_HIT = "t.query_id, t.token_norm, c.external_id, c.field"


def _hits(df):
    return df.select("query_id", "token_norm", "external_id", "field", "score", "tier")


@query(f"WITH {CATALOG}, {SPOILED}, {CODES}, {TOKENS} SELECT {_HIT}, 1.0::DOUBLE AS score, 'exact' AS tier FROM tokens t JOIN codes c ON t.token_norm = c.norm")
def code_exact(spark, sf_dir):
    return _hits(codes.exact(code_query_tokens(spark, sf_dir), codes.code_index(catalog(spark, sf_dir))))


@query(f"WITH {CATALOG}, {SPOILED}, {CODES}, {TOKENS} SELECT {_HIT}, 0.97::DOUBLE AS score, 'exact_normalized' AS tier FROM tokens t JOIN codes c ON {d_skel('t.token_norm')} = c.skel")
def code_skeleton(spark, sf_dir):
    return _hits(codes.look_alike(code_query_tokens(spark, sf_dir), codes.code_index(catalog(spark, sf_dir))))


_FIXED = f"fixed AS (SELECT query_id, token_pos, token_norm, unnest({_candidates('token_norm')}) AS cand FROM tokens WHERE regexp_matches(token_norm, '^[0-9]{{13}}$'))"


@query(f"WITH {CATALOG}, {SPOILED}, {CODES}, {TOKENS}, {_FIXED} SELECT {_HIT}, 0.95::DOUBLE AS score, 'ean_corrected' AS tier FROM fixed t JOIN codes c ON t.cand = c.norm")
def code_ean_corrected(spark, sf_dir):
    return _hits(codes.corrected(code_query_tokens(spark, sf_dir), codes.code_index(catalog(spark, sf_dir))))


STRONG_SQL = f"""WITH {CATALOG}, {SPOILED}, {CODES}, {TOKENS}, {_FIXED}, a AS (
  SELECT t.query_id, t.token_pos, t.token_norm, c.external_id, c.field, c.pos, c.norm, 1.0::DOUBLE AS score, 'exact' AS tier, 1 AS level FROM tokens t JOIN codes c ON t.token_norm = c.norm
  UNION ALL SELECT t.query_id, t.token_pos, t.token_norm, c.external_id, c.field, c.pos, c.norm, 0.97, 'exact_normalized', 2 FROM tokens t JOIN codes c ON {d_skel('t.token_norm')} = c.skel
  UNION ALL SELECT t.query_id, t.token_pos, t.token_norm, c.external_id, c.field, c.pos, c.norm, 0.95, 'ean_corrected', 3 FROM fixed t JOIN codes c ON t.cand = c.norm),
strong AS (SELECT * FROM a QUALIFY level = min(level) OVER (PARTITION BY query_id, token_pos)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, token_pos, external_id) AS code_rank FROM (
  SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY query_id, external_id ORDER BY score DESC, token_pos, pos, norm) = 1))"""


@query(f"{STRONG_SQL} SELECT query_id, external_id, field, score, tier, code_rank FROM best")
def code_cascade_strong(spark, sf_dir):
    hits = codes.cascade(code_query_tokens(spark, sf_dir), codes.code_index(catalog(spark, sf_dir)), with_fuzzy=False)
    return codes.best_per_product(hits).select("query_id", "external_id", "field", "score", "tier", "code_rank")


@query()
def code_fuzzy(spark, sf_dir):
    return _hits(codes.fuzzy(code_query_tokens(spark, sf_dir), codes.code_index(catalog(spark, sf_dir))))


@query()
def code_cascade(spark, sf_dir):
    hits = codes.cascade(code_query_tokens(spark, sf_dir), codes.code_index(catalog(spark, sf_dir)))
    return codes.best_per_product(hits).select("query_id", "external_id", "field", "score", "tier", "code_rank")
