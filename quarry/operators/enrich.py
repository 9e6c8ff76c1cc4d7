"""Model answers: parsing and tidying, and one call per distinct product card."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is kept of an answer.
SYNONYMS, USES, ATTRIBUTES, VALUE_CHARS, TEXT_CHARS = 12, 6, 16, 80, 400
VARIANTS, VARIANT_CHARS = 8, 48


def _tidy(c: Column, chars: int) -> Column:
    return F.trim(F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, chars))


def clean_list(items: Column, most: int) -> Column:
    """Tidy strings, no two equal but for case, the first spelling kept."""
    tidy = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: _tidy(x, VALUE_CHARS)), lambda x: x.isNotNull() & (x != ""))
    once = F.aggregate(tidy, F.array().cast("array<string>"), lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.concat(s, F.array(x))))
    return F.slice(once, 1, most)


ANSWER = "normalized_title string, synonyms array<string>, attributes map<string,string>, use_cases array<string>, spec_summary string"


def parse_enrichment(raw: Column) -> Column:
    """A struct of the answer's parts; null if it is no JSON object or nothing in it is of use."""
    a = F.from_json(F.when(F.trim(raw).startswith("{"), raw), ANSWER)
    entries = F.coalesce(F.map_entries(a["attributes"]), F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.transform(entries, lambda e: F.struct(F.regexp_replace(F.lower(F.trim(e["key"])), r"(?U)\s+", "_").alias("key"), _tidy(e["value"], VALUE_CHARS).alias("value")))
    entries = F.slice(F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != "")), 1, ATTRIBUTES)
    title, summary = (F.coalesce(_tidy(a[x], TEXT_CHARS), F.lit("")) for x in ("normalized_title", "spec_summary"))
    out = F.struct(title.alias("normalized_title"), clean_list(a["synonyms"], SYNONYMS).alias("synonyms"), entries.alias("attributes"), clean_list(a["use_cases"], USES).alias("use_cases"), summary.alias("spec_summary"))
    any_ = (out["normalized_title"] != "") | (F.size(out["synonyms"]) > 0) | (F.size(out["attributes"]) > 0) | (F.size(out["use_cases"]) > 0) | (out["spec_summary"] != "")
    return F.when(any_, out)


def parse_variants(raw: Column) -> Column:
    """token -> its variants from a JSON object; lower case, trimmed, VARIANTS of VARIANT_CHARS at most."""
    m = F.from_json(F.when(F.trim(raw).startswith("{"), raw), "map<string,array<string>>")
    tidy = lambda k, v: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.substring(F.trim(F.lower(x)), 1, VARIANT_CHARS)), lambda x: x.isNotNull() & (x != ""))), 1, VARIANTS)
    return F.transform_values(m, tidy)


def enrich_all(products: DataFrame, card: Column, call: Callable[[Column], Column]) -> DataFrame:
    """products with enrichment: one call per distinct card, results joined back."""
    marked = products.withColumn("card", card)
    answers = marked.select("card").distinct().withColumn("enrichment", call(F.col("card")))
    return marked.join(answers, "card", "left")
