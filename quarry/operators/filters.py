"""One filter builder for every branch of a search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    brand: str | None = None
    category: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    in_stock: bool | None = None
    attributes: dict = field(default_factory=dict)
    include_archived: bool = False

    def __post_init__(self):
        for bound in (self.price_min, self.price_max):
            if bound is not None and bound < 0:
                raise ValueError("a price bound can't be negative")


def condition(f: Filters) -> Column:
    """True for the products that pass: a missing status is active, a null price fails any bound, empty strings ask for nothing.

    Attributes compare typed: a boolean is no number, an integer equals the same double.
    """
    parts: list[Column] = []
    if not f.include_archived:
        parts.append(F.coalesce(F.col("status"), F.lit("active")) != "archived")
    if f.brand:
        parts.append(F.col("brand_norm") == f.brand.lower())
    if f.category:
        parts.append(F.col("category") == f.category)
    if f.price_min is not None:
        parts.append(F.col("price") >= float(f.price_min))
    if f.price_max is not None:
        parts.append(F.col("price") <= float(f.price_max))
    if f.in_stock is not None:
        parts.append(F.col("in_stock") == f.in_stock)
    for key, value in f.attributes.items():
        at = F.col("attributes")[key]
        if isinstance(value, bool):
            parts.append((at["t"] == "b") & (at["b"] == value))
        elif isinstance(value, (int, float)):
            parts.append((at["t"] == "n") & (at["n"] == float(value)))
        else:
            parts.append((at["t"] == "s") & (at["s"] == value))
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


#: Columns of a product that filters read, and those of a request that ask for them.
PRODUCT = ("status", "brand_norm", "category", "price", "in_stock", "attributes")
VALUES = "map<string,struct<t:string,s:string,n:double,b:boolean>>"
REQUEST = {"brand": "string", "category": "string", "price_min": "double", "price_max": "double", "in_stock": "boolean", "attributes": VALUES, "include_archived": "boolean"}


def value(v) -> Column:
    """A typed attribute value."""
    kind = "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s"
    part = lambda k, to: F.lit(v if kind == k else None).cast(to)
    n = F.lit(float(v) if kind == "n" else None).cast("double")
    return F.struct(F.lit(kind).alias("t"), part("s", "string").alias("s"), n.alias("n"), part("b", "boolean").alias("b"))


def as_columns(f: Filters) -> dict[str, Column]:
    """The filters as columns of a request."""
    given = {k: F.lit(getattr(f, k)).cast(kind) for k, kind in REQUEST.items() if k != "attributes"}
    pairs = [x for k, v in f.attributes.items() for x in (F.lit(k), value(v))]
    return given | {"attributes": (F.create_map(*pairs) if pairs else F.lit(None)).cast(VALUES)}


def matches(r: Column, p: Column) -> Column:
    """condition() with the filters of a request row r (a struct of REQUEST) for a product p (a struct of PRODUCT)."""
    asks = lambda k: r[k].isNotNull() & (r[k] != "")
    ok = lambda c: F.coalesce(c, F.lit(False))

    def same(e: Column) -> Column:
        a, b = F.try_element_at(p["attributes"], e["key"]), e["value"]
        return ok((a["t"] == b["t"]) & F.when(b["t"] == "b", a["b"] == b["b"]).when(b["t"] == "n", a["n"] == b["n"]).otherwise(a["s"] == b["s"]))

    return (
        (ok(r["include_archived"]) | (F.coalesce(p["status"], F.lit("active")) != "archived"))
        & (~asks("brand") | ok(p["brand_norm"] == F.lower(r["brand"])))
        & (~asks("category") | ok(p["category"] == r["category"]))
        & (r["price_min"].isNull() | ok(p["price"] >= r["price_min"]))
        & (r["price_max"].isNull() | ok(p["price"] <= r["price_max"]))
        & (r["in_stock"].isNull() | ok(p["in_stock"] == r["in_stock"]))
        & (r["attributes"].isNull() | F.forall(F.map_entries(F.coalesce(r["attributes"], F.create_map().cast(VALUES))), same))
    )
