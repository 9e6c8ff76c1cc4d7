"""Product files: JSON arrays, CSV, spreadsheets; column mapping and row validation.

A cell is a string, or a struct CELL that keeps the kind of a JSON or spreadsheet value: t is s (string), n (number), b (truth
value) or o (an object or a list), s its text whatever the kind.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import collapse, digits_only

FIELDS = ("external_id", "name", "description", "brand", "category", "article", "product_code", "ean13", "price", "currency", "in_stock")
# Other names of the fields in supplier files.
ALIASES = {
    "id": "external_id", "код": "product_code", "code": "product_code", "sku": "article", "артикул": "article",
    "ean": "ean13", "barcode": "ean13", "штрихкод": "ean13", "назва": "name", "название": "name",
    "опис": "description", "описание": "description", "бренд": "brand", "категорія": "category",
    "категория": "category", "ціна": "price", "цена": "price",
}
# Longest values.
LIMITS = {"external_id": 128, "name": 512, "description": 10_000, "brand": 128, "category": 256, "article": 64, "product_code": 64, "ean13": 32, "currency": 8}
MAX_ERRORS, MAX_BYTES = 100, 100 * 1024 * 1024
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


class UnsupportedFile(ValueError):
    pass


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, each value a string or a cell; the kind is told by the extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
        return df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if kind == "json":
        return read_json(spark, path)
    if kind in ("xlsx", "xlsm"):
        return read_sheet(spark, path)
    raise UnsupportedFile(f"no reader for .{kind}")


CELL = "struct<t:string,s:string,n:double,b:boolean>"


def cell(v: Column) -> Column:
    """A variant as a cell; a null stays null."""
    kind = F.schema_of_variant(v)
    t = F.when(kind == "STRING", "s").when(kind == "BOOLEAN", "b").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "n").otherwise("o")
    s = F.when(t == "o", F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    return F.when(kind != "VOID", F.struct(t.alias("t"), s.alias("s"), F.when(t == "n", F.try_variant_get(v, "$", "double")).alias("n"), F.when(t == "b", F.try_variant_get(v, "$", "boolean")).alias("b")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, a row each and a column of cells per key; every value keeps its own kind."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff?\\s*", "").alias("value"))
    if whole.where(F.startswith("value", F.lit("["))).isEmpty():
        raise UnsupportedFile("a JSON file must hold an array of rows")
    rows = whole.select(F.posexplode(F.from_json("value", "array<map<string,variant>>")).alias("pos", "m"))
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("m"))).distinct().collect())  # column names
    return rows.orderBy("pos").select(*[cell(F.try_element_at("m", F.lit(k))).alias(k) for k in keys])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _active_sheet(z: zipfile.ZipFile) -> str:
    """The sheet that was open when the file was saved; the first one by name in an archive without a workbook part."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        view, sheets = book.find("m:bookViews/m:workbookView", _NS), book.findall("m:sheets/m:sheet", _NS)
        at = int(view.get("activeTab", "0")) if view is not None else 0
        of = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if at < len(sheets) and (target := of.get(sheets[at].get(_REL))):
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path in names:
                return path
    return sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]


def _number(text: str) -> tuple:
    return ("n", text, float(text), None)


def sheet_rows(content: bytes) -> list[list[tuple | None]]:
    """The active sheet's cells (t, s, n, b), by the file format's own XML; results of formulas, not formulas."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        first = _active_sheet(z)
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{_NS['m']}}}row"):
            cells: list[tuple | None] = []
            for c in row.findall("m:c", _NS):
                letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    cells[at] = ("s", "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), None, None)
                elif v is not None and v.text is not None:
                    told = v.text == "1"
                    cells[at] = ("s", shared[int(v.text)], None, None) if kind == "s" else ("b", str(told).lower(), None, told) if kind == "b" else _number(v.text) if kind in (None, "n") else ("s", v.text, None, None)
            out.append(cells)
        return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet is one small archive (MAX_BYTES at most): its header is read on the driver, its rows by one task."""
    blob = spark.read.format("binaryFile").load(path)
    if (blob.agg(F.max("length")).first()[0] or 0) > MAX_BYTES:
        raise UnsupportedFile("the file is too large")
    rows = sheet_rows(bytes(blob.select("content").first()[0]))
    if not rows:
        return spark.createDataFrame([], StructType([StructField("col0", StringType())]))
    header = [h[1] if h and h[1] else f"col{i}" for i, h in enumerate(rows[0])]
    body = [tuple((r + [None] * len(header))[: len(header)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{h.replace('`', '``')}` {CELL}" for h in header))


_NO_VALUES = "array<struct<key:string,value:struct<t:string,s:string,n:double,b:boolean>>>"


def map_columns(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Product columns as strings, attributes (a map of typed values of what belongs to no field) and attribute_errors; a column __row stays as row.

    Explicit mapping (exact name, trimmed) before field names before aliases (both in any case). Blank values count as
    absent; of several columns for one field the last filled one wins. A column ``attributes`` that holds an object of plain
    values wins over spilled columns; an object or a list within it is an error.
    """
    mapping = mapping or {}
    of: dict[str, list[str]] = {}
    spilled = []
    given = None
    kinds = dict(rows.dtypes)
    for c in rows.columns:
        name = c.strip()
        field = mapping.get(name) or (name.lower() if name.lower() in FIELDS else None) or ALIASES.get(name.lower())
        if name == "__row":
            continue
        if field in FIELDS:
            of.setdefault(field, []).append(c)
        elif name.lower() == "attributes":
            given = c
        else:
            spilled.append(c)

    def as_cell(c: str) -> Column:
        col = F.col(f"`{c}`")
        return col if kinds[c] == CELL else F.when(col.isNotNull(), F.struct(F.lit("s").alias("t"), col.cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b")))

    def typed(x: Column) -> Column:
        """A cell as an attribute value: an object is kept as its text, a blank string is absent."""
        return F.when(x["t"].isin("n", "b"), F.struct(x["t"].alias("t"), F.lit(None).cast("string").alias("s"), x["n"].alias("n"), x["b"].alias("b"))).when(
            F.trim(x["s"]) != "", F.struct(F.lit("s").alias("t"), F.trim(x["s"]).alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b")))

    value = lambda c: F.nullif(F.trim(as_cell(c)["s"]), F.lit(""))
    cols = [F.coalesce(*[value(c) for c in reversed(of[f])]).alias(f) if f in of else F.lit(None).cast("string").alias(f) for f in FIELDS]
    none = F.array().cast(_NO_VALUES)
    entries = F.filter(F.array(*[F.struct(F.lit(c.strip()).alias("key"), typed(as_cell(c)).alias("value")) for c in spilled]), lambda e: e["value"].isNotNull()) if spilled else none
    errors = F.array().cast("array<string>")
    if given:
        parsed = F.from_json(value(given), "map<string,variant>")
        own = F.coalesce(F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("key"), cell(e["value"]).alias("value"))), none)
        errors = F.when(value(given).isNotNull() & parsed.isNull(), F.array(F.lit("attributes: not an object"))).otherwise(
            F.transform(F.filter(own, lambda e: e["value"]["t"] == "o"), lambda e: F.concat(F.lit("attributes."), e["key"], F.lit(": not a plain value"))))
        own = F.filter(F.transform(own, lambda e: F.struct(e["key"].alias("key"), typed(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())
        entries = F.concat(F.filter(entries, lambda e: ~F.exists(own, lambda o: o["key"] == e["key"])), own)
    row = [F.col("__row").cast("long").alias("row")] if "__row" in rows.columns else []
    return rows.select(*row, *cols, F.map_from_entries(entries).alias("attributes"), errors.alias("attribute_errors"))


def checked(mapped: DataFrame) -> DataFrame:
    """Typed product columns with errors, an array of ``field: reason`` (empty: the row is valid). For mapped rows and direct ones alike."""
    df = mapped
    for c in ("name", "description", "brand", "category"):
        df = df.withColumn(c, collapse(F.col(c)))
    df = df.withColumn("ean13", digits_only(F.col("ean13"))).withColumn("currency", F.coalesce("currency", F.lit("UAH")))
    stock = F.lower(F.col("in_stock").cast("string"))
    price = F.expr("try_cast(price AS DOUBLE)")
    bad = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in ("external_id", "name")]
    bad += [F.when(F.length(c) > n, F.lit(f"{c}: too long")) for c, n in LIMITS.items()]
    bad += [
        F.when(F.col("price").isNotNull() & price.isNull(), F.lit("price: not a number")),
        F.when(price.isNotNull() & ~(price >= 0) | F.isnan(price), F.lit("price: below zero")),
        F.when(stock.isNotNull() & ~stock.isin(*TRUE, *FALSE), F.lit("in_stock: not a truth value")),
    ]
    errors = F.array_compact(F.array(*bad))
    if "attribute_errors" in df.columns:
        errors = F.concat(errors, "attribute_errors")
    errors = F.when(F.monotonically_increasing_id() >= 0, errors)  # always; keeps filters on errors from repeating all of the above below it
    flag: Column = F.when(stock.isin(*TRUE), True).when(stock.isin(*FALSE), False).when(stock.isNull(), True)
    return df.withColumn("errors", errors).withColumn("price", price).withColumn("in_stock", flag).drop("attribute_errors")


def split_valid(df: DataFrame, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(valid rows, the first MAX_ERRORS errors by row number with their text)."""
    good = df.where(F.size("errors") == 0).drop("errors")
    return good, df.where(F.size("errors") > 0).select(row, F.array_join("errors", "; ").alias("error")).orderBy(row).limit(MAX_ERRORS)
