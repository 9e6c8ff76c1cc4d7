"""Scalar text functions as Column expressions; Arrow UDFs for one thing (NFKC), fed non-ASCII values only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Cyrillic capitals and the Latin letters they look like.
HOMOGLYPHS = ("АВЕЁІЇКМНОРСТУХ", "ABEEIIKMHOPCTYX")
# Letters that optical reading confuses with digits.
SKELETON = ("OQDILZЗSGB", "0001123568")
SEPARATORS = r"[\s\-_./\\,:;#()\[\]]+"
# Units that make a number a measure, not a code.
UNITS = "V W KW A AH MAH WH KWH HZ KHZ MHZ GHZ RPM MM CM M KM ML L G KG T GB TB MB PCS В ВТ КВТ А АЧ МАЧ ГЦ КГЦ МГЦ ГГЦ ОБ ММ СМ М КМ МЛ Л Г КГ Т ГБ ТБ МБ ШТ".split()
MEASURE = r"^[0-9]+([.,][0-9]+)?(" + "|".join(UNITS) + ")$"
CODE_MIN_LENGTH, CODE_DIGIT_SHARE = 4, 0.4
# Words without weight in coverage (Ukrainian, Russian, English).
STOPWORDS = (
    "з зі із на для та і й до у в по без при або чи не є як що "
    "с со и к от о об под над или есть "
    "with for and or the a an of to in on by"
).split()
TOKEN = "[a-zа-яёіїєґ0-9]+"
DESCRIPTION_IN_TEXT, DESCRIPTION_IN_RERANK, DESCRIPTION_IN_CARD = 800, 400, 1500


@pandas_udf(StringType())
def _nfkc(values):
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


@pandas_udf(ArrayType(StringType()))
def _nfkc_each(values):
    import unicodedata

    return values.map(lambda v: None if v is None else [unicodedata.normalize("NFKC", x) for x in v])


def nfkc_each(c: Column) -> Column:
    """The compatibility form of each string of an array."""
    odd = F.exists(c, lambda x: x.rlike(r"[^\x00-\x7F]"))
    return F.when(odd, _nfkc_each(F.when(odd, c))).otherwise(c)


def compact(c: Column, unicode: bool = True) -> Column:
    """Compatibility form, upper case, separators deleted."""
    return F.regexp_replace(F.upper(nfkc(c) if unicode else c), "(?U)" + SEPARATORS, "")


def norm_code(c: Column, unicode: bool = True) -> Column:
    return F.translate(compact(c, unicode), *HOMOGLYPHS)


def skeleton(norm: Column) -> Column:
    return F.translate(norm, *SKELETON)


def is_ean_shape(c: Column) -> Column:
    return c.rlike("^[0-9]{12,14}$")


def is_code_like(c: Column, unicode: bool = True) -> Column:
    """A code has digits, is no measure, and mixes letters and digits enough."""
    raw = compact(c, unicode)
    code = F.translate(raw, *HOMOGLYPHS)
    digits = F.regexp_count(code, F.lit("[0-9]"))
    changes = F.regexp_count(code, F.lit("(?<=[0-9])(?=[A-Z])|(?<=[A-Z])(?=[0-9])"))
    return (
        F.when(F.length(raw) < CODE_MIN_LENGTH, False)
        .when(raw.rlike(MEASURE), False)
        .when(~code.rlike("^[A-Z0-9]+$"), False)
        .when(digits == 0, False)
        .when(digits >= CODE_DIGIT_SHARE * F.length(code), True)
        .when(changes >= 2, True)
        .otherwise(code.rlike("^[A-Z]{1,4}[0-9]{3,}[A-Z0-9]*$"))
    )


def tokens(c: Column) -> Column:
    """Split at Unicode blanks."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def significant_tokens(c: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def collapse(c: Column) -> Column:
    """Blanks to one space, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def digits_only(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^\p{Nd}]", ""), F.lit(""))


def attribute_pairs(entries: Column, between: str = "; ") -> Column:
    """``k: v; k: v`` from an array of (key, value) structs, null when empty."""
    return F.nullif(F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), between), F.lit(""))


def labelled(label: str, c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label + ": "), c, F.lit(".")))


def dense_text(name: Column, brand: Column, category: Column, entries: Column, description: Column, summary: Column | None = None, uses: Column | None = None) -> Column:
    """The text that is embedded: no codes, no synonyms."""
    attrs = attribute_pairs(entries)
    parts = [name, labelled("Бренд", brand), labelled("Категорія", category), F.when(attrs.isNotNull(), F.concat(attrs, F.lit("."))), F.substring(collapse(description), 1, DESCRIPTION_IN_TEXT)]
    if summary is not None:
        parts.append(F.nullif(summary, F.lit("")))
    if uses is not None:
        parts.append(labelled("Застосування", F.nullif(F.array_join(uses, "; "), F.lit(""))))
    return F.concat_ws(" ", *parts)


def sparse_text(dense: Column, codes: list[Column], title: Column | None = None, synonyms: Column | None = None) -> Column:
    """The text for term search: the dense text, every code raw and, if different, normalised."""
    parts = [dense]
    for code in codes:
        parts.append(F.nullif(code, F.lit("")))
        parts.append(F.when((norm_code(code) != code) & (norm_code(code) != ""), norm_code(code)))
    if title is not None:
        parts.append(F.nullif(title, F.lit("")))
    if synonyms is not None:
        parts.append(F.nullif(F.array_join(synonyms, " "), F.lit("")))
    return F.concat_ws(" ", *parts)


def rerank_text(name: Column, brand: Column, category: Column, entries: Column, description: Column) -> Column:
    return F.concat_ws(". ", name, brand, category, attribute_pairs(entries), F.substring(description, 1, DESCRIPTION_IN_RERANK))


def product_card(name: Column, brand: Column, category: Column, article: Column, description: Column) -> Column:
    """What an enricher is shown; equal cards share one call. Attributes are not part of it."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label + ": "), c))
    return F.concat_ws("\n", line("Name", name), line("Brand", brand), line("Category", category), line("Article", article), line("Description", F.substring(description, 1, DESCRIPTION_IN_CARD)))


def point_id(external_id: Column, namespace: str = "3f1d9a52-8c47-5b0e-9d61-2a7e4c90b8f3") -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(external_id, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_hash(fields: list[Column], entries: Column) -> Column:
    """Changes if and only if a field that an embedding reads changes; nulls and types count."""
    canonical = F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)], F.array_sort(entries).alias("attributes")), {"ignoreNullFields": "false"})
    return F.sha2(canonical, 256)
