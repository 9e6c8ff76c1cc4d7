"""Which words of a query a product covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TOKEN

# Words for the same unit.
UNIT_GROUPS = [
    "гц hz hertz герц герца герців", "кгц khz", "мгц mhz мегагерц", "ггц ghz гігагерц гигагерц",
    "дюйм дюйма дюймів дюймов inch inches in", "вт w watt watts ватт вата ват", "квт kw kilowatt",
    "мм mm millimeter міліметр", "см cm centimeter сантиметр", "кг kg kilogram кілограм килограмм",
    "гб gb гігабайт гигабайт gigabyte", "тб tb терабайт terabyte", "мб mb мегабайт megabyte",
    "мач mah", "мп mp megapixel мегапіксель мегапиксель",
]
STEM_MIN = 5
VARIANTS, VARIANT_CHARS = 8, 48


def haystack(parts: list[Column]) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def haystack_words(hay: Column) -> Column:
    return F.regexp_extract_all(hay, F.lit(TOKEN), F.lit(0))


def _unit_pairs() -> dict[str, int]:
    return {w: i for i, g in enumerate(UNIT_GROUPS) for w in g.split()}


def unit_group(word: Column) -> Column:
    """Number of the word's unit group, null if it is no unit."""
    pairs = _unit_pairs()
    table = F.create_map(*[x for w, i in pairs.items() for x in (F.lit(w), F.lit(i))])
    return F.try_element_at(table, word)


def unit_groups(words: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words, unit_group), lambda g: g.isNotNull()))


def token_covered(token: Column, hay: Column, words: Column, groups: Column) -> Column:
    """A number stands alone among digits anywhere; a unit by its group; else a word starts so, long ones less their last letter."""
    number = F.regexp_like(hay, F.concat(F.lit("(?<![0-9])"), token, F.lit("(?![0-9])")))
    starts = F.exists(words, lambda w: F.startswith(w, token))
    stem = (F.length(token) >= STEM_MIN) & F.exists(words, lambda w: F.startswith(w, F.substring(token, F.lit(1), F.length(token) - 1)))
    return F.when(token.rlike("^[0-9]+$"), number).otherwise(F.coalesce(F.array_contains(groups, unit_group(token)), F.lit(False)) | starts | stem)


def phrase_covered(phrase: Column, hay: Column, words: Column, groups: Column) -> Column:
    ts = F.regexp_extract_all(F.lower(phrase), F.lit(TOKEN), F.lit(0))
    return (F.size(ts) > 0) & F.forall(ts, lambda t: token_covered(t, hay, words, groups))


def requirements(tokens: Column, variants: Column | None = None) -> Column:
    """One requirement per token: the token first, then its variants, VARIANTS at most."""
    empty = F.array().cast("array<string>")
    extra = (lambda t: F.coalesce(F.try_element_at(variants, t), empty)) if variants is not None else (lambda t: empty)
    return F.transform(tokens, lambda t: F.struct(t.alias("name"), F.slice(F.array_distinct(F.concat(F.array(t), extra(t))), 1, VARIANTS).alias("variants")))


def missing(reqs: Column, hay: Column, words: Column, groups: Column) -> Column:
    """Names of the requirements of which no variant is covered, in order."""
    bad = F.filter(reqs, lambda r: ~F.exists(r["variants"], lambda v: phrase_covered(v, hay, words, groups)))
    return F.transform(bad, lambda r: r["name"])


def ratio(reqs: Column, missing_names: Column) -> Column:
    return F.when(F.size(reqs) == 0, F.lit(1.0)).otherwise((F.size(reqs) - F.size(missing_names)) / F.size(reqs))
