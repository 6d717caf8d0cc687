"""Ingest casts and text cleaning as Column expressions. Bad scalars become null, never an error."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def number(c: Column) -> Column:
    return scalar(c).try_cast("double")


def integer(c: Column) -> Column:
    """Through double, truncated towards zero."""
    return number(c).try_cast("bigint")


def boolean(c: Column) -> Column:
    c = scalar(c)
    return F.when(c.isNotNull(), F.lower(c).isin("true", "1", "yes", "y", "t"))


def epoch_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(F.when(F.abs(number(c)) < 2.5e11, number(c)))


def json_text(c: Column, default: str | None = None) -> Column:
    """Valid JSON as it is, other text as a JSON string, blank as the default."""
    quoted = F.regexp_extract(F.to_json(F.struct(scalar(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    kept = F.when(F.try_parse_json(scalar(c)).isNull(), quoted).otherwise(scalar(c))
    return F.coalesce(F.when(scalar(c).isNotNull(), kept), F.lit(default))


def normalized_name(c: Column) -> Column:
    flat = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(flat, r"(?U)\s+", " "))


def currency(country: Column) -> Column:
    return F.when(country == "vn", "VND").otherwise("IDR")


def shop_or_partition(shop: Column, partition: Column) -> Column:
    """A missing or zero shop id falls back to the directory's."""
    return F.coalesce(F.nullif(shop, F.lit(0).cast("bigint")), partition)


def _stripped() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one base letter and marks, and those bases."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(code):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


_FROM, _TO = _stripped()


def remove_accents(c: Column) -> Column:
    """The crossed d has no decomposition and stays."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")


# Marketing phrases dropped from titles, in order of removal.
MARKETING = [
    r"\b(?:official\s*(?:store|shop)|officialstore|official)\b",
    r"\b(?:free\s*gift|gift|hadiah|quà\s*tặng|tặng\s*quà|quà\s*tặng\s*không\s*bán)\b",
    r"\b(?:flash\s*sale|hot\s*sale|new\s*launch|mua\s*\d+\s*tặng\s*\d+)\b",
    r"\b(?:hỏa\s*tốc|giao\s*hàng|date\s*mới|jadian|promo)\b",
]


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Shop words of brands, and the brackets, links and signs that titles lose.
_SHOP_WORDS = r"\b(?:official\s*(?:store|shop)|officialstore|store|shop)\b"
_TITLE_NOISE = (r"\[[^\]]*\]", r"https?://\S+|www\.\S+", r"[^a-z0-9%+.,/x\s-]")


def brand(c: Column) -> Column:
    c = remove_accents(F.lower(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, _SHOP_WORDS, " ")
    return _squeeze(F.regexp_replace(c, "[^a-z0-9]+", " "))


def title(c: Column) -> Column:
    c = remove_accents(F.lower(F.coalesce(c, F.lit(""))))
    for pattern in [_TITLE_NOISE[0], *MARKETING, *_TITLE_NOISE[1:]]:
        c = F.regexp_replace(c, pattern, " ")
    return _squeeze(c)
