"""Identifier, address and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "https://openalex.org/"
ARXIV = "https?://arxiv[.]org/abs/([.0-9a-z]+)"
_PART = r"[^\s/.,{}()]+"
REPOSITORY = f"github[.]com/({_PART}/{_PART})"


def strip_prefix(url: Column, prefix: str) -> Column:
    return F.replace(url, F.lit(prefix), F.lit(""))


def url_to_id(url: Column, base: str = BASE) -> Column:
    """Numeric id behind one leading letter; null for null, an error for anything else that is no number."""
    return F.substr(strip_prefix(url, base), F.lit(2)).cast("long")


def try_url_to_id(url: Column, base: str = BASE) -> Column:
    """Like :func:`url_to_id`, but null where there is no number."""
    return F.substr(strip_prefix(url, base), F.lit(2)).try_cast("long")


def level_id(url: Column, level: str, base: str = BASE) -> Column:
    """Id of a domain, field or subfield (``level`` in the plural)."""
    return strip_prefix(url, f"{base}{level}/").try_cast("int")


def clean_domain(url: Column, base: str = BASE) -> Column:
    return level_id(url, "domains", base)


def clean_field(url: Column, base: str = BASE) -> Column:
    return level_id(url, "fields", base)


def clean_subfield(url: Column, base: str = BASE) -> Column:
    return level_id(url, "subfields", base)


def clean_source(url: Column, base: str = BASE) -> Column:
    """Digits of a source id, still a string."""
    return strip_prefix(url, f"{base}S")


def source_id(url: Column, base: str = BASE) -> Column:
    """Source id, 0 where none is known."""
    return F.coalesce(clean_source(url, base).try_cast("long"), F.lit(0).cast("long"))


def arxiv_id(url: Column) -> Column:
    """Preprint id in an address, null if none; older ids end at their slash."""
    return F.nullif(F.regexp_extract(url, ARXIV, 1), F.lit(""))


def repositories(words: Column) -> Column:
    """owner/name of the first repository address in each word; a dot ends the name."""
    return F.filter(F.transform(words, lambda w: F.regexp_extract(w, REPOSITORY, 1)), lambda x: x != "")


def gender_code(name: Column) -> Column:
    """female and male abbreviated, other values unchanged."""
    return F.when(name == "female", "f").when(name == "male", "m").otherwise(name)


def publication_date(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def seconds_since_2000() -> Column:
    """Seconds of UTC since 2000-01-01."""
    return F.unix_micros(F.current_timestamp()) / 1e6 - F.lit(946684800.0)
