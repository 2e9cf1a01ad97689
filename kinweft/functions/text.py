"""Text normalisers and identifiers.

The four normalisers differ on purpose: search keys drop marks and lower-case, merge keys
case-fold and keep letters and digits only, facility keys collapse blanks, legacy keys drop notes
in full-width brackets. They run as vectorised pandas functions where Spark has no equivalent.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that stand alone and still count as diacritics: a fixed value.
LONE_MARKS = set("^`¨¯´·¸ーｰ゛゜゙゚ﾞﾟ＾｀￣")


def is_mark(c: str) -> bool:
    """Whether a character is dropped from a search key."""
    return unicodedata.combining(c) != 0 or c in LONE_MARKS or 0x2B0 <= ord(c) <= 0x2FF


def search_text(value: str | None) -> str | None:
    """Decomposed, without marks, in lower case, blanks collapsed and trimmed."""
    if value is None:
        return None
    if not value.isascii():
        value = "".join(c for c in unicodedata.normalize("NFKD", value) if not is_mark(c))
    else:
        value = value.replace("^", "").replace("`", "")
    return " ".join(value.lower().split())


def merge_text(value: str | None) -> str | None:
    """Composed, case-folded, letters and digits only."""
    return None if value is None else "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if c.isalnum())


def facility_text(value: str | None) -> str | None:
    return None if value is None else " ".join(value.casefold().split())


def legacy_text(value: str | None) -> str | None:
    return None if value is None else re.sub(r"（[^）]*）", "", value).strip().casefold()


def title_text(value: str | None) -> str | None:
    """Underscores to blanks and word starts in capitals; the rest is left as it is."""
    return None if value is None else re.sub(r"\b\w", lambda m: m[0].upper(), value.replace("_", " "))


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _vectorised(fn):
    def column(c: Column | str) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(fn, na_action="ignore")

        return run(F.col(c) if isinstance(c, str) else c)

    return column


normalized_key = _vectorised(search_text)
merge_key = _vectorised(merge_text)
facility_key = _vectorised(facility_text)
legacy_key = _vectorised(legacy_text)
title_label = _vectorised(title_text)


def normalized_lists(a: Column, b: Column, c: Column) -> Column:
    """struct<a,b,c>: three arrays of texts with each text as a search key, null as ''; one pass for all."""

    @F.pandas_udf("struct<a:array<string>,b:array<string>,c:array<string>>")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        known: dict = {}

        def key(v):
            if v not in known:
                known[v] = search_text(v) or ""
            return known[v]

        return pd.DataFrame({n: pd.Series([None if s is None else [key(v) for v in s] for s in col], dtype=object) for n, col in zip("abc", (x, y, z))})

    return run(a, b, c)


def name_variants(c: Column) -> Column:
    """A name written ``base(reading)`` as the whole, the base and the reading; else itself."""
    base = F.trim(F.regexp_extract(c, r"^([^(（]+)[(（]([^)）]+)[)）]\s*$", 1))
    reading = F.trim(F.regexp_extract(c, r"^([^(（]+)[(（]([^)）]+)[)）]\s*$", 2))
    return F.array_distinct(F.filter(F.array(F.trim(c), base, reading), lambda x: x != ""))


def stable_id(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def canonical_hash(c: Column, length: int = 16) -> Column:
    """The digest of a JSON text with sorted keys and without blanks, non-ASCII kept."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest()[:length], na_action="ignore")

    return run(c)


def conflict_id(*parts: Column) -> Column:
    """The digest (20 hex) of parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 20)


def safe_id(c: Column) -> Column:
    """Runs of other characters as one hyphen, ends trimmed of hyphens and colons; empty is ``unknown``."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._:-]+", "-"), r"^[-:]+|[-:]+$", "")
    return F.when(c.isNull() | (clean == ""), "unknown").otherwise(clean)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def localized(names: Column, canonical: Column, language: str) -> Column:
    """The first name in a language, else the canonical one."""
    return F.coalesce(F.try_element_at(F.filter(names, lambda x: x["language"] == language), F.lit(1))["value"], canonical)


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value; one without a label is written out as a title."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), title_label(c))


def value_text(c: Column) -> Column:
    """A JSON value as text: a string as it is, null and empty as '', all else as JSON."""
    v = F.try_parse_json(c)
    return F.when(c.isNull(), "").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v) == "VOID", "").otherwise(F.coalesce(F.to_json(v), c))
