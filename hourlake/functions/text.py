"""Identifiers, names and free text."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
PLACEHOLDERS = ["", "unknown", "n/a", "na", "null", "none"]
OUTDOOR_WORDS = ["outdoor", "ngoài trời", "ngoai troi"]
DEFAULT_CAPABILITIES = "temperature,humidity"


def _folding() -> tuple[str, str]:
    """(accented letters, their base letters), derived from the Unicode data by rule."""
    src, dst = [], []
    for code in range(0xC0, 0x1F00):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1 and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_SRC, _DST = _folding()


def strip_accents(c: Column) -> Column:
    """Lower case without accents; letters with no base letter (such as đ) stay."""
    return F.regexp_replace(F.translate(F.lower(c), _SRC, _DST), r"\p{M}+", "")


def slug(c: Column) -> Column:
    """[a-z0-9] only after accent folding; đ and the like are dropped."""
    return F.regexp_replace(strip_accents(F.trim(c)), "[^a-z0-9]+", "")


def table_key(c: Column) -> Column:
    """Key of the table side of a slug match: no accent folding."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def text_variants(c: Column) -> Column:
    """Distinct lower-case readings of a place text, NULL -> empty array."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    forms = F.array(
        raw,
        F.trim(F.split_part(raw, F.lit(","), F.lit(1))),
        F.trim(F.regexp_replace(raw, r"\([^)]*\)", "")),
        F.trim(F.regexp_replace(raw, r"(?i),\s*vietnam\b", "")),
    )
    lowered = F.transform(forms, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(lowered, lambda x: x != ""))


def slug_variants(c: Column) -> Column:
    """slug, loc_slug and loc34_slug of every text variant."""
    slugs = F.array_distinct(F.filter(F.transform(text_variants(c), slug), lambda x: x != ""))
    return F.flatten(
        F.transform(
            slugs,
            lambda s: F.array(s, F.concat(F.lit("loc_"), s), F.concat(F.lit("loc34_"), s)),
        )
    )


def first_present(*cols: Column) -> Column:
    """First value that is neither missing, empty nor the word null."""
    return F.coalesce(*[F.when(~c.cast("string").isin("", "null"), c) for c in cols])


def norm_sensor_id(c: Column) -> Column:
    """`Sensor-007` -> `sensor_7`; anything else trimmed lower case."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    digits = F.regexp_extract(s, r"^sensor[-_]?0*(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("sensor_"), digits)).otherwise(s)


def norm_env(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(OUTDOOR_WORDS), "outdoor").otherwise("indoor")


def null_placeholder(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(PLACEHOLDERS), t)


def sensor_from_topic(c: Column, default: str) -> Column:
    """`sensors/<id>/...` -> id, else the default."""
    parts = F.split(c, "/")
    return F.when((F.size(parts) >= 3) & (parts[0] == "sensors"), parts[1]).otherwise(F.lit(default))


def state_sensor_from_topic(c: Column, prefix: str) -> Column:
    """`<prefix>/devices/<id>/state` -> id, else NULL."""
    parts = F.split(c, "/")
    hit = (F.size(parts) >= 4) & (parts[0] == prefix) & (parts[1] == "devices") & (parts[3] == "state")
    return F.when(hit, parts[2])


def capabilities(c: Column) -> Column:
    return F.split(F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULT_CAPABILITIES)), ",")


def keyword_hit(text: Column, keywords: list[str]) -> Column:
    """True when any accent-folded keyword occurs in the accent-folded text."""
    folded = strip_accents(text)
    hit = F.lit(False)
    for k in keywords:
        if k.strip():
            hit = hit | F.contains(folded, strip_accents(F.lit(k)))
    return hit
