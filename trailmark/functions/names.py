"""Names of ways: several projections that differ on purpose, and the official-list normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of an official street list.
STREET_TYPES = {
    "ST": "street", "AVE": "avenue", "BLVD": "boulevard", "DR": "drive", "CT": "court", "LN": "lane", "PL": "place", "RD": "road", "TER": "terrace",
    "WAY": "way", "ALY": "alley", "CIR": "circle", "HWY": "highway", "PLZ": "plaza", "SQ": "square", "STPS": "steps", "STWY": "stairway", "WALK": "walk",
    "PATH": "path", "ROW": "row", "EXPY": "expressway", "TUNL": "tunnel", "PARK": "park", "LOOP": "loop", "PSGE": "passage", "XING": "crossing", "PKWY": "parkway",
}
#: Corridors whose several names count once, under the canonical one. Edit for your own city.
CORRIDORS = (("Great Highway", ("Great Highway", "Great Highway Promenade", "Lower Great Highway Trail", "Sunset Dunes")),)


def tag(name: str, tags: str | Column = "tags") -> Column:
    """Values of a tag: an array, null if absent."""
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(name))


def values(tag_values: Column) -> Column:
    """Trimmed, lower-cased, non-blank, distinct; absent: empty."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(tag_values, lambda v: F.lower(F.trim(v))), lambda v: v != "")), F.array().cast("array<string>"))


def display_name(tags: str | Column = "tags") -> Column:
    """First name, trimmed; none: the empty string."""
    return F.coalesce(F.trim(F.get(tag("name", tags), F.lit(0))), F.lit(""))


def first_name(tags: str | Column = "tags") -> Column:
    return F.get(tag("name", tags), F.lit(0))


def name_set(tags: str | Column = "tags") -> Column:
    return F.array_distinct(F.coalesce(tag("name", tags), F.array().cast("array<string>")))


def name_key(tags: str | Column = "tags") -> Column:
    """All names in order: ways with the same names in another order have the same key."""
    return F.array_sort(F.coalesce(tag("name", tags), F.array().cast("array<string>")))


def canonical_name(name: Column, corridors: tuple = CORRIDORS) -> Column:
    pairs = [F.lit(x) for canonical, names in corridors for n in names for x in (n, canonical)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def normalized_name(name: Column, corridors: tuple = CORRIDORS) -> Column:
    """Canonical, white space collapsed (Unicode), case folded: a sharp s is `ss`, a last sigma like any other, a dotless i stays.

    Cherokee letters and Greek ones with an iota below fold to their lower-cased forms.
    """
    plain = F.trim(F.regexp_replace(canonical_name(name, corridors), r"(?U)\s+", " "))
    # the optimizer makes lower(upper(x)) into lower(x), so the dotless i comes back in between
    upper = F.translate(F.upper(F.translate(plain, "\u0131", "\ue000")), "\ue000", "\u0131")
    return F.translate(F.lower(upper), "\u03c2", "\u03c3")


def official_name(text: Column) -> Column:
    """A street name as official lists and maps agree on it."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "’", "'"), r"[.,']", "")
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    plain = F.regexp_replace(plain, r"\b0(\d)(st|nd|rd|th)\b", "$1$2")
    words = F.transform(F.split(plain, " "), lambda w: F.when(w == "saint", F.lit("st")).when(w == "mount", F.lit("mt")).otherwise(w))
    return F.array_join(words, " ")


def street_type(code: Column) -> Column:
    """Written-out suffix of an official type code; unknown codes: null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STREET_TYPES.items() for x in pair]), F.upper(F.trim(code)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
