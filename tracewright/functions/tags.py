"""Map tags: decoding, and the classifications that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Official road classes and the names that publishers use for them, with words parted by one space.
OFFICIAL_CLASSES = {
    "motorway": "motorway", "m": "motorway", "class m": "motorway",
    "a road": "a-road", "a": "a-road", "class a": "a-road",
    "b road": "b-road", "b": "b-road", "class b": "b-road",
    "classified unnumbered": "classified-unnumbered", "c": "classified-unnumbered", "c road": "classified-unnumbered", "class c": "classified-unnumbered",
    "cu": "classified-unnumbered", "classified unnumbered road": "classified-unnumbered",
    "unclassified": "unclassified", "u": "unclassified", "unclassified road": "unclassified",
    "not classified": "not-classified",
    "unknown": "unknown",
}


def tag_values(column: Column) -> Column:
    """A tag as an array of texts: a list written as text is a list, a text with semicolons is one too, blank is none."""
    text = F.trim(column)
    listed = F.transform(F.split(F.regexp_replace(text, r"^[\[(]|[\])]$", ""), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")))
    plain = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    out = F.when(text.rlike(r"^[\[(].*[\])]$"), listed).otherwise(plain)
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda x: x != "")


def any_value(column: Column, *wanted: str) -> Column:
    return F.arrays_overlap(tag_values(column), F.array(*[F.lit(w) for w in wanted]))


def is_a_road(ref: Column) -> Column:
    """Whether any reference number is an A road's."""
    return F.exists(tag_values(ref), lambda x: x.rlike(r"^A\d"))


def official_class(column: Column) -> Column:
    """The official class that a publisher's name stands for, whatever its case and whether spaces, hyphens or underscores part its words; unknown for any other."""
    known = F.create_map(*[F.lit(x) for pair in OFFICIAL_CLASSES.items() for x in pair])
    name = F.trim(F.regexp_replace(F.lower(column), r"[\s_-]+", " "))
    return F.coalesce(F.try_element_at(known, name), F.lit("unknown"))


def usable_entrance(entrance: Column, barrier: Column, access: Column) -> Column:
    """An entrance or gate that is neither private nor for emergencies."""
    shut = F.coalesce(access.isin("private", "no", "emergency") | entrance.isin("emergency", "no"), F.lit(False))
    return ~shut & F.coalesce(entrance.isNotNull() | (barrier == "gate"), F.lit(False))


def entrance_rank(entrance: Column) -> Column:
    return F.when(entrance == "main", 0).when(entrance.isin("yes", "secondary"), 1).otherwise(2)


def school_kind(amenity: Column, name: Column, isced: Column) -> Column:
    """special, all-through, primary, secondary or unspecified, by the first sign that there is."""
    levels, text = tag_values(isced), F.lower(F.coalesce(name, F.lit("")))
    has = lambda *x: F.arrays_overlap(levels, F.array(*[F.lit(v) for v in x]))
    low, high = has("0", "1") | text.rlike("primary|infant|junior"), has("2", "3") | text.rlike("secondary|high school|academy")
    return F.when(amenity != "school", None).when(text.contains("special"), "special").when((low & high) | text.contains("all-through"), "all-through").when(low, "primary").when(high, "secondary").otherwise("unspecified")


def ncn_kind(network: Column, route: Column, name: Column, declassified: Column) -> Column:
    """Kind of a cycle route, in order: link, greenway, ncn, reclassified; null for anything else."""
    text = F.lower(F.coalesce(name, F.lit("")))
    cycle = F.coalesce(route == "bicycle", F.lit(False))
    return F.when(cycle & text.contains("link"), "link").when(text.contains("greenway"), "greenway").when(cycle & (network == "ncn"), "ncn").when(F.coalesce(declassified, F.lit(False)), "reclassified")
