"""Content identity: fingerprints, stable ids, canonical order of pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: JSON's short escapes, by code.
_SHORT = {"0008": "b", "0009": "t", "000A": "n", "000C": "f", "000D": "r", "0022": '"', "005C": "\\"}


def canonical_json(**fields: Column) -> Column:
    """Canonical JSON of string and integer columns: keys in order, no spaces, nulls kept.

    Pass strings through ``quoted``; floats are not part of an identity.
    """
    parts = []
    for i, name in enumerate(sorted(fields)):
        value = F.coalesce(fields[name].cast("string"), F.lit("null"))
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def quoted(column: Column) -> Column:
    """A string column as a JSON string in ASCII: quotes, backslashes, control and other characters are escaped; null stays null."""
    units = F.regexp_extract_all(F.hex(F.encode(column, "UTF-16BE")), F.lit("([0-9A-F]{4})"))
    short = F.create_map(*[F.lit(x) for k, v in _SHORT.items() for x in (k, "\\" + v)])
    plain = lambda u: F.char(F.conv(u, 16, 10).cast("long"))
    escaped = F.transform(units, lambda u: F.coalesce(F.try_element_at(short, u), F.when(u.between("0020", "007E"), plain(u)), F.concat(F.lit("\\u"), F.lower(u))))
    text = F.when(column.rlike(r'[^ !#-\[\]-~]'), F.array_join(escaped, "")).otherwise(column)
    return F.concat(F.lit('"'), text, F.lit('"'))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the first 12 digits of the SHA-256 of the parts' texts, joined by two colons; a null part is None."""
    text = F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 12))


def undirected_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def coordinate_key(x: Column, y: Column, digits: int = 3) -> Column:
    return F.concat_ws(":", *(F.format_string(f"%.{digits}f", c.cast("double")) for c in (x, y)))
