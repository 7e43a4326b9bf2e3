"""Names, labels and coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.config import CANONICAL, METHODS

# Acronyms in labels, and the letters of accented ones (the letters without them at the same places).
ACRONYMS = {"mrr": "MRR", "bp": "BP", "mops": "MOPS", "aabb": "AABB", "bcd": "BCD", "utm": "UTM", "wgs": "WGS"}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(s: Column) -> Column:
    return F.translate(s, ACCENTED, PLAIN)


def column_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(s)), "[^a-z0-9]+", "")


def method_id(s: Column) -> Column:
    x = F.replace(F.trim(F.lower(strip_accents(s))), F.lit("_"), F.lit("-"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9-]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def method_label(s: Column) -> Column:
    """Words of the id, acronyms in capitals; the id itself if nothing is left."""
    x = F.regexp_replace(method_id(s), "^spraying-", "")

    def word(w: Column) -> Column:
        out = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))
        for k, v in ACRONYMS.items():
            out = F.when(w == k, v).otherwise(out)
        return out

    label = F.trim(F.array_join(F.transform(F.split(x, "-"), word), " "))
    return F.when(label == "", s).otherwise(label)


def coverage_method(s: Column) -> Column:
    """Canonical coverage method, null for unknown names; null means mrr."""
    table = F.create_map(*[F.lit(v) for pair in CANONICAL.items() for v in pair])
    return F.when(s.isNull(), METHODS[0]).otherwise(F.try_element_at(table, F.replace(F.lower(F.trim(s)), F.lit("_"), F.lit("-"))))


def field_id(s: Column) -> Column:
    """Integer of a number or numeric text; null for other text, fractions and booleans."""
    number = F.trim(s).try_cast("double")
    return F.when((number == F.floor(number)) & ~F.lower(F.trim(s)).isin("true", "false", "nan"), number.cast("bigint"))


def truth(s: Column) -> Column:
    """Boolean of a text: 1, true, yes, y and 0, false, no, n (any case); else whether it is not empty; null is false."""
    x = F.lower(F.trim(s))
    return F.when(x.isin("1", "true", "yes", "y"), True).when(x.isin("0", "false", "no", "n"), False).otherwise(F.coalesce(F.length(s) > 0, F.lit(False)))


def feature_hash(geometry_json: Column) -> Column:
    return F.substring(F.md5(geometry_json), 1, 10)


def html_text(s: Column) -> Column:
    """A text with the five signs that HTML reads written out."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s


def set_signature(values: Column) -> Column:
    """Short hash of a set of texts, 0 for the empty one."""
    return F.when(F.size(values) == 0, "0").otherwise(F.substring(F.md5(F.array_join(F.array_sort(F.array_distinct(values)), "|")), 1, 10))


def fixed(x: Column, places: int) -> Column:
    """A number with so many places, halves to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(x, places))


def polygon_label(field: Column, piece: Column, area: Column) -> Column:
    name = F.concat(F.lit("F"), (field + 1).cast("string"), F.lit(" \u00b7 P"), (piece + 1).cast("string"))
    return F.concat(name, F.lit(" \u2014 "), fixed(area, 0), F.lit(" m\u00b2 ("), fixed(area / 10_000, 4), F.lit(" ha)"))


def snap(value: Column, low: float, high: float, step: float) -> Column:
    """A slider's value: within its bounds, on its steps (from the lower bound)."""
    inside = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.least(F.lit(low) + F.rint((inside - low) / step) * step, F.lit(high))
