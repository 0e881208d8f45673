"""Address keys: loose texts, expanded directions and suffixes, composite keys, and what looks damaged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import text, trim

# Directions and street suffixes by abbreviation.
DIRECTIONS = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}
SUFFIXES = {
    "ALY": "ALLEY", "AV": "AVENUE", "AVE": "AVENUE", "AVEN": "AVENUE", "BL": "BOULEVARD", "BLVD": "BOULEVARD", "CIR": "CIRCLE", "CT": "COURT", "DR": "DRIVE",
    "DRV": "DRIVE", "HWY": "HIGHWAY", "LN": "LANE", "PL": "PLACE", "PKWY": "PARKWAY", "RD": "ROAD", "SQ": "SQUARE", "ST": "STREET", "TER": "TERRACE", "TRL": "TRAIL", "WAY": "WAY",
}


def _known(values: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), c)


def collapsed(c: Column) -> Column:
    """Runs of white space as one space."""
    return trim(F.regexp_replace(text(c), r"\s+", " "))


def loose(c: Column) -> Column:
    """Upper case, single spaces, no full stops, commas or number signs."""
    return trim(F.regexp_replace(F.regexp_replace(F.upper(text(c)), r"\s+", " "), "[.,#]", ""))


def direction(c: Column) -> Column:
    return _known(DIRECTIONS, loose(c))


def street(c: Column) -> Column:
    """The loose street with its last word's suffix in full."""
    words = F.split(loose(c), " ")
    last = _known(SUFFIXES, F.element_at(words, -1))
    return F.when(F.size(words) < 2, loose(c)).otherwise(F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(last)), " "))


def zip5(c: Column) -> Column:
    found = F.regexp_extract(text(c), r"^(\d{5})(-\d{4})?$", 1)
    return F.when(found == "", loose(c)).otherwise(found)


def composite(house: Column, pre: Column, name: Column, unit: Column, city: Column, state: Column, postal: Column) -> Column:
    """All seven parts with |; empty if all are blank."""
    parts = [loose(house), direction(pre), street(name), loose(unit), loose(city), loose(state), zip5(postal)]
    return F.when(F.concat(*parts) == "", "").otherwise(F.concat_ws("|", *parts))


def situs(house: Column, street: Column, situs_house: Column, situs_street: Column, address: Column) -> Column:
    """struct(key, display, source): from the situs fields, else house and street (both needed), else the address."""
    choices = [("situs", situs_house, situs_street), ("house_street", house, street)]
    shown = F.when(collapsed(address) != "", F.struct(collapsed(address).alias("display"), F.lit("address").alias("source")))
    for source, a, b in reversed(choices):
        both = F.struct(F.concat_ws(" ", collapsed(a), collapsed(b)).alias("display"), F.lit(source).alias("source"))
        shown = F.when((text(a) != "") & (text(b) != ""), both).otherwise(shown)
    return F.when(shown.isNotNull(), F.struct(F.lower(shown["display"]).alias("key"), shown["display"].alias("display"), shown["source"].alias("source")))


def warnings(c: Column) -> Column:
    """What a spreadsheet may have done to a house number or unit: texts that look like dates."""
    t = text(c)
    month = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    return F.array_compact(
        F.array(
            F.when(t.rlike(r"^\d{1,2}/\d{1,2}(/\d{2,4})?$"), "slash date"),
            F.when(F.lower(t).rlike(rf"^{month}[- ]\d{{1,2}}$"), "month and day"),
            F.when(F.lower(t).rlike(rf"^\d{{1,2}}[- ]{month}$"), "day and month"),
            F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), "date"),
        )
    )
