"""Coordinates and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees; south and west are negative."""
    value = d + m / 60.0 + s / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def fraction(text: Column) -> Column:
    """A number or a fraction like 385/10; null on a zero denominator."""
    top, low = (F.split_part(text, F.lit("/"), F.lit(i)) for i in (1, 2))
    return F.when(text.contains("/"), F.try_divide(top.try_cast("double"), low.try_cast("double"))).otherwise(text.try_cast("double"))


def in_range(lat: Column, lng: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180)


def degrees_minutes(value: Column, positive: str, negative: str) -> Column:
    """Degrees and minutes to three decimals with a hemisphere; minutes of 60 carry."""
    thousandths = F.round(F.abs(value) * 60000).cast("long")
    whole, rest = F.floor(thousandths / 60000), thousandths % 60000
    return F.concat(
        whole.cast("string"), F.lit("° "), F.floor(rest / 1000).cast("string"), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"),
        F.lit("' "), F.when(value >= 0, positive).otherwise(negative))


def coordinates(lat: Column, lng: Column) -> Column:
    return F.concat(degrees_minutes(lat, "N", "S"), F.lit(" "), degrees_minutes(lng, "E", "W"))


def video_coordinates(text: Column) -> Column:
    """Latitude and longitude of a text like ``+27.5916-151.0823/``."""
    part = lambda i: F.regexp_extract(text, r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", i).try_cast("double")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("lat"), part(2).alias("lng")))


def address(results: Column) -> Column:
    """An address from geocoding results: the street address, else the premise, else the first; distinct long names in order."""
    kind = lambda name: F.filter(results, lambda r: F.array_contains(r["types"], name))
    best = F.get(F.concat(kind("street_address"), kind("premise"), results), F.lit(0))
    return F.array_join(F.array_distinct(F.transform(best["address_components"], lambda c: c["long_name"])), ", ")


def grid_cell(value: Column, zoom: int) -> Column:
    """The index of the map cell of a coordinate; cells are 360 / 2^(zoom + 1) degrees wide."""
    return F.floor(value / (360.0 / 2 ** (zoom + 1)))
