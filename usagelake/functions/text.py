"""Numbers as people read them, as column expressions: thousands apart, and units by size, in English or French."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of thousands and of decimals; units and the least value that takes them.
SEPARATORS = {"en": (",", "."), "fr": ("\u202f", ",")}
TOKENS = ((1e9, "Md", 2), (1e6, "M", 1), (1e3, "k", 1))
GRAMS = ((1e6, "t", 2), (1e3, "kg", 1), (1.0, "g", 1))
WATT_HOURS = ((1e6, "MWh", 2), (1e3, "kWh", 2), (1.0, "Wh", 0))
LITRES = ((1e3, "m\u00b3", 1), (1.0, "L", 1), (1e-3, "mL", 0))
UNKNOWN = "\u2014"
# End of fixed values.


def number(value: Column, digits: int = 0, tongue: str = "en") -> Column:
    """A number with so many decimals, its thousands set apart."""
    thousands, point = SEPARATORS[tongue]
    plain = F.format_string(f"%.{digits}f", F.abs(value.cast("double")))
    whole = F.regexp_replace(F.split(plain, r"\.")[0], r"(?<=\d)(?=(\d{3})+$)", thousands)
    rest = F.concat(F.lit(point), F.split(plain, r"\.")[1]) if digits else F.lit("")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, rest)


def scaled(value: Column, units, tongue: str = "en", least: bool = True) -> Column:
    """A number in the largest unit that it reaches; the smallest unit for what reaches none, or none at all."""
    out = None
    for size, unit, digits in units:
        text = F.concat(number(value / size, digits, tongue), F.lit(f" {unit}"))
        out = F.when(value >= size, text) if out is None else out.when(value >= size, text)
    return out.otherwise(text if least else number(value, 0, tongue))


def tokens(value: Column, tongue: str = "en") -> Column:
    return scaled(value, TOKENS, tongue, least=False)


def grams(value: Column, tongue: str = "en") -> Column:
    return scaled(value, GRAMS, tongue)


def energy(value: Column, tongue: str = "en") -> Column:
    return scaled(value, WATT_HOURS, tongue)


def water(value: Column, tongue: str = "en") -> Column:
    return scaled(value, LITRES, tongue)


def dollars(value: Column, tongue: str = "en") -> Column:
    """An unknown cost is a dash, never 0; from a thousand on without cents."""
    return F.when(value.isNull(), UNKNOWN).otherwise(F.concat(F.lit("$"), F.when(value >= 1000, number(value, 0, tongue)).otherwise(number(value, 2, tongue))))


def until(ms: Column) -> Column:
    """A time to come: days and hours, hours and minutes, or minutes; null if it is past or not known."""
    minutes = F.floor(ms / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f" {x} "), F.format_string("%02d", b), F.lit(f" {y}"))
    return F.when(ms > 0, F.when(days >= 1, two(days, "d", hours % 24, "h")).when(hours >= 1, two(hours, "h", minutes % 60, "min")).otherwise(F.concat(minutes.cast("string"), F.lit(" min"))))
