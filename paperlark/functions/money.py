"""Money as whole cents (long), and how amounts and quantities are read and written. All of it Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_BREAK = " "
#: Fixed value: what counts as an amount with two decimals.
AMOUNT = r"^(-)?\s*(\d{1,7})[,.](\d{2})$"


def parse_money(text: Column) -> Column:
    """Cents of an amount such as '-1 234,50'; null where it is none. Spaces within are dropped."""
    t = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    cents = F.try_to_number(F.concat(F.regexp_extract(t, AMOUNT, 2), F.regexp_extract(t, AMOUNT, 3)), F.lit("999999999")).cast("long")
    return F.when(t.rlike(AMOUNT), F.when(F.startswith(t, F.lit("-")), -cents).otherwise(cents))


def format_money(cents: Column, currency: bool = True) -> Column:
    """Cents with a decimal comma and no-break spaces between thousands, ' Kč' after them if currency."""
    size = F.abs(cents)
    whole = F.replace(F.format_number(F.expr("0") + F.floor(size / F.lit(100)), 0), F.lit(","), F.lit(NO_BREAK))
    out = F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.concat(out, F.lit(" Kč")) if currency else out


def parse_user_price(text: Column) -> Column:
    """Cents of what a person types: '89', '89.9', '89,90 Kč'. Further decimals are cut off; null where it is no number."""
    t = F.replace(F.replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), F.lit("Kč"), F.lit("")), F.lit("."), F.lit(","))
    parts = F.split(t, ",")
    whole = F.when(parts[0] == "", "0").otherwise(parts[0]).try_cast("long")
    frac = F.when(F.size(parts) > 1, F.substring(F.rpad(F.get(parts, F.lit(1)), F.greatest(F.lit(2), F.length(F.get(parts, F.lit(1)))), "0"), 1, 2).try_cast("long")).otherwise(F.lit(0))
    sign = F.when((whole < 0) | F.startswith(t, F.lit("-")), -1).otherwise(1)
    return F.when(t != "", sign * (F.abs(whole) * 100 + frac))


def format_quantity(quantity: Column, unit: Column) -> Column:
    """'0,678 kg' for kilograms, '2 ks' for whole numbers, else the number and its unit."""
    return (
        F.when(unit == "kg", F.replace(F.format_string("%.3f kg", quantity), F.lit("."), F.lit(",")))
        .when(quantity == F.floor(quantity), F.concat(quantity.cast("long").cast("string"), F.lit(" ks")))
        .otherwise(F.concat(quantity.cast("string"), F.lit(" "), unit))
    )


def unit_price(given: Column, final: Column, quantity: Column) -> Column:
    """The price of one unit: the given one, else the final price by quantity, halves up; the final price without a quantity."""
    return F.coalesce(given, F.when(quantity > 0, F.floor(final / quantity + F.lit(0.5)).cast("long")).otherwise(final))


def per_unit(final: Column, quantity: Column) -> Column:
    """The final price by quantity with the fraction cut off."""
    return F.when(quantity > 0, (final / quantity).cast("long")).otherwise(final)
