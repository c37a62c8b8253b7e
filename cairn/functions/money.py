"""Column functions on money: exact decimals, landed cost, order shipping and report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
FACTOR = "decimal(12,5)"
#: Cost in the base currency where no rule and no country is known.
ASSUMED_DEFAULT = 120


def money(value: Column) -> Column:
    return value.cast(MONEY)


def convert(amount: Column, factor: Column) -> Column:
    """Amount in the base currency: rounded half up to cents; null without a positive factor."""
    return F.when(factor > 0, money(amount * factor))


def landed(amount: Column, shipping: Column) -> Column:
    return money(amount + F.coalesce(shipping, F.lit(0)))


def offer_shipping(amount: Column, factor: Column, verified: Column, ship: Column, free_over: Column, assumed: Column) -> Column:
    """A verified rule counts in the shop's currency, free from its threshold on; else the assumption for the country, else the default."""
    rule = F.when(free_over.isNotNull() & (amount >= free_over), money(F.lit(0))).otherwise(convert(ship, factor))
    return F.when(F.coalesce(verified, F.lit(False)) & ship.isNotNull(), rule).otherwise(money(F.coalesce(assumed, F.lit(ASSUMED_DEFAULT))))


def order_shipping(subtotal: Column, ship: Column, free_over: Column) -> Column:
    """One fee an order, none from the threshold on; an unknown fee is none."""
    return F.when(free_over.isNotNull() & (subtotal >= free_over), money(F.lit(0))).otherwise(money(F.coalesce(ship, F.lit(0))))


def to_free_shipping(subtotal: Column, ship: Column, free_over: Column) -> Column:
    """What an order lacks to free shipping; null where there is nothing to gain."""
    return F.when((ship > 0) & (subtotal < free_over), free_over - subtotal)


def median(value: Column, condition: Column) -> Column:
    """Exact median of the values that meet the condition, rounded half up to cents."""
    exact = F.percentile(F.when(condition, value).cast("double"), F.lit(0.5))
    return F.round(exact.cast("decimal(18,3)"), 2)


def whole(amount: Column) -> Column:
    """1.299 kr"""
    return F.concat(F.translate(F.format_number(F.round(amount), 0), ",", "."), F.lit(" kr"))


def exact(amount: Column, currency: Column) -> Column:
    """1.299,50 EUR"""
    return F.concat(F.translate(F.format_number(amount.cast("double"), 2), ",.", ".,"), F.lit(" "), currency)


#: Month names of the long date.
MONTHS = ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december")


def long_date(day: Column) -> Column:
    """24. september 2026"""
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.lit(" "), F.year(day).cast("string"))


def shipping_rule_text(verified: Column, ship: Column, free_over: Column, currency: Column, assumed: Column) -> Column:
    rule = F.concat(exact(ship, currency), F.lit(" til Danmark"), F.when(free_over.isNotNull(), F.concat(F.lit(", fri fragt over "), exact(free_over, currency))).otherwise(F.lit("")))
    guess = F.when(assumed.isNull(), F.lit("Oplyses ikke")).otherwise(F.concat(F.lit("Oplyses ikke. Antaget "), whole(assumed)))
    return F.when(F.coalesce(verified, F.lit(False)) & ship.isNotNull(), rule).otherwise(guess)


def countries_text(countries: Column) -> Column:
    """a, b og c of an array."""
    n = F.size(countries)
    head = F.array_join(F.slice(countries, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(countries, F.lit(0))).otherwise(F.concat(head, F.lit(" og "), F.get(countries, n - 1)))
