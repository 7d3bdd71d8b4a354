"""Relation labels, their reverses and their names in text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

REVERSE = {
    "supplier_to": "customer_of",
    "customer_of": "supplier_to",
    "competitor_of": "competitor_of",
    "partner_of": "partner_of",
    "acquired": "acquired_by",
    "acquired_by": "acquired",
    "subsidiary_of": "has_subsidiary",
    "has_subsidiary": "subsidiary_of",
    "invested_in": "has_investor",
    "has_investor": "invested_in",
    "in_sector": "sector_contains",
    "sector_contains": "in_sector",
    "officer_of": "has_officer",
    "has_officer": "officer_of",
    "director_of": "has_director",
    "has_director": "director_of",
    "insider_bought": "bought_by_insider",
    "bought_by_insider": "insider_bought",
}
NOUN = {
    "supplier_to": "customers",
    "customer_of": "suppliers",
    "competitor_of": "competitors",
    "partner_of": "partners",
    "acquired": "acquisitions",
    "acquired_by": "acquirers",
    "subsidiary_of": "parent companies",
    "has_subsidiary": "subsidiaries",
    "invested_in": "portfolio companies",
    "has_investor": "investors",
    "in_sector": "sectors",
    "sector_contains": "companies in the sector",
    "officer_of": "companies led by",
    "has_officer": "executives",
    "director_of": "companies with board seats held by",
    "has_director": "board members",
    "insider_bought": "companies with insider purchases by",
    "bought_by_insider": "insider buyers",
}
TYPES = ("supplier", "customer", "competitor", "partner", "acquirer", "subsidiary", "investor")
TYPE_OF = {
    "supplier_to": "supplier",
    "customer_of": "customer",
    "competitor_of": "competitor",
    "partner_of": "partner",
    "acquired": "acquirer",
    "subsidiary_of": "subsidiary",
    "invested_in": "investor",
}
FLIP = {"supplier": "customer", "customer": "supplier", "acquirer": "subsidiary", "subsidiary": "acquirer"}


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a fixed map, null where the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def reverse_map(spark: SparkSession, values: dict[str, str] = REVERSE):
    """A map as a dimension table ``relation, reverse``."""
    return spark.createDataFrame(sorted(values.items()), "relation string, reverse string")
