"""Reading the tables and the plain forms of their dirty columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_label(c: Column) -> Column:
    """Lower case without outer blanks of any kind."""
    return F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def plain_split(c: Column) -> Column:
    s = plain_label(c)
    return F.when(s == "validation", F.lit("dev")).otherwise(s)


def plain_item(c: Column) -> Column:
    """``Item`` and the number with its letter, null where the text names no item."""
    s = F.regexp_replace(F.lower(c), r"[\s\u00a0_]+", " ")
    found = F.regexp_extract(s, r"^ ?(?:part ?[ivx]+[ ,.:-]*)?(?:item)?[ .:#-]*(\d{1,2})\.?([a-z]?)(?![a-z0-9])", 0)
    number = F.regexp_extract(found, r"(\d{1,2})\.?([a-z]?)$", 1)
    letter = F.regexp_extract(found, r"(\d{1,2})\.?([a-z]?)$", 2)
    return F.when(number != "", F.concat(F.lit("Item "), F.regexp_replace(number, "^0", ""), F.upper(letter)))


def plain_filing(c: Column) -> Column:
    """The 18 digits of an accession number; null for anything else and for zeros only."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when((F.length(d) == 18) & (d != "0" * 18), d)


def plain_company(c: Column) -> Column:
    """Lower case without outer blanks; null where unknown."""
    s = plain_label(c)
    return F.when((s != "co-0000000") & (s != ""), s)
