"""Synthetic graphs and extraction pairs. Every choice is a hash of the seed and the row, so any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import NOUN, TYPE_OF, TYPES, lookup
from ..functions.text import verbalize
from ..operators.graph import adjacency, with_reverses

SECTORS = ("semiconductors", "software", "fintech", "biotech", "energy", "industrials", "consumer", "telecom")
FORWARD = ("supplier_to", "customer_of", "competitor_of", "partner_of", "acquired", "subsidiary_of", "invested_in")


def draw(seed: int, n: Column | int, *parts: Column | str) -> Column:
    """A number from 0 to n-1 for the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.lit(p) if isinstance(p, str) else p for p in parts]), n if isinstance(n, Column) else F.lit(n))


def _one(values: Sequence[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def graph(spark: SparkSession, companies: int = 120, seed: int = 42, per_company: int = 5) -> DataFrame:
    """A graph of companies, people and sectors with typed reverses.

    Each company has one sector and up to ``per_company`` edges to others; there are 1.2 times as many people, each with one to three
    seats, a quarter of them with a purchase.
    """
    name = lambda i: F.concat(F.lit("company:"), i.cast("string"))
    c = spark.range(companies).withColumnRenamed("id", "c")
    sector = c.select(name(F.col("c")).alias("head"), F.lit("in_sector").alias("relation"), F.concat(F.lit("sector:"), _one(SECTORS, draw(seed, len(SECTORS), F.col("c"), "sector"))).alias("tail"))
    k = c.select("c", F.explode(F.sequence(F.lit(0), F.lit(max(per_company - 1, 0)))).alias("k"))
    k = k.withColumn("t", F.pmod(F.col("c") + 1 + draw(seed, max(companies - 1, 1), F.col("c"), F.col("k"), "tail"), F.lit(companies)))
    typed = k.filter("t != c").select(name(F.col("c")).alias("head"), _one(FORWARD, draw(seed, len(FORWARD), F.col("c"), F.col("k"), "type")).alias("relation"), name(F.col("t")).alias("tail"))
    p = spark.range(int(companies * 1.2)).withColumnRenamed("id", "p")
    person = F.concat(F.lit("person:"), F.col("p").cast("string"))
    seats = p.select("p", F.explode(F.sequence(F.lit(0).cast("long"), draw(seed, 3, F.col("p"), "seats"))).alias("s"))
    seat = seats.select(person.alias("head"), _one(("officer_of", "director_of"), draw(seed, 2, F.col("p"), F.col("s"), "role")).alias("relation"), name(draw(seed, companies, F.col("p"), F.col("s"), "firm")).alias("tail"))
    bought = p.filter(draw(seed, 4, F.col("p"), "insider") == 0).select(person.alias("head"), F.lit("insider_bought").alias("relation"), name(draw(seed, companies, F.col("p"), "bought")).alias("tail"))
    edges = sector.union(typed).union(seat).union(bought).distinct()
    return with_reverses(adjacency(edges.withColumn("pos", F.xxhash64("head", "relation", "tail"))))


def questions(edges: DataFrame, n: int, depth: int = 2, seed: int = 42, most_golds: int = 12) -> DataFrame:
    """Up to ``n`` questions of ``depth`` hops: ``qid, question, topic, path, golds``.

    The ways are those of the graph itself; of each topic one is drawn by hash; kept are those whose golds are 1 to ``most_golds`` and do not
    hold the topic, with distinct questions.
    """
    own = edges.select("head", "relation", "tail").distinct().filter(F.col("relation").isin(*NOUN))
    way = own.select(F.col("head").alias("topic"), F.array("relation").alias("path"), F.col("tail").alias("node"))
    for _ in range(depth - 1):
        way = way.join(own.withColumnRenamed("head", "node"), "node").select("topic", F.concat("path", F.array("relation")).alias("path"), F.col("tail").alias("node"))
    each = way.groupBy("topic", "path").agg(F.array_sort(F.collect_set("node")).alias("golds"))
    fine = each.filter((F.size("golds") <= most_golds) & ~F.array_contains("golds", F.col("topic")))
    h = F.xxhash64(F.lit(seed), "topic", "path")
    one = fine.groupBy("topic").agg(F.min(F.struct(h.alias("h"), "path", "golds")).alias("b")).select("topic", "b.h", "b.path", "b.golds")
    asked = one.withColumn("question", verbalize(F.col("topic"), F.col("path")))
    distinct = asked.withColumn("_r", F.row_number().over(Window.partitionBy("question").orderBy("h"))).filter("_r = 1")
    return distinct.orderBy("h").limit(n).select(F.concat(F.lit("q-"), F.sha2(F.concat_ws("|", "topic", F.concat_ws(",", "path")), 256).substr(1, 12)).alias("qid"), "question", "topic", "path", "golds")


TEMPLATES = {
    "supplier": "We sell components to {t} under a multi-year agreement.",
    "customer": "We rely on {t} for critical materials.",
    "competitor": "We compete directly with {t} in our main markets.",
    "partner": "We entered a strategic alliance with {t}.",
    "acquirer": "We completed the acquisition of {t} during the year.",
    "subsidiary": "We are a wholly owned subsidiary of {t}.",
    "investor": "We hold a minority stake in {t}.",
}
NOISE = ("Our results may vary from quarter to quarter.", "We lease our headquarters.", "The weather affects demand in some regions.")


def pairs(edges: DataFrame, filings: int = 150, seed: int = 42, negatives: int = 3) -> DataFrame:
    """Synthetic pairs: a templated sentence a claim, a quarter of the chunks with two, a noise sentence, ``negatives`` empty chunks a filing."""
    claims = edges.select(F.col("head").alias("filer"), lookup(TYPE_OF, F.col("relation")).alias("rel"), F.col("tail").alias("target")).filter("rel is not null and filer != target")
    claims = claims.withColumn("filing", F.concat(F.lit("filing-"), draw(seed, filings, F.col("filer"), "filing").cast("string"), F.lit("-"), F.col("filer")))
    r = F.row_number().over(Window.partitionBy("filing").orderBy(F.xxhash64(F.lit(seed), "filer", "rel", "target"), "rel", "target"))
    # pairs of neighbours share a chunk where the first one's hash says so
    c = claims.withColumn("r", r).withColumn("pair", F.floor((F.col("r") - 1) / 2))
    joined = draw(seed, 4, F.col("filing"), F.col("pair"), "two") == 0
    c = c.withColumn("chunk", F.concat_ws("-", "filing", F.when(joined, F.concat(F.lit("p"), F.col("pair"))).otherwise(F.concat(F.lit("s"), F.col("r")))))
    said = F.replace(lookup(TEMPLATES, F.col("rel")), F.lit("{t}"), F.regexp_replace("target", "^[^:]*:", ""))
    got = F.array_sort(F.collect_list(F.struct("r", said.alias("s"), F.struct("rel", "target").alias("c"))))
    pos = c.groupBy("filing", "filer", "chunk").agg(got.alias("l"))
    text = F.concat_ws(" ", F.transform("l", lambda x: x["s"]), _one(NOISE, draw(seed, len(NOISE), F.col("chunk"), "noise")))
    none = F.array().cast("array<struct<rel:string,target:string>>")
    cols = [F.lit(1.0).alias("confidence"), F.col("filer").alias("company"), F.lit("Item 1").alias("item_key"), "chunk", none.alias("uncertain")]
    positive = pos.select(text.alias("text"), "filer", F.transform("l", lambda x: x["c"]).alias("triples"), "filing", *cols)
    empty = claims.select("filing", "filer").distinct().select("filing", "filer", F.explode(F.sequence(F.lit(1), F.lit(max(negatives, 1)))).alias("k")).filter(F.col("k") <= negatives)
    empty = empty.withColumn("chunk", F.concat_ws("-", "filing", F.concat(F.lit("n"), F.col("k"))))
    negative = empty.select(_one(NOISE, draw(seed, len(NOISE), F.col("chunk"), "noise")).alias("text"), "filer", none.alias("triples"), "filing", *cols)
    return positive.unionByName(negative)


assert set(TEMPLATES) == set(TYPES)
