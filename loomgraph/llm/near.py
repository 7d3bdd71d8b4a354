"""Problem 4: near-duplicate records with small edits. Problem 2: the same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import alike
from .tables import plain_item, plain_split, table

#: fixed by the statement of the problems: three consecutive words, half of the runs in common, 20 words at least
CHUNKS = alike.Likeness(words=3, threshold=0.5, min_words=20)
#: groups of equal texts up to this size are given as all pairs, larger ones as pairs with their smallest key
COPIES = 64


def _expand(links: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Pairs ``key_a, key_b`` of record keys for links of classes.

    Members of a class with more than ``COPIES`` records are given by pairs with the class's smallest key, and its links
    to other classes by that key alone; all others in full. No link between different texts is lost.
    """
    size = members.groupBy("c").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    m = cut(members.join(size, "c").withColumn("shown", (F.col("n") <= COPIES) | (F.col("key") == F.col("least"))))
    left = m.filter("shown").select(F.col("c").alias("ca"), F.col("key").alias("a"), *[F.col(x).alias(f"{x}_a") for x in on])
    right = m.select(F.col("c").alias("cb"), F.col("key").alias("b"), "shown", *[F.col(x).alias(f"{x}_b") for x in on])
    both = links.join(left, "ca").join(right, "cb").filter("(shown or ca = cb) and a != b")
    return both.withColumns({"key_a": F.least("a", "b"), "key_b": F.greatest("a", "b")})


def similar_texts(df: DataFrame, key: str, text: str, like: alike.Likeness = CHUNKS) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: verified links between classes of equal texts, and the class ``c`` of each distinct ``key``.

    Rows with a null key or text take no part; repeated rows count once; other columns are not looked at.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null").withColumn("c", F.xxhash64("text"))
    members = cut(rows.select("c", "key").distinct())
    texts = rows.select("c", F.lit(0).alias("side"), F.lit(0).cast("long").alias("salt"), "text")
    copies = members.groupBy("c").count().filter("count > 1").select("c")
    return alike.links(texts, copies, like), members


def near_pairs(df: DataFrame, key: str, text: str, like: alike.Likeness = CHUNKS) -> DataFrame:
    """Distinct pairs ``key_a < key_b`` of keys whose texts are alike."""
    found, members = similar_texts(df, key, text, like)
    return _expand(found, members, []).select("key_a", "key_b").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs(table(spark, sf_dir, "company_relationships"), "chunk_id", "chunk_text")
    return pairs.select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def cross_split_links(records: DataFrame, like: alike.Likeness = CHUNKS) -> tuple[DataFrame, DataFrame]:
    """Evaluation records that also stand in training: ``(links, members)``.

    ``records``: ``record_table``, ``key``, ``split`` (plain), ``text``. The word n-gram hashes of the evaluation texts, in groups
    of neighbours, are partitioned, and the training texts' groups are looked up among them (the lists of ``alike``, of which only
    pairs of an evaluation and a training text are looked at); for each hit that the sketches do not rule out, the containment
    of the evaluation text in the training text and their similarity are computed exactly. Null keys, splits and texts take no part.
    """
    rows = records.filter("key is not null and text is not null and split in ('train', 'dev', 'test')").withColumns(
        {"salt": F.xxhash64("record_table"), "side": F.when(F.col("split") == "train", 1).otherwise(0), "c": F.xxhash64("record_table", "text")}
    )
    members = cut(rows.select("record_table", "c", "key", "split").distinct())
    both = members.groupBy("c").agg(F.count_distinct(F.col("split") == "train").alias("sides")).filter("sides = 2").select("c")
    return alike.links(rows.select("c", "side", "salt", "text"), both, like, cross=True), members


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, text: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.lit(name).alias("record_table"), F.col(key).alias("key"), plain_split(F.col("split")).alias("split"), F.col(text).alias("text"))

    return of("company_relationships", "chunk_id", "chunk_text").unionByName(of("judge_examples", "example_id", "text"))


def _side(members: DataFrame, train: bool) -> DataFrame:
    """Members of one side with ``n``, the records of their class on that side, and ``least``, the class's smallest key there."""
    m = members.filter("split = 'train'" if train else "split != 'train'")
    return m.join(m.groupBy("c").agg(F.count_distinct("key").alias("n"), F.min("key").alias("least")), "c")


def cross_split_pairs(records: DataFrame, like: alike.Likeness = CHUNKS) -> DataFrame:
    """``record_table, eval_key, train_key``: pairs of an evaluation and a training record whose texts are alike.

    A class of equal texts with more than ``COPIES`` records on a side stands in its links to other classes by its smallest key of that
    side; each of its records is paired with one record of the other side, the smallest key that the class is linked with.
    So every record that overlaps comes out, and every link between different texts.
    """
    found, members = cross_split_links(records, like)
    found = found.select("ca", "cb")
    e, t = cut(_side(members, False)), cut(_side(members, True))
    shown = f"n <= {COPIES} or key = least"
    left = e.filter(shown).select("record_table", F.col("c").alias("ca"), F.col("key").alias("eval_key"))
    right = t.filter(shown).select(F.col("c").alias("cb"), F.col("key").alias("train_key"))
    small = found.join(left, "ca").join(right, "cb").select("record_table", "eval_key", "train_key")
    least_e, least_t = (m.filter("key = least").select(F.col("c").alias(c), F.col("key").alias(k)).distinct() for m, c, k in ((e, "ca", "eval_key"), (t, "cb", "train_key")))
    one_t = found.join(least_t, "cb").groupBy("ca").agg(F.min("train_key").alias("train_key"))
    one_e = found.join(least_e, "ca").groupBy("cb").agg(F.min("eval_key").alias("eval_key"))
    many_e = e.filter(f"n > {COPIES}").join(one_t, F.col("c") == F.col("ca")).select("record_table", F.col("key").alias("eval_key"), "train_key")
    many_t = t.filter(f"n > {COPIES}").join(one_e, F.col("c") == F.col("cb")).select("record_table", "eval_key", F.col("key").alias("train_key"))
    return small.unionByName(many_e).unionByName(many_t).filter("eval_key != train_key").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cross_split_pairs(_records(spark, sf_dir))
    return x.select("record_table", F.least("eval_key", "train_key").alias("key_a"), F.greatest("eval_key", "train_key").alias("key_b")).distinct()


def overlaps(records: DataFrame, like: alike.Likeness = CHUNKS) -> DataFrame:
    """``record_table, split, key, train_records, containment`` of each evaluation record that also stands in training.

    Counted over the classes of equal texts, whatever their sizes. A record counts once for each different text it has; its own
    key does not count.
    """
    found, members = cross_split_links(records, like)
    e, t = members.filter("split != 'train'"), members.filter("split = 'train'")
    size = t.groupBy(F.col("c").alias("cb")).agg(F.count("*").alias("n"))
    of = found.join(size, "cb").groupBy("ca").agg(F.sum("n").alias("n"), F.max("containment").alias("containment"))
    both = e.select("record_table", "key", "split", F.col("c").alias("ca")).join(t.select("record_table", "key", F.col("c").alias("cb")), ["record_table", "key"])
    own = both.join(found.select("ca", "cb"), ["ca", "cb"]).groupBy("record_table", "key", "split", F.col("ca").alias("c")).agg(F.count("*").alias("own"))
    each = e.join(of, F.col("c") == F.col("ca")).join(own, ["record_table", "key", "split", "c"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).filter("n > 0")
    return each.groupBy("record_table", "split", "key").agg(F.sum("n").alias("train_records"), F.max("containment").alias("containment"))


def p2_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records that overlap with training, per table, split and item or filing."""
    x = overlaps(_records(spark, sf_dir))
    cr, je = table(spark, sf_dir, "company_relationships"), table(spark, sf_dir, "judge_examples")
    source = (
        cr.groupBy(F.col("chunk_id").alias("key")).agg(F.min(plain_item(F.col("item_key"))).alias("source")).withColumn("record_table", F.lit("company_relationships"))
    ).unionByName(je.groupBy(F.col("example_id").alias("key")).agg(F.min("filing").alias("source")).withColumn("record_table", F.lit("judge_examples")))
    out = x.join(source, ["record_table", "key"], "left").groupBy("record_table", "split", "source")
    return out.agg(F.count("*").alias("records"), F.sum("train_records").alias("train_records"), F.round(F.avg("containment"), 6).alias("mean_containment"))
