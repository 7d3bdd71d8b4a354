"""Problem 3: splits that keep related records together.

Minimum-label propagation over the bipartite graph of filings and companies, with pointer jumping, so that the rounds
grow with the logarithm of the longest chain; each round ends in a checkpoint. Filings of one company tie nothing and are left
out of the rounds. Each component, each filing without a known company and each row without either is a group.

Groups are assigned to splits by label counts: the groups that hold more than 1/``LARGE`` of all rows, at most ``LARGE`` of
them, one by one, largest first, to the split whose label counts are farthest below the target; all others, each a
tiny part of the rows, by a hash of the group within the group's most frequent label, in the shares that are still missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .tables import plain_company, plain_filing, plain_label, plain_split, table

LARGE = 20_000
LABELS = 64
#: unless all pairs are asked for, groups up to this many members are given as all pairs, larger ones as pairs with their least member
PAIRS = 10_000
#: members of a component that one task pairs with all others
PART = 200


def components(edges: DataFrame) -> DataFrame:
    """``entity, label``: for each entity of ``edges`` (``record``, ``entity``) the least entity it is connected with.

    Null records and entities connect nothing; repeated edges count once.
    """
    e = edges.select("record", "entity").filter("record is not null and entity is not null").distinct()
    e = cut(e)
    several = e.groupBy("record").agg(F.min("entity").alias("least"), F.max("entity").alias("most")).filter("least != most").select("record")
    tied = cut(e.join(several, "record", "left_semi"))
    label = cut(tied.select("entity").distinct().withColumn("label", F.col("entity")))
    while True:
        of_record = tied.join(label, "entity").groupBy("record").agg(F.min("label").alias("label"))
        of_entity = tied.join(of_record, "record").groupBy("entity").agg(F.min("label").alias("next"))
        nearer = label.join(of_entity, "entity")
        jump = nearer.select(F.col("entity").alias("next"), F.col("next").alias("beyond"))
        nearer = cut(nearer.join(jump, "next", "left").select("entity", F.coalesce("beyond", "next").alias("next"), "label"))
        changed = nearer.filter("next != label").limit(1).count()
        label = nearer.select("entity", F.col("next").alias("label"))
        if not changed:
            break
    alone = e.select("entity").distinct().join(label, "entity", "left_anti")
    return cut(label.unionByName(alone.withColumn("label", F.col("entity"))))


def member_pairs(members: DataFrame, group: str, member: str, a: str, b: str, whole: bool = False) -> DataFrame:
    """Pairs ``a < b`` of the members of each group of up to ``PAIRS``, or of every group if ``whole``; the members of other groups each with the group's least.

    A group's members are dealt to parts, and every part is joined with the whole group, so no task pairs more than ``PART`` members with it.
    """
    size = members.groupBy(group).agg(F.count("*").alias("_n"), F.min(member).alias("_least")).filter("_n > 1")
    every = F.lit(True) if whole else F.col("_n") <= PAIRS
    m = cut(members.select(group, member).join(size, group).withColumn("_parts", F.when(every, F.ceil(F.col("_n") / PART)).otherwise(1).cast("int")))
    left = m.filter(every | (F.col(member) == F.col("_least"))).select(group, F.col(member).alias(a), F.pmod(F.xxhash64(member), F.col("_parts")).cast("int").alias("_part"))
    right = m.select(group, F.col(member).alias(b), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, [group, "_part"]).filter(F.col(a) < F.col(b)).select(a, b)


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "company_relationships")
    return t.select(plain_filing(F.col("accession_number")).alias("record"), plain_company(F.col("company_id")).alias("entity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_pairs(components(_ties(spark, sf_dir)), "label", "entity", "company_a", "company_b", whole=True)


def _gain(have: np.ndarray, want: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Change of the squared deviation from the wanted label counts, for each split the group may go to."""
    scale = np.maximum(want.sum(0), 1)
    return (((have + add - want) ** 2 - (have - want) ** 2) / scale).sum(1) + ((have.sum(1) + add.sum() - want.sum(1)) ** 2 - (have.sum(1) - want.sum(1)) ** 2) / max(1.0, want.sum())


def assign(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``grp, split``: a split for each group of ``groups`` (``grp``, ``label``, ``n``: rows of a label in a group).

    Labels beyond the ``LABELS`` most frequent count as one. A null label counts as a label. Shares are taken relative to their sum.
    """
    spark = groups.sparkSession
    names = sorted(k for k, v in shares.items() if v and v > 0)
    part = np.array([shares[k] for k in names]) / sum(shares[k] for k in names)
    g = groups.withColumn("label", F.coalesce("label", F.lit("")))
    totals = g.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()
    index = {r[0]: i for i, r in enumerate(totals)}
    everything = g.agg(F.sum("n")).first()[0] or 0
    want = np.zeros((len(names), LABELS + 1))
    want[:, : len(totals)] = part[:, None] * np.array([float(r[1]) for r in totals]).reshape(1, -1)
    want[:, LABELS] = part * (everything - sum(r[1] for r in totals))
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, i in index.items() for x in (k, i)]), F.col("label")), F.lit(LABELS)) if index else F.lit(LABELS)
    coded = g.groupBy("grp", number.alias("code")).agg(F.sum("n").alias("n"))
    total = coded.groupBy("grp").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("code").alias("code"))).alias("top")).select("grp", "all", F.col("top.code").alias("main"))
    total = cut(total)
    large = total.filter(F.col("all") > everything / LARGE)
    have = np.zeros_like(want)
    chosen: list[tuple[str, str]] = []
    vectors: dict[str, np.ndarray] = {}
    for grp, code, n in coded.join(large.select("grp"), "grp", "left_semi").collect():
        vectors.setdefault(grp, np.zeros(LABELS + 1))[code] += n
    for grp, v in sorted(vectors.items(), key=lambda x: (-x[1].sum(), x[0])):
        s = int(np.argmin(_gain(have, want, v)))
        have[s] += v
        chosen.append((grp, names[s]))
    missing = np.maximum(want - have, 0)
    missing[:, missing.sum(0) == 0] = part[:, None]
    bound = np.cumsum(missing / missing.sum(0), axis=0)
    place = F.pmod(F.xxhash64(F.lit("split"), "grp"), F.lit(1 << 30)) / float(1 << 30)
    table_ = F.array(*[F.array(*[F.lit(float(x)) for x in bound[:, i]]) for i in range(LABELS + 1)])
    at = F.element_at(table_, F.col("main") + 1)
    split = F.element_at(F.array(*[F.lit(x) for x in names]), F.least(F.size(F.filter(at, lambda x: x <= place)) + 1, F.lit(len(names))))
    small = total.filter(F.col("all") <= everything / LARGE).select("grp", split.alias("split"))
    return cut(spark.createDataFrame(chosen, "grp string, split string").unionByName(small))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_table, record_key, label, grp`` of every row, repeated deliveries of a row once."""
    ties = _ties(spark, sf_dir)
    of_company = components(ties)
    of_filing = cut(ties.filter("record is not null and entity is not null").distinct().join(of_company, "entity").groupBy("record").agg(F.min("label").alias("by_filing")))
    cr = table(spark, sf_dir, "company_relationships").select(
        F.lit("company_relationships").alias("record_table"), F.col("row_id").cast("string").alias("record_key"), plain_label(F.col("relationship_type")).alias("label"),
        plain_filing(F.col("accession_number")).alias("record"), plain_company(F.col("company_id")).alias("entity"),
    )
    je = table(spark, sf_dir, "judge_examples").select(
        F.lit("judge_examples").alias("record_table"), F.col("example_id").alias("record_key"), F.regexp_replace(plain_label(F.col("verdict")), "ed$", "").alias("label"),
        plain_filing(F.col("filing")).alias("record"), F.lit(None).cast("string").alias("entity"),
    )
    rows = cr.unionByName(je).filter("record_key is not null")
    rows = rows.join(of_company, rows.entity == of_company.entity, "left").select(rows["*"], of_company.label.alias("by_company")).join(of_filing, "record", "left")
    grp = F.coalesce(F.concat(F.lit("c "), F.coalesce("by_company", "by_filing")), F.concat(F.lit("f "), "record"))
    each = rows.withColumn("grp", grp).groupBy("record_table", "record_key").agg(F.min("label").alias("label"), F.min("grp").alias("grp"))
    return cut(each.withColumn("grp", F.coalesce("grp", F.concat(F.lit("r "), "record_table", F.lit(" "), "record_key"))))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir)
    shares = {r[0]: r[1] for r in table(spark, sf_dir, "split_targets").select(plain_split(F.col("split")), "target_share").collect()}
    return rows.join(assign(rows.groupBy("grp", "label").agg(F.count("*").alias("n")), shares), "grp")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record, all of which gets one split."""
    return _grouped(spark, sf_dir).select("record_table", "record_key", "grp")


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every record."""
    return _assigned(spark, sf_dir).select("record_table", "record_key", "grp", "split")


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each label in each new split."""
    return _assigned(spark, sf_dir).groupBy("record_table", "label", "split").agg(F.count("*").alias("records"))
