import pytest
from pyspark.sql import functions as F

from loomgraph.functions import metrics
from loomgraph.operators import construct
from loomgraph.schemas import EXPORT

ROWS = [
    ("quote", "Acme", "supplier", "A", 0.9, "f1", "ch-1", "text one", "Item 1", "co1", 0),
    ("quote", "Acme", "competitor", "B", 0.8, "f1", "ch-1", "text one", "Item 1", "co1", 1),
    (None, "Acme", None, None, None, "f1", "ch-2", "text two", "Item 1", "co1", 2),
    ("quote", "Acme", "partner", "C", 0.2, "f1", "ch-1", "text one", "Item 1", "co1", 3),
    ("quote", "Acme", "supplier", "A", 0.1, "f1", "ch-1", "text one", "Item 1", "co1", 4),
]


def export(spark, rows):
    return spark.createDataFrame(rows, EXPORT + ", ordinal long")


def test_grouping_floor_and_negatives(spark):
    got = {r.chunk: r for r in construct.group_export(export(spark, ROWS)).collect()}
    one = got["ch-1"]
    assert [(t.rel, t.target) for t in one.triples] == [("supplier", "A"), ("competitor", "B")] and one.confidence == 0.8
    assert [(t.rel, t.target) for t in one.uncertain] == [("partner", "C")]
    assert got["ch-2"].triples == [] and got["ch-2"].confidence is None
    assert construct.group_export(export(spark, ROWS).limit(0)).count() == 0


def test_grouping_rejects_what_is_wrong(spark):
    wrong = [(*ROWS[0][:2], "holds", *ROWS[0][3:])]
    with pytest.raises(Exception, match="taxonomy"):
        construct.group_export(export(spark, wrong)).collect()
    assert construct.group_export(export(spark, wrong), strict=False).first().triples == []
    two = [ROWS[0], (ROWS[1][0], "Other", *ROWS[1][2:])]
    with pytest.raises(Exception, match="two filers"):
        construct.group_export(export(spark, two)).collect()


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(400).select((F.col("id") % 40).cast("string").alias("filing"), F.lit(None).cast("string").alias("company"))
    s = construct.split_pairs(df, "auto")
    per = s.groupBy("filing").agg(F.count_distinct("split").alias("n"))
    assert per.filter("n > 1").count() == 0
    assert {r.split: r["count"] for r in s.select("filing", "split").distinct().groupBy("split").count().collect()} == {"train": 32, "dev": 4, "test": 4}
    assert sorted(map(tuple, s.distinct().collect())) == sorted(map(tuple, construct.split_pairs(df.repartition(3), "filing").distinct().collect()))
    with pytest.raises(ValueError):
        construct.split_pairs(df, "pair")
    d = construct.dev_split(spark.range(10).select(F.lit("only").alias("filer"), F.col("id").alias("ordinal")), dev=0.3)
    assert d.filter("split = 'dev'").count() == 3


def test_judge_rows(spark):
    rows = [
        ("q", "text", "Acme", "supplier", "B", 0.4, "accept", "f", 0),
        ("q", "", "Acme", "supplier", "C", None, "accept", "f", 1),
        ("q", None, "Acme", "customer", "C", None, "reject", "f", 2),
        ("q", "t", "Acme", "supplier", None, 0.4, "accept", "f", 3),
        ("q", "t", "Acme", "holds", "B", 0.4, "accept", "f", 4),
    ]
    df = spark.createDataFrame(rows, "evidence_text string, chunk_text string, filer string, relationship_type string, target string, faithfulness double, verdict string, accession_number string, ordinal long")
    kept, skipped = construct.judge_rows(df)
    got = kept.orderBy("ordinal").collect()
    assert [r.text for r in got] == ["text", "q", "q"] and [r.faithfulness for r in got] == [0.4, 1.0, 0.0]
    assert skipped.first().skipped == 2


def test_direction_negatives(spark):
    s = "ordinal long, text string, filer string, relation string, target string, verdict string, faithfulness double, filing string"
    rows = [
        (0, "t", "Acme", "supplier", "BoltCo", "accept", 0.9, "f"),
        (1, "t", "Acme", "supplier", "BoltCo ", "accept", 0.9, "f"),
        (2, "u", "Acme", "partner", "X", "accept", 0.9, "f"),
        (3, "u", "Acme", "acquirer", "Y", "accept", 0.3, "f"),
        (4, "v", "Acme", "supplier", "Z", "accept", 0.9, "f"),
        (5, "w", " acme", "customer", "z", "accept", 0.9, "f"),
    ]
    got = construct.direction_negatives(spark.createDataFrame(rows, s)).collect()
    assert [(r.filer, r.relation, r.target, r.verdict, r.faithfulness) for r in got] == [("Acme", "customer", "BoltCo", "reject", 0.0)]


def test_verdicts_and_empty_class(spark):
    df = spark.createDataFrame([(0.9, "accept"), (0.2, "accept"), (0.5, "accept")], "p double, v string")
    r = construct.verdict_agreement(df, "p", "v").first()
    assert r.accept == pytest.approx(2 / 3) and r.reject == 1.0


S = "key long, filing string, route string, triples array<struct<rel:string,target:string>>, gold array<struct<rel:string,target:string>>, uncertain array<struct<rel:string,target:string>>, gen_tokens int"
A, B, X = ({"rel": "r", "target": t} for t in "abx")


def test_rewards(spark):
    rows = [(0, "f", "extract", [A, X], [A], [], 30), (1, "f", "escalate", [], [B], [], 0), (2, "f", "skip", [], [X], [], 0)]
    parts = construct.chunk_parts(spark.createDataFrame(rows, S), ["key", "filing"])
    r = construct.filing_rewards(parts, lam=0.0, escalation=1000.0).first()
    assert (r.precision, r.recall, r.cost_tokens) == (0.5, pytest.approx(2 / 3), 1030.0) and r.reward == pytest.approx(4 / 7)
    c = {x.key: x for x in construct.chunk_rewards(parts, ["key"], lam=0.4).collect()}
    assert c[1].reward == pytest.approx(0.6) and c[2].reward == 0.0
    judged = construct.chunk_parts(spark.createDataFrame(rows, S), ["key", "filing"], judge=F.when(F.col("in_gold"), 0.8).otherwise(0.1))
    j = construct.filing_rewards(judged, lam=0.0).first()
    assert j.precision == pytest.approx(0.45) and j.accepted == 1
    masked = [(0, "f", "extract", [A, A, X], [A], [X], 0)]
    m = construct.chunk_parts(spark.createDataFrame(masked, S), ["key", "filing"]).first()
    assert (m.emitted, m.accepted) == (2, 2)
    with pytest.raises(Exception, match="route"):
        construct.chunk_parts(spark.createDataFrame([(0, "f", "other", [], [], [], 0)], S), ["key"]).collect()


def test_advantages_and_metrics(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, reward double")
    assert sorted(r.advantage for r in construct.advantages(df, ["g"]).collect()) == [-1.0, 0.0, 1.0]
    two = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), ([], ["a"]), (None, None)], "p array<string>, g array<string>")
    got = two.select(metrics.hit(F.col("p"), F.col("g")), metrics.hits_at_1(F.col("p"), F.col("g")), metrics.answer_precision(F.col("p"), F.col("g")), metrics.answer_recall(F.col("p"), F.col("g")), metrics.answer_f1(F.col("p"), F.col("g"))).collect()
    assert tuple(got[0]) == (1.0, 0.0, 0.5, 0.5, 0.5) and tuple(got[1]) == (0, 0, 0, 0, 1) and tuple(got[2]) == (0, 0, 0, 0, 0) and got[3][4] == 1
    v = spark.range(1).select(metrics.log_sum_exp(F.array(F.lit(0.0), F.lit(0.0))).alias("l"), metrics.decode_confidence(F.lit(-2.0), F.lit(0)).alias("c"), metrics.clipped_surrogate(F.lit(2.0), F.lit(1.0)).alias("s")).first()
    assert v.l == pytest.approx(0.693147, abs=1e-6) and v.c == 1.0 and v.s == pytest.approx(1.28)
    with pytest.raises(ValueError):
        metrics.quality(F.lit(1.0), F.lit(1.0), "other")


def test_hard_chunks_equal_a_plain_version(spark):
    from loomgraph.functions.text import SUFFIXES

    p = lambda *t: [{"rel": "r", "target": x} for x in t]
    rows = [
        ("k1", "We sell to Intel Corporation.", "Acme", p("Intel Corp")),
        ("k2", "We sell to Intel Corporation.", "Acme", p("Broadcom")),
        ("k3", "We sell to A Corp.", "Acme", p("a", "b", "c", "d")),
        ("k4", "nothing", "Acme", []),
        ("k5", None, "Acme", p("X")),
    ]
    df = spark.createDataFrame(rows, "key string, text string, filer string, triples array<struct<rel:string,target:string>>")
    got = {r.key: r.h for r in df.select("key", construct.hard_chunk(F.col("triples"), F.col("text"), F.col("filer")).alias("h")).collect()}
    assert got == {"k1": False, "k2": True, "k3": True, "k4": False, "k5": True} and "corp" in SUFFIXES
    many = spark.range(100).select(F.concat(F.lit("n"), "id").alias("key"), F.lit("x").alias("text"), F.lit("f").alias("filer"), F.array().cast("array<struct<rel:string,target:string>>").alias("triples")).unionByName(df)
    why = {r.why: r["count"] for r in construct.escalate_labels(many, "key").groupBy("why").count().collect()}
    assert why == {"hard": 3, "sample": int(102 * 0.05)}


def test_routes_critics_and_caps(spark):
    df = spark.createDataFrame([("ESCALATE", 0), (None, 2), (None, 0)], "s string, n int")
    arr = F.sequence(F.lit(1), F.col("n"))
    got = [r.r for r in df.select(construct.route_of(F.col("s"), F.when(F.col("n") > 0, arr).otherwise(F.array().cast("array<int>"))).alias("r")).collect()]
    assert got == ["escalate", "extract", "skip"]
    with pytest.raises(Exception, match="sentinel"):
        spark.createDataFrame([("OTHER",)], "s string").select(construct.route_of(F.col("s"), F.array())).collect()
    c = spark.range(1).select(construct.critic_score(F.lit("accept"), F.lit(1.7)).alias("a"), construct.critic_score(F.lit("relabel"), F.lit(0.9)).alias("b")).first()
    assert (c.a, c.b) == (1.0, 0.0)
    rows = spark.range(60).select((F.col("id") % 6).alias("u"), "id")
    g = construct.capped_groups(rows, "u", F.col("id"), 2, 3)
    assert g.select("u").distinct().count() == 2 and g.count() == 6
