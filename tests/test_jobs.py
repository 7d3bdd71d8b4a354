"""Whole jobs over files, and the five sample-shaped questions with their goldens by hop budget."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import scoring, traverse
from loomgraph.plans import jobs


def test_questions_to_mined_rows(spark, tmp_path):
    n = jobs.generate_questions(spark, str(tmp_path / "q"), companies=30, n=30, depths=(1, 2))
    assert n > 10
    for split in ("train", "dev", "test"):
        lines = [x for f in (tmp_path / "q" / f"split={split}").glob("*.json") for x in f.read_text().splitlines()]
        (tmp_path / f"{split}.jsonl").write_text("\n".join(lines) + "\n")
    stats = jobs.mine(spark, str(tmp_path), "train", "synthetic", str(tmp_path / "sft"))
    assert stats["questions"] == stats["mined"] + stats["unreachable"] + stats["replay_missed"] and stats["mined"] > 0
    s = jobs.evaluate(spark, str(tmp_path), "train", "synthetic", traverse.DegreeController(2), str(tmp_path / "run")).first()
    assert s.n_questions == stats["questions"] and 0 <= s.hit <= 1 and s.hops_max <= 2


def test_hop_budget_zero_answers_with_the_topics(spark, tmp_path):
    (tmp_path / "dev.jsonl").write_text(json.dumps({"id": "1", "question": "q", "q_entity": ["a"], "a_entity": ["a"], "graph": [["a", "r", "b"]]}) + "\n")
    s = jobs.evaluate(spark, str(tmp_path), "dev", "d", traverse.DegreeController(3), str(tmp_path / "o"), traverse.Budget(0, 50)).first()
    assert (s.hit, s.llm_calls_mean) == (1.0, 0.0)


def test_pairs_job(spark, tmp_path):
    c = jobs.build_pairs(spark, str(tmp_path / "p"))
    assert c["pairs"] > c["positives"] > 0
    seen = {}
    for split in ("train", "dev", "test"):
        for r in spark.read.json(str(tmp_path / "p" / "pairs" / f"split={split}")).select("company").distinct().collect():
            assert seen.setdefault(r.company, split) == split


def test_judge_job(spark, tmp_path):
    rows = [{"chunk_text": f"t{i}", "filer": "A", "relationship_type": "supplier", "target": f"B{i}", "faithfulness": 0.9, "verdict": "accept", "accession_number": f"f{i % 40}"} for i in range(80)]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, [*rows, {"filer": "A"}])))
    assert jobs.split_judge(spark, str(tmp_path / "j.jsonl"), str(tmp_path / "out"), negatives=True) == 1
    got = {r.split: r["count"] for r in spark.read.json(str(tmp_path / "out")).groupBy("split").count().collect()}
    assert got == {"train": 144, "dev": 4, "test": 4}


def test_scoring_and_configuration(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aaaa"), (3, None)], "key long, t string")
    load = lambda: lambda cols: [None if t is None else len(t) / 3 for t in cols["t"]]
    assert {r.key: r.score for r in scoring.score(df, load, ["t"]).collect()} == {1: pytest.approx(2 / 3), 2: 1.0, 3: None}
    assert {r.key: r.score for r in scoring.score(df, load, ["t"], threshold=0.7).collect()} == {1: 0.0, 2: 1.0, 3: None}
    assert scoring.build({"target": "loomgraph.operators.traverse.DegreeController", "max_hops": 1}) == traverse.DegreeController(1)


def test_cascade_and_gate_jobs(spark, tmp_path):
    s = "key long, gold array<struct<rel:string,target:string>>, pred array<struct<rel:string,target:string>>, confidence double, uncertain array<struct<rel:string,target:string>>, agreement double, min_agreement double"
    e = [{"rel": "r", "target": "t"}]
    o = spark.createDataFrame([(i, e, e if i % 3 else [], (i % 10) / 10, [], None, None) for i in range(40)], s)
    rep = jobs.cascade_report(o, "key", str(tmp_path / "c"))
    assert rep["confidence headline"].count() == 1
    f = jobs.frontier(spark, str(tmp_path / "c"), str(tmp_path / "f"), accuracy="recall")
    assert f.count() > 20
    gate = o.select("key", F.col("confidence").alias("score"))
    g = jobs.gate_report(o, "key", gate)
    assert {r.ordering for r in g.collect()} >= {"gate", "oracle"}
    a = g.filter("ordering = 'gate'").select("recall", "fraction").orderBy("fraction").collect()
    assert a == g.filter("ordering = 'confidence'").select("recall", "fraction").orderBy("fraction").collect()
    with pytest.raises(Exception, match="no gate score"):
        jobs.gate_report(o, "key", gate.filter("key > 3")).collect()
    r = jobs.routing_report(o, "key", o.select("key", F.lit("escalate").alias("route"), F.col("confidence").alias("p_escalate")))
    assert r.first().recall == 1.0
    pairs = o.select("key", F.lit("Acme text").alias("text"), (F.col("key") % 7).cast("string").alias("filer"), F.col("gold").alias("triples"))
    jobs.gate_data(o, pairs, str(tmp_path / "g"), hardness=True)
    assert spark.read.json(str(tmp_path / "g")).count() == 40
