import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import digest
from loomgraph.functions.taxonomy import REVERSE
from loomgraph.operators import graph
from loomgraph.sources import kgqa, sinks, synthetic


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_records_are_read_tolerantly(spark, tmp_path):
    write(
        tmp_path / "validation.jsonl",
        {"id": "1", "question": "who", "q_entity": " a ", "a_entity": ["b", " ", None, "b"], "graph": [["a", "r", "b"], ["a", "r", "b"], ["a", " ", "c"], ["x", "y"], ["a", None, "d"]]},
        "",
        {"QuestionId": 2, "RawQuestion": "what", "entities": ["e"], "answers": None, "kg": None},
    )
    got = kgqa.load_records(spark, str(tmp_path), "dev", "set").orderBy("ordinal").collect()
    assert got[0].topics == ["a"] and got[0].golds == ["b", "b"]
    assert [tuple(t) for t in got[0].graph] == [("a", "r", "b"), ("a", "None", "d")]
    assert (got[1].qid, got[1].question, got[1].topics, got[1].golds, got[1].graph) == ("2", "what", ["e"], [], [])
    assert kgqa.load_questions(spark, str(tmp_path), "dev", "set", limit=1).count() == 1
    e = kgqa.edges_of(kgqa.load_records(spark, str(tmp_path), "dev", "set"))
    assert e.count() == 2
    with pytest.raises(FileNotFoundError):
        kgqa.split_path(str(tmp_path), "test")
    write(tmp_path / "test.jsonl", {"question": "no id"})
    with pytest.raises(Exception, match="no id"):
        kgqa.load_records(spark, str(tmp_path), "test", "set").collect()


def test_triples(spark, tmp_path):
    p = write(tmp_path / "t.jsonl", {"head": "A", "relation": "Supplier_To", "tail": "B"}, {"head": "A", "relation": "in_sector", "tail": "sector:x"})
    edges, entities = kgqa.load_triples(spark, p)
    assert edges.count() == 4 and {(r.entity, r.type) for r in entities.collect()} == {("A", "company"), ("B", "company"), ("sector:x", "sector")}
    with pytest.raises(Exception, match="unknown relation"):
        kgqa.load_triples(spark, write(tmp_path / "u.jsonl", {"head": "A", "relation": "zz", "tail": "B"}))[0].collect()


def test_synthetic_graph_has_every_reverse(spark):
    e = synthetic.graph(spark, 30)
    rows = {(r.head, r.relation, r.tail) for r in e.collect()}
    assert all((t, REVERSE[r], h) in rows for h, r, t in rows)
    assert rows == {(r.head, r.relation, r.tail) for r in synthetic.graph(spark, 30).repartition(2).collect()}
    assert all(h != t for h, _, t in rows)
    q = synthetic.questions(e, 20).collect()
    assert q and len({r.question for r in q}) == len(q)
    for r in q[:5]:
        start = spark.createDataFrame([(r.topic, r.topic)], "source string, node string")
        assert sorted(x.node for x in graph.follow(start, e, r.path).collect()) == r.golds and r.topic not in r.golds
    p = synthetic.pairs(e, 10)
    assert p.filter("size(triples) = 0").count() > 0 and p.filter("size(triples) = 2").count() > 0


def test_sinks(spark, tmp_path):
    df = spark.range(20).select(F.col("id"), F.lit("é").alias("t"))
    assert sinks.write_jsonl(df, str(tmp_path / "j")) == 20
    s = sinks.position_split(df, [F.col("id")])
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 14, "dev": 3, "test": 3}
    swept = spark.createDataFrame([(0.5, 0.1, 0.9, 0.8, 0.85, 0.7)], "tau double, escalation_rate double, precision double, recall double, f1 double, exact double")
    files = sinks.write_summaries(sinks.threshold_summaries(swept, 7), str(tmp_path / "s"))
    assert [f.name for f in files] == ["tau_0.5000.summary.json"]
    r = kgqa.load_summaries(spark, str(tmp_path / "s")).first()
    assert r.metrics["recall"] == 0.8 and r.n_questions == 7


def test_digests(spark, tmp_path):
    import hashlib

    line = spark.createDataFrame([("x",)], "v string").select(digest.content_key(F.col("v")).alias("k")).first().k
    assert line == hashlib.sha256(b"x\n").hexdigest()
    df = spark.range(10).withColumn("j", F.to_json(F.struct(F.lit("é").alias("b"), F.col("id").alias("a"))))
    a = digest.rows_digest(df, "id", F.col("j")).first()[0]
    assert a == digest.rows_digest(df.repartition(3), "id", F.col("j")).first()[0]
    c = df.select(digest.canonical_json(F.col("j")).alias("c")).orderBy("c").first().c
    assert c == '{"a":0,"b":"\\u00e9"}'
    (tmp_path / "f").write_bytes(b"1")
    assert digest.path_digest(str(tmp_path / "f")) == hashlib.sha256(b"1").hexdigest()
