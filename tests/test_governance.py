from loomgraph.operators import governance
from loomgraph.schemas import PROPOSAL

TEXT = "We rely on Taiwan Semiconductor Manufacturing Company for wafer fabrication. We compete directly with Intel Corporation and NVIDIA."


def proposal(target, chunk="ch-1", score=None, relation="competitor"):
    return ("f", "Acme", relation, target, chunk, TEXT, "extract", 0.9, score, "m")


def audit(spark, rows, *policies):
    return governance.audit_edges(spark.createDataFrame(rows, PROPOSAL), policies)


def test_grounded_edges_are_committed_and_others_blocked(spark):
    a = audit(spark, [proposal("Intel"), proposal("Broadcom")], governance.schema_allowlist(), governance.evidence_gates())
    c = governance.write_certificates(a).first()
    assert (c.n_committed, c.n_blocked, c.verdict) == (1, 1, True)
    p = governance.provenance(a).first()
    assert p.tail == "Intel" and TEXT[p.span.start : p.span.end] == "Intel"


def test_same_edge_from_two_chunks_has_two_provenances(spark):
    a = audit(spark, [proposal("Intel"), proposal("Intel", "ch-2")], governance.schema_allowlist())
    asked = spark.createDataFrame([("Acme", "competitor", "Intel"), ("Acme", "competitor", "None")], "head string, relation string, tail string")
    p = governance.provenance_of(a, asked).collect()
    assert len(p) == 1 and [x.chunk for x in p[0].provenance] == ["ch-1", "ch-2"]
    assert governance.has_provenance(a, asked).count() == 1
    c = governance.provenance_counts(a).first()
    assert (c.provenances, c.chunks) == (2, 2)


def test_floor_prefers_the_judge_and_nulls_fail(spark):
    rows = [proposal("Intel", score=0.1), proposal("NVIDIA"), (*proposal("AMD")[:7], None, None, "m")]
    a = {r.target: r.committed for r in audit(spark, rows, governance.edge_confidence_floor(0.5)).collect()}
    assert a == {"Intel": False, "NVIDIA": True, "AMD": False}
    soft = governance.EdgePolicy("edge_confidence_floor", governance.edge_confidence_floor(0.5).check, mandatory=False)
    c = governance.write_certificates(audit(spark, rows, soft)).first()
    assert (c.n_committed, c.verdict) == (3, False)


def test_nothing_proposed(spark):
    a = audit(spark, [], governance.schema_allowlist())
    assert governance.write_certificates(a).count() == 0 and governance.provenance(a).count() == 0


def test_proposals_of_decisions(spark):
    s = "filing string, chunk string, text string, filer string, gold array<struct<rel:string,target:string>>, confidence double, route string, triples array<struct<rel:string,target:string>>, logprob double, n_choices int"
    e = {"rel": "supplier", "target": "B"}
    rows = [("f", "c", "t", "A", [], 0.5, "extract", [e], 0.0, 0), ("f", None, "t", "A", [e], 0.0, "escalate", [], 0.0, 1), ("f", "c", "t", "A", [e], 0.5, "skip", [e], 0.0, 1)]
    got = {r.route: r for r in governance.proposals(spark.createDataFrame(rows, s)).collect()}
    assert set(got) == {"extract", "escalate"} and got["escalate"].confidence == 1.0 and got["escalate"].chunk == "f:chunk"
