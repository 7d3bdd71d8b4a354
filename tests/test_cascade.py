import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cascade, validation
from loomgraph.schemas import OUTCOME

C = lambda *x: [dict(rel=r, target=t) for r, t in x]
F7 = [
    (1, C(("supplier", "A")), C(("supplier", "A")), 0.95, [], None, None),
    (2, C(("partner", "B")), [], 0.30, [], None, None),
    (3, [], [], 0.90, None, None, None),
    (4, C(("customer", "C")), C(("investor", "C")), 0.60, [], None, None),
]
SCHEMA = "key long, " + OUTCOME


def scored(spark, rows):
    return cascade.scored(spark.createDataFrame(rows, SCHEMA), "key")


def taus(spark, *v):
    return spark.createDataFrame([(float(x),) for x in v], "tau double")


def random_rows(spark, n, seed=1):
    rng = random.Random(seed)
    pick = lambda: [dict(rel=rng.choice("ab"), target=rng.choice("xyz")) for _ in range(rng.randrange(4))]
    rows = [(i, pick(), pick(), rng.choice([0.1, 0.25, 0.5, 0.75, 0.9]), pick()[:1], rng.choice([None, 0.3, 0.6]), None) for i in range(n)]
    return rows, scored(spark, rows)


def brute(rows, escalated):
    tp = fp = fn = exact = 0
    for r in rows:
        gold = {(x["rel"], x["target"]) for x in r[1]}
        pred = gold if escalated(r) else {(x["rel"], x["target"]) for x in r[2]} - {(x["rel"], x["target"]) for x in r[4] or []}
        tp, fp, fn, exact = tp + len(gold & pred), fp + len(pred - gold), fn + len(gold - pred), exact + (gold == pred)
    p, q = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
    return p, q, exact / len(rows) if rows else 1.0


def test_sweep_goldens(spark):
    got = {r.tau: r for r in cascade.sweep(scored(spark, F7), "confidence", taus(spark, 0, 0.4, 0.7, 1.05)).collect()}
    assert got[0.0].escalation_rate == 0 and got[0.0].recall == pytest.approx(1 / 3)
    assert got[0.4].escalation_rate == 0.25 and got[0.4].recall == pytest.approx(2 / 3)
    assert (got[1.05].precision, got[1.05].recall, got[1.05].exact) == (1, 1, 1)
    assert cascade.headline(cascade.sweep(scored(spark, F7), "confidence", taus(spark, 0, 0.4, 0.7, 1.05))).first().tau == 0.7
    two = {(r.tau_none, r.tau_extract): r for r in cascade.sweep_2d(scored(spark, F7), [0, 1.05], [0, 0.7]).collect()}
    assert two[0, 0.7].escalation_rate == 0.25 and two[0, 0.7].recall == pytest.approx(2 / 3)
    assert two[1.05, 0].escalation_rate == 0.5 and two[1.05, 0].recall == pytest.approx(2 / 3)


def test_micro_goldens_and_no_rows(spark):
    m = cascade.micro_prf(scored(spark, F7)).first()
    assert (m.precision, m.recall, m.exact) == (0.5, pytest.approx(1 / 3), 0.5)
    e = cascade.micro_prf(scored(spark, F7).limit(0)).first()
    assert (e.n, e.precision, e.recall, e.f1, e.exact) == (0, 1, 1, 1, 1)
    s = cascade.sweep(scored(spark, F7).limit(0), "confidence", taus(spark, 0.5)).first()
    assert (s.escalation_rate, s.precision) == (0, 1)


def test_sweeps_equal_a_scan_for_each_threshold(spark):
    rows, s = random_rows(spark, 200)
    for r in cascade.sweep(s, "confidence", taus(spark, 0, 0.1, 0.25, 0.3, 0.75, 2)).collect():
        p, q, x = brute(rows, lambda o: o[3] < r.tau)
        assert (r.precision, r.recall, r.exact) == (pytest.approx(p), pytest.approx(q), pytest.approx(x))
    order = sorted(rows, key=lambda o: (o[3], o[0]))
    front = {r.escalated: r for r in cascade.exact_frontier(s, "confidence").collect()}
    assert len(front) == 201
    for k in (0, 1, 37, 200):
        first = {o[0] for o in order[:k]}
        p, q, x = brute(rows, lambda o: o[0] in first)
        assert (front[k].precision, front[k].recall, front[k].exact) == (pytest.approx(p), pytest.approx(q), pytest.approx(x))
    c = {r.fraction: r for r in cascade.curve(s, "confidence", [0.05, 0.4]).collect()}
    assert c[0.05].recall == front[10].recall and c[0.4].escalated == 80
    for r in cascade.escalate_sweep(s.withColumn("p", 1 - F.col("confidence")), "p").collect():
        p, q, _ = brute(rows, lambda o: 1 - o[3] >= r.theta)
        assert (r.precision, r.recall) == (pytest.approx(p), pytest.approx(q))


def test_auroc_equals_pairs(spark):
    rows, s = random_rows(spark, 120, 3)
    local = s.select("confidence", (F.col("fp") + F.col("fn") > 0).alias("bad")).collect()
    bad, ok = [r.confidence for r in local if r.bad], [r.confidence for r in local if not r.bad]
    want = sum((b < g) + (b == g) / 2 for b in bad for g in ok) / (len(bad) * len(ok))
    assert cascade.auroc(s, "confidence").first().auroc == pytest.approx(want)
    assert cascade.auroc(s.filter("fp + fn > 0"), "confidence").first().auroc is None


def test_pareto_equals_dominance(spark):
    rng = random.Random(5)
    pts = [(i, rng.choice([0.1, 0.2, 0.3, 0.4]), rng.choice([0.5, 0.6, 0.7, 0.8])) for i in range(25)] + [(99, 0.1, 0.8), (98, 0.1, 0.8)]
    df = spark.createDataFrame(pts, "id long, escalation_rate double, recall double")
    want = {i for i, c, q in pts if not any((d <= c and r > q) or (d < c and r >= q) for _, d, r in pts)}
    assert {r.id for r in cascade.pareto_front(df).collect()} == want


def test_budget_ties_and_bounds(spark):
    df = spark.createDataFrame(list(zip("edabc", [0.2, 0.1, 0.1, 0.9, 0.3], range(5))), "key string, s double, i int")
    got = [r.i for r in cascade.budget_selection(df, "s", 0.6).orderBy("rank").collect()]
    assert got == [2, 1, 0]
    with pytest.raises(ValueError):
        cascade.budget_selection(df, "s", 1.5)


def test_quantile_taus(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4)], "s double")
    assert [r.tau for r in cascade.quantile_taus(df, "s").orderBy("tau").collect()] == [0.0, 1.5, 3.0, 4 + 1e-9]
    assert [r.tau for r in cascade.quantile_taus(df.limit(0), "s").collect()] == [0.0]
    many = spark.range(200).select(F.col("id").cast("double").alias("s"))
    assert cascade.quantile_taus(many, "s", 11).count() == 11


def test_buckets_are_not_ntile(spark):
    df = spark.range(6).withColumnRenamed("id", "k")
    got = [r.b for r in cascade.rank_buckets(df, [F.col("k")], 4, "q", "b").orderBy("k").collect()]
    assert got == [f"q{min(3, i * 4 // 6) + 1}" for i in range(6)]


def test_frontier_helpers(spark):
    s = spark.createDataFrame([("", "d", 5, {"hit": 0.5}, {"llm_calls": 2.0}), (None, "", 5, {}, {"llm_calls": 1.0})], "run_label string, dataset string, n_questions long, metrics map<string,double>, mean_cost map<string,double>")
    r = cascade.run_rows(s, "llm_calls", "hit")
    assert [x.run for x in r.orderBy("mean_cost").collect()] == ["run", "d"]
    assert cascade.accuracy_at(r.filter("run = 'd'"), 2).first().accuracy == 0.5
    a = cascade.accuracy_at(r.filter("run = 'd'"), 1).first().accuracy
    assert a != a


def test_validation(spark):
    rows, s = random_rows(spark, 100, 9)
    s = s.withColumn("ordinal", F.col("key"))
    a = validation.freeze(s, 0.5)
    b = validation.freeze(s.repartition(3), 0.5)
    assert validation.reproduction_failures(a, b).first().failures == []
    c = validation.freeze(s, 0.8)
    assert "decision_sha256" in validation.reproduction_failures(a, c).first().failures
    esc = sum(r[3] < 0.5 for r in rows)
    assert a.first().escalated_calls == esc
    grid = [(s_, b_, v, v, v) for s_, v in (("confidence", 0.8), ("x", 0.806)) for b_ in (0.15, 0.2, 0.25)]
    m = spark.createDataFrame(grid, "signal string, budget double, recall double, f1 double, exact double")
    assert validation.signal_verdict(m).first().verdict == "ECONOMICS_READY"
    assert validation.signal_verdict(m, ["f1"]).first().verdict == "REPRODUCIBILITY_FAIL"
    log = spark.createDataFrame([("cascade eval: 12 test pairs, 34 targets",), ("prompt tokens: mean=2.5 max=9 truncated=0/12 (mark_filer=True)",)], "value string")
    f = validation.run_facts(log).first()
    assert (f.n_pairs, f.n_targets, f.mean_tokens, f.max_tokens, f.mark_filer) == (12, 34, 2, 9, True)
    man = spark.createDataFrame([('{"exit_code": 0, "prompt": {"total": 5}}',)], "json string")
    bad = {r.path for r in validation.manifest_failures(man, {"exit_code": "0", "prompt.total": "6"}, ["hashes.test"]).collect()}
    assert bad == {"prompt.total", "hashes.test"}


def test_brute_force_gates_over_a_fixture(spark):
    from loomgraph.functions.text import PARTY
    from loomgraph.operators import governance

    import re

    texts = ["We rely on Intel.", "They rely on Intel.", "We rely on AMD.", "", None]
    df = spark.createDataFrame([(t, "Intel Corp") for t in texts], "text string, target string")
    got = df.select("text", governance.rule_gates(F.col("target"), F.col("text"), ["nobody"]).alias("g")).collect()
    for r in got:
        t = r.text or ""
        want = (bool(re.search(r"\bintel\b", t, re.I)), bool(re.search(PARTY, t)))
        assert (r.g.grounded, r.g.filer_party) == want and r.g.passed == all(want)
    person = df.select(governance.rule_gates(F.col("target"), F.col("text"), ["intel corp"])["is_company"].alias("c")).first()
    assert person.c is False
    judge = df.select(governance.rule_judge(governance.rule_gates(F.col("target"), F.col("text")), F.lit(True)).alias("j")).collect()
    assert [r.j for r in judge] == [1.0, 0.0, 0.0, 0.0, 0.0]
