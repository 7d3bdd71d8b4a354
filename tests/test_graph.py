from pyspark.sql import functions as F

from loomgraph.functions import metrics
from loomgraph.operators import governance, graph, traverse

EDGE = "qid string, pos long, head string, relation string, tail string"
Q = "qid string, question string, topics array<string>, golds array<string>"


def edges(spark, rows, qid="q"):
    return spark.createDataFrame([(qid, i, *r) for i, r in enumerate(rows)], EDGE)


FAN = [("a", "r_hi", "b1"), ("a", "r_hi", "b2"), ("a", "r_lo", "c"), ("b1", "r_next", "d")]
LINE = [("a", "r1", "b"), ("b", "r2", "c"), ("a", "shortcut", "c"), ("x", "r3", "y")]


def test_reverse_closure_adds_only_what_is_absent(spark):
    rows = [("NVIDIA", "competitor_of", "AMD"), ("TSMC", "supplier_to", "NVIDIA"), ("NVIDIA", "in_sector", "sector:semiconductors"), ("AMD", "competitor_of", "NVIDIA"), ("NVIDIA", "unknown", "X")]
    closed = graph.with_reverses(edges(spark, rows))
    got = {tuple(r) for r in closed.select("head", "relation", "tail").collect()}
    assert ("NVIDIA", "customer_of", "TSMC") in got and ("sector:semiconductors", "sector_contains", "NVIDIA") in got
    assert closed.count() == len(got) == 7
    reached = graph.follow(spark.createDataFrame([("AMD", "AMD")], "source string, node string"), closed.drop("qid"), ["competitor_of", "customer_of"])
    assert [r.node for r in reached.collect()] == ["TSMC"]


def test_adjacency_drops_nulls_and_keeps_first_position(spark):
    e = spark.createDataFrame([("q", 3, "a", "r", "b"), ("q", 1, "a", "r", "b"), ("q", 2, None, "r", "b")], EDGE)
    assert [tuple(r) for r in graph.adjacency(e).collect()] == [("q", "a", "r", "b", 1)]
    assert graph.adjacency(e.limit(0)).count() == 0
    n = graph.neighbors(edges(spark, FAN)).filter("node = 'a' and relation = 'r_hi'").orderBy("place").collect()
    assert [(r.place, r.tail) for r in n] == [(0, "b1"), (1, "b2")]


def test_distances_to_gold(spark):
    for golds, want in ((["c"], {"c": 0, "a": 1, "b": 1}), (["c", "b"], {"a": 1, "b": 0, "c": 0})):
        gold = spark.createDataFrame([("q", g) for g in golds], "qid string, node string")
        dist = graph.distance_to(gold, edges(spark, LINE), 4)
        assert {r.node: r.dist for r in dist.collect()} == want
    front = spark.createDataFrame([("q", "a"), ("q", "x")], "qid string, node string")
    assert graph.frontier_distance(front, dist, 9).first().dist == 1
    none = spark.createDataFrame([("q", "x"), ("q", "y")], "qid string, node string")
    assert graph.frontier_distance(none, dist, 9).first().dist == 9
    s = spark.range(1).select(graph.shaping_deltas(F.array(F.lit(2), F.lit(1)), F.lit(0), 0.1).alias("s")).first().s
    assert [round(x, 6) for x in s] == [0.2, 0.1]


def test_shortest_script_prefers_first_stored_way(spark):
    q = spark.createDataFrame([("q", "?", ["a"], ["c"]), ("q2", "?", ["a"], ["a"]), ("q3", "?", ["a"], ["y"])], Q)
    shared = edges(spark, LINE).drop("qid")
    got = {r.qid: r.script for r in graph.shortest_scripts(q, shared, 3).collect()}
    assert got == {"q": ["shortcut"], "q2": [], "q3": None}


def test_the_last_hop_of_a_script_goes_to_golds_only(spark, monkeypatch):
    hub = [("hub", "r", f"t{i}") for i in range(200)] + [("hub", "s", "t7")]
    e = edges(spark, [(f"q{i}", "to", "hub") for i in range(50)] + hub).drop("qid")
    q = spark.createDataFrame([(f"q{i}", "?", [f"q{i}"], ["t7", "nowhere"] if i < 40 else []) for i in range(50)] + [("near", "?", ["hub"], [f"t{i}" for i in range(199, 90, -1)])], Q)
    counted, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: counted.append(real(df).count()) or real(df))
    got = {r.qid: r.script for r in graph.shortest_scripts(q, e, 2).collect()}
    assert got == {f"q{i}": ["to", "r"] if i < 40 else None for i in range(50)} | {"near": ["r"]}
    assert max(counted) <= 300  # before, 50 times the hub's 200 tails


def test_neighborhoods_of_a_hub(spark, monkeypatch):
    rows = [(f"q{i}", "to", "hub") for i in range(30)] + [("hub", "r", f"t{i}") for i in range(40)] + [("hub", "r", "q3"), ("q3", "s", "hub")]
    e = edges(spark, rows).drop("qid")
    topics = spark.createDataFrame([(f"q{i}", f"q{i}") for i in range(30)], "qid string, node string")
    out = {h: [r for r in rows if r[0] == h] for h in {r[0] for r in rows}}
    want = {(q, *x) for q in (f"q{i}" for i in range(30)) for n in (q, "hub") for x in out[n]}
    counted, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: counted.append(real(df).count()) or real(df))
    monkeypatch.setattr(graph, "CELL", 50, raising=False)
    got = [tuple(r) for r in graph.neighborhood(topics, e, 1, most=1 << 30).select("qid", "head", "relation", "tail").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(counted) < 100  # before, the 30 times 41 edges stood in a checkpoint
    some = graph.neighborhood(topics, e, 1, most=42).groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in some} == {f"q{i}": 42 for i in range(30)}


def test_neighborhood_sizes_list_no_edges(spark):
    e = edges(spark, FAN + [("b1", "r_next", "a"), ("z", "r", "zz")]).drop("qid")
    topics = spark.createDataFrame([("q", "a"), ("q", "b1"), ("p", "c"), ("s", "z")], "qid string, node string")
    got = graph.neighborhood_sizes(topics, e, 1)
    assert {r.qid: r.edges for r in got.collect()} == {"q": 5, "s": 1}
    assert {r.qid: r["count"] for r in graph.neighborhood(topics, e, 1).groupBy("qid").count().collect()} == {"q": 5, "s": 1}


def run(spark, rows, question, controller, **kw):
    q = spark.createDataFrame([question], Q)
    return traverse.traverse(q, edges(spark, rows, question[0]), controller, **kw)


def test_one_hop_takes_the_widest_relation(spark):
    r = run(spark, FAN, ("q", "?", ["a"], ["b1"]), traverse.DegreeController(1)).first()
    assert r.answers == ["b1", "b2"] and r.hops == 1 and r.hit == 1.0 and r.llm_calls == 2
    assert r.steps[0].action.relation == "r_hi" and r.steps[0].action.score == 2.0 and r.steps[1].action.type == "STOP"
    assert r.steps[0].state_repr == "Q: ? || step=0 || frontier: a"


def test_budgets_and_beam(spark):
    zero = run(spark, FAN, ("q", "?", ["a"], ["b1"]), traverse.DegreeController(3), budget=traverse.Budget(0, 50)).first()
    assert (zero.hops, zero.llm_calls, zero.answers) == (0, 0, ["a"])
    one = run(spark, FAN, ("q", "?", ["a"], ["b1"]), traverse.DegreeController(3), beam=0).first()
    assert one.answers == ["d"] and one.hops == 2
    calls = run(spark, FAN, ("q", "?", ["a"], ["d"]), traverse.DegreeController(3), budget=traverse.Budget(None, 1)).first()
    assert (calls.hops, calls.llm_calls) == (1, 1)


def test_questions_without_topics_or_edges(spark):
    q = spark.createDataFrame([("q", "?", [], ["b1"]), ("r", None, None, None), ("s", "?", ["zz", None], ["zz"])], Q)
    got = {r.qid: r for r in traverse.traverse(q, edges(spark, FAN), traverse.DegreeController(2)).collect()}
    assert len(got) == 3 and all(r.llm_calls == 0 for r in got.values())
    assert got["q"].answers == [] and got["r"].hit == 0.0 and got["s"].hit == 1.0


def test_script_controller_and_mining(spark):
    scripts = spark.createDataFrame([("q", ["r_hi", "nowhere"])], "qid string, script array<string>")
    r = run(spark, FAN, ("q", "?", ["a"], ["b1"]), traverse.ScriptController(scripts)).first()
    assert [s.action.score for s in r.steps] == [1.0, 0.0] and r.hops == 1
    q = spark.createDataFrame([("q", "?", ["a"], ["d"]), ("u", "?", ["a"], ["none"])], Q)
    hits, stats = traverse.mine(q, edges(spark, FAN).drop("qid"), 3)
    assert [x.target for x in traverse.sft_rows(hits).orderBy("step").collect()] == ["r_hi", "r_next"]
    s = stats.first()
    assert (s.questions, s.unreachable, s.mined, s.depths) == (2, 1, 1, {2: 1})


def test_fanout_lists_hubs_once_for_all_questions(spark, monkeypatch):
    rows = [("h0", "r", f"t{i}") for i in range(300)] + [("h1", "r", f"t{i}") for i in range(100, 350)] + [("h2", "r", f"t{i}") for i in range(290, 330)] + [("h2", "s", "x"), ("lone", "r", "t0")]
    g = graph.adjacency(edges(spark, rows).drop("qid"))
    fronts = [(f"q{q}", p, n) for q in range(80) for p, n in enumerate(["h2", "h1", "h0"] if q % 2 else ["lone", "h1"])]
    counted, real = [], traverse.Fanout.listed
    monkeypatch.setattr(traverse.Fanout, "listed", lambda self, row: counted.append(real(self, row).count()) or real(self, row))
    got = {r.qid: [(o.relation, o.degree, tuple(o.order)) for o in r.options] for r in traverse.Fanout(g, []).options(spark.createDataFrame(fronts, "qid string, place int, node string")).collect()}
    assert got["q0"] == [("r", 251, (0, 591))] and got["q1"] == [("r", 350, (0, 550)), ("s", 1, (0, 590))] and len(got) == 80
    assert counted == [250 + 2 * 40 + 1]  # not the 80 frontiers' 33,680 tails


def test_traversal_carries_no_golds(spark, monkeypatch):
    cuts, real = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: cuts.append(df.columns) or real(df))
    r = run(spark, FAN, ("q", "?", ["a"], ["b1", "zz"]), traverse.DegreeController(2)).first()
    assert r.golds == ["b1", "zz"] and r.hit == 0.0 and r.answers == ["d"]
    assert sum("golds" in c for c in cuts) == 1


HUB = [("q", "rival", "m1"), ("q", "rival", "m2"), ("p", "rival", "m2"), ("o", "rival", "none"), ("n", "owns", "q")] + [("m1", "owns", f"t{i}") for i in range(60)] + [("m2", "owns", f"t{i}") for i in range(50, 70)]


def test_many_golds_are_counted_and_not_listed(spark, monkeypatch):
    e = edges(spark, HUB).drop("qid")
    q = spark.createDataFrame([(x, "?", [x], [f"t{i}" for i in g]) for x, g in (("q", range(70)), ("p", range(50, 70)), ("o", []), ("n", []), ("t0", []))], Q)
    seen, real = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: seen.append(real(df)) or seen[-1])
    listed = traverse.traverse(q, e, traverse.DegreeController(2), beam=3)
    seen.clear()
    bare = traverse.traverse(q.withColumn("golds", F.array().cast("array<string>")), e, traverse.DegreeController(2), beam=3)
    counted = traverse.with_golds(bare, *graph.reached_ids(e, "rival", "owns"))
    got = {r.qid: r for r in counted.collect()}
    assert {k: r.n_golds for k, r in got.items()} == {"q": 70, "p": 20, "o": 0, "n": 0, "t0": 0}
    assert {k: sorted(r.golds) for k, r in got.items()} == {"q": ["t0", "t1", "t2"], "p": ["t50", "t51", "t52"], "o": [], "n": [], "t0": []}
    assert max(len(r.golds) for df in seen if "golds" in df.columns for r in df.collect()) == 3  # before, 70
    one = lambda df, n: {r.qid: (r.hit, r.f) for r in df.select("qid", "hit", metrics.answer_f1(F.col("answers"), F.col("golds"), n).alias("f")).collect()}
    assert one(counted, F.col("n_golds")) == one(listed, None)
    assert traverse.summary(counted).first() == traverse.summary(listed).first()


def test_degrees_are_counted_only_for_steps_that_look_at_them(spark, monkeypatch):
    calls, real = [], traverse.Fanout.listed
    monkeypatch.setattr(traverse.Fanout, "listed", lambda self, row: calls.append(1) or real(self, row))
    r = run(spark, FAN + [("d", "r_on", "e")], ("q", "?", ["a"], ["d"]), traverse.DegreeController(2)).first()
    assert (r.answers, r.hops, r.llm_calls, r.verdict) == (["d"], 2, 3, True)
    assert [(s.action.type, s.action.score, s.candidates) for s in r.steps] == [("EXPAND", 2.0, ["r_hi", "r_lo"]), ("EXPAND", 1.0, ["r_next"]), ("STOP", 1.0, ["r_on"])]
    assert len(calls) == 2  # before, 3


def test_policies_audit_and_block(spark):
    policies = governance.build_policies([{"name": "relation_allowlist", "patterns": ["r_l*"]}])
    r = run(spark, FAN, ("q", "?", ["a"], ["b1"]), traverse.DegreeController(2), policies=policies)
    row = r.first()
    assert row.hops == 0 and row.verdict is False and row.steps[0].checks_passed == {"relation_allowlist": False}
    assert governance.certificates(governance.hop_audits(r)).first().verdict is False
    soft = (governance.relation_allowlist(["r_l*"], mandatory=False),)
    row = run(spark, FAN, ("q", "?", ["a"], ["b1"]), traverse.DegreeController(1), policies=soft).first()
    assert row.hops == 1 and row.verdict is False
    assert [p.name for p in governance.build_policies([])] == ["allow_all"]
    try:
        governance.build_policies(["nope"])
        raise AssertionError("an unknown policy must be a KeyError")
    except KeyError:
        pass


def test_neighborhood_is_capped_and_keeps_what_must_stay(spark):
    rows = [("a", "r", f"t{i}") for i in range(30)] + [("t1", "s", "u")]
    topics = spark.createDataFrame([("q", "a")], "qid string, node string")
    e = edges(spark, rows).drop("qid")
    assert graph.neighborhood(topics, e, 1).count() == 31
    must = spark.createDataFrame([("q", "t1", "s", "u", 30)], "qid string, head string, relation string, tail string, pos long")
    got = graph.neighborhood(topics, e, 1, most=5, must=must)
    assert 5 <= got.count() <= 6 and got.filter("head = 't1'").count() == 1
