import math
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomgraph.functions.digest import jsonl_digest
from loomgraph.functions.text import candidate_spans, match_candidate
from loomgraph.operators import decoding, governance, training, traverse, validation
from loomgraph.operators.store import EdgeStore, QuestionStore
from loomgraph.sources import kgqa, telemetry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
END = 0
RELATIONS, TARGETS = ["supplier", "partner"], ["Acme", "Bolt"]


def encode(text):
    return [ord(c) for c in text]


def grammar(sentinels=("ESCALATE",)):
    return decoding.claim_grammar(RELATIONS, TARGETS, encode, END, 3, sentinels)


def flat(prompt):
    return lambda done, options: [0.0] * len(options)


def test_controller_examples_mask_the_prompt(spark):
    rows = spark.createDataFrame([("a", "state", "r"), ("b", None, "r"), ("c", "state", None), ("d", "s", "x" * 50)], "key string, prompt string, target string")
    got = {r.key: r for r in training.controller_examples(rows, lambda: encode, END, 6).collect()}
    assert got["a"].input_ids == [*encode("ate"), *encode(" r"), END] and got["a"].labels == [-100] * 3 + [*encode(" r"), END]
    assert got["b"].labels == [*encode(" r"), END] and got["c"].dropped and got["d"].dropped and got["d"].input_ids is None


def test_extraction_examples_drop_what_the_grammar_cannot_give(spark):
    rows = spark.createDataFrame(
        [("a", "p", [("supplier", "Acme")], False), ("b", "p", [], False), ("c", "p", [("supplier", "Nobody")], False), ("d", "p", [("supplier", "Acme")], True), ("e", None, None, None)],
        "key string, prompt string, triples array<struct<rel:string,target:string>>, escalate boolean",
    )
    got = {r.key: r for r in training.extraction_examples(rows, lambda: (encode, grammar()), 400).collect()}
    g = grammar()
    done = decoding.encode_claims([("supplier", "Acme")], g)
    assert got["a"].labels == [-100, *done] and got["b"].labels == [-100, *g.none] and got["e"].labels == list(g.none)
    assert got["c"].dropped and got["d"].labels == [-100, *g.sentinels["ESCALATE"]]


def test_surface_targets_are_counted_when_absent(spark):
    p = spark.createDataFrame([("We buy from NVIDIA Corp and Bolt.", [("supplier", "NVIDIA Corporation"), ("supplier", "Absent Co")])], "text string, triples array<struct<rel:string,target:string>>")
    r = training.surface_targets(p, candidate_spans(F.col("text")), match_candidate).first()
    assert [tuple(t) for t in r.triples] == [("supplier", "NVIDIA Corp")] and r.unmatched == 1


def test_judge_examples_lose_their_end(spark):
    rows = spark.createDataFrame([("a", "abcdef", 0.5), ("b", None, None)], "key string, prompt string, faithfulness double")
    got = {r.key: r for r in training.judge_examples(rows, lambda: encode, 3).collect()}
    assert got["a"].input_ids == encode("abc") and got["a"].label == 0.5 and got["b"].input_ids == [] and got["b"].label is None


def test_rollouts_are_samples_with_their_logprob(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, prompt string")
    got = training.rollouts(chunks, lambda: flat, grammar, 5)
    rows = {(r.key, r.rollout): r for r in got.collect()}
    assert len(rows) == 10 and rows == {(r.key, r.rollout): r for r in training.rollouts(chunks.repartition(3), lambda: flat, grammar, 5).collect()}
    for r in rows.values():
        total, n = training.claims_logprob(flat(""), grammar(), r.ids)
        assert n == len(r.ids) and math.isclose(total, r.logprob, abs_tol=1e-9)
    assert len({tuple(r.ids) for r in rows.values()}) > 1


def test_routing_outcomes_fall_back_to_the_plain_grammar(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", None)], "key string, prompt string")
    for r in training.routing_outcomes(chunks, lambda: flat, grammar, lambda: grammar(())).collect():
        assert 0 < r.p_escalate < 1 and 0 < r.confidence <= 1


def test_losses_by_hand(spark):
    s = spark.createDataFrame([(1, 0, 2, 1.0, 0.0, 0.0, 0.0), (1, 0, 4, -1.0, 1.0, 0.0, 0.5), (1, 1, 1, 0.5, -2.0, 0.0, 0.0)], "update int, rollout int, tokens int, adv double, lp double, old double, ref double")
    loss = training.step_loss(F.col("adv"), F.col("lp"), F.col("old"), F.col("tokens"), F.col("ref"), kl=0.1)
    each = [-1.0, math.e + 0.1 * 0.5 / 4, -math.exp(-2) * 0.5 + 0.1 * -2]
    assert math.isclose(training.batch_loss(s, loss).first().loss, ((each[0] + each[1]) / 2 + each[2]) / 2)
    assert math.isclose(training.batch_loss(s, loss, "dr_grpo", 8.0).first().loss, ((each[0] * 2 + each[1] * 4) / 8 + each[2] / 8) / 2)
    with pytest.raises(ValueError):
        training.batch_loss(s, loss, "other")


def test_gate_model_orders_by_its_feature(spark):
    rows = spark.createDataFrame([(i, i / 100, float(i >= 50) if i else None) for i in range(100)], "key int, confidence double, y double")
    for binary in (True, False):
        got = {r.key: r.score for r in training.predict(training.fit_scores(rows, ["confidence"], "y", binary), rows, ["confidence"]).collect()}
        assert len(got) == 100 and got[90] > got[10] and all(0 <= v <= 1 for v in got.values())


def test_judges_by_name():
    assert training.choose_judge("distant") is None
    with pytest.raises(ValueError):
        training.choose_judge("somewhere")


E_ROWS = [("q", 0, "a", "r_hi", "b1"), ("q", 1, "a", "r_hi", "b2"), ("q", 2, "a", "r_lo", "c"), ("p", 0, "a", "r_hi", "z")]
EDGE = "qid string, pos long, head string, relation string, tail string"
Q = "qid string, question string, topics array<string>, golds array<string>"


def test_question_store_contracts(spark):
    store = QuestionStore(spark.createDataFrame(E_ROWS, EDGE))
    with pytest.raises(RuntimeError):
        store.subgraph()
    with pytest.raises(KeyError):
        store.load("nope")
    assert store.load("q").relations("a") == ["r_hi", "r_lo"] and [r.tail for r in store.neighbors("a", "r_hi").orderBy("pos").collect()] == ["b1", "b2"]
    assert [r.tail for r in store.load("p").neighbors("a", "r_hi").collect()] == ["z"]
    more = store.add(spark.createDataFrame([("n", 0, "x", "r", "y"), ("p", 0, "a", "r_hi", "w")], EDGE))
    assert {r.qid for r in more.qids().collect()} == {"q", "p", "n"} and [r.tail for r in more.load("p").neighbors("a", "r_hi").collect()] == ["w"]


def test_edge_store_is_idempotent(spark, tmp_path):
    p = spark.createDataFrame([("f", "A", "supplier", "B", "ch", "A buys from B", "extract", 0.9, None, "x"), ("f", "A", "nope", "C", "ch", "t", "extract", 0.9, None, "x")], "filing string, filer string, relation string, target string, chunk string, text string, route string, confidence double, judge_score double, extractor string")
    audited = governance.audit_edges(p, (governance.schema_allowlist(),))
    store = EdgeStore(spark, str(tmp_path / "edges"))
    assert store.count() == 0 and store.commit(audited) == 1 and store.commit(audited) == 0 and store.count() == 1
    assert [r.chunk for r in store.provenance("A", "supplier", "B").collect()] == ["ch"] and store.provenance("A", "supplier", "C").count() == 0


def test_model_controller_and_path_reader(spark):
    q = spark.createDataFrame([("q", "?", ["a"], ["b2"]), ("p", "?", ["a"], ["z"])], Q)

    def load():
        def choose(prompt, candidates):
            assert prompt.startswith("Q: ? || step=") and candidates[-1] == "[STOP]"
            return (candidates[0], -2.0, 4, 7) if "step=0" in prompt else ("[STOP]", 0.0, 2, 7)

        return choose

    got = {r.qid: r for r in traverse.traverse(q, spark.createDataFrame([*E_ROWS, ("q", 3, "b1", "r", "d")], EDGE), traverse.ModelController(load), traverse.Budget(3, 5), synthesizer=traverse.PathReader(lambda p: F.lit("B2, nobody"))).collect()}
    assert got["q"].answers == ["b2"] and got["q"].hit == 1.0 and got["p"].answers == ["z"]
    assert (got["q"].prompt_tokens, got["q"].gen_tokens, got["q"].llm_calls) == (14, 6, 2) and math.isclose(got["q"].steps[0].action.score, math.exp(-0.5))
    one = traverse.traverse(q, spark.createDataFrame(E_ROWS, EDGE), traverse.ModelController(load), traverse.Budget(None, None, max_prompt_tokens=7)).collect()
    assert all(r.llm_calls == 1 and r.hops == 1 for r in one)
    assert all(r.hops == 0 for r in traverse.traverse(q, spark.createDataFrame(E_ROWS, EDGE), traverse.DegreeController(2), traverse.Budget(max_wall_ms=0)).collect())


def test_provenance_policy_reads_its_sources(spark):
    q = spark.createDataFrame([("q", "?", ["a"], ["b1"]), ("p", "?", ["a"], ["z"])], Q)
    sources = spark.createDataFrame([("q", "a", "r_hi", "s1")], "qid string, head string, relation string, source string")
    r = traverse.traverse(q, spark.createDataFrame(E_ROWS, EDGE), traverse.DegreeController(1), policies=(governance.provenance_required(sources),)).collect()
    assert {x.qid: (x.hops, x.verdict) for x in r} == {"q": (1, True), "p": (0, False)}


def test_jsonl_digest_is_that_of_the_file(spark):
    import hashlib

    df = spark.createDataFrame([(2, '{"b": 1, "a": "ü"}'), (1, '{"z": []}')], "k int, row string")
    assert jsonl_digest(df, "k", F.col("row")) == hashlib.sha256(b'{"z":[]}\n{"a":"\\u00fc","b":1}\n').hexdigest()
    assert jsonl_digest(df.limit(0), "k", F.col("row")) == hashlib.sha256().hexdigest()


def test_runs_are_compared_by_identity_first(spark, tmp_path):
    for n, t in (("test", "x"), ("outcomes", "y"), ("adapter", "z")):
        (tmp_path / n).write_text(t)
    paths = {n: str(tmp_path / n) for n in ("test", "outcomes")}
    m = validation.run_manifest({"code_commit": "c1", "model_revision": "r1"}, {**paths, "adapter": str(tmp_path / "adapter")}, {})
    base = {"hashes": {"pairs": m["hashes"]["test"], "adapter": m["hashes"]["adapter"]}, "code_commit": "c1"}
    assert validation.identity_failures(base, m, paths) == []
    (tmp_path / "outcomes").write_text("changed")
    assert validation.identity_failures({**base, "code_commit": "c2"}, m, paths) == ["baseline.code_commit", "hashes.outcomes"]
    metrics = spark.createDataFrame([("confidence", 0.2, 0.5, 0.5, 0.5), ("agreement", 0.2, 0.6, 0.6, 0.6)], "signal string, budget double, recall double, f1 double, exact double")
    assert validation.compare_runs(base, m, paths, metrics)["verdict"] == "REPRODUCIBILITY_FAIL"
    (tmp_path / "outcomes").write_text("y")
    assert validation.compare_runs(base, m, paths, metrics) == {"reproduction_failures": [], "verdict": "ECONOMICS_READY"}
    t = validation.token_counts(spark.createDataFrame([("a", "xyz"), ("b", None)], "k string, t string"), "k", "t", lambda: encode)
    assert {(r.key, r.input_tokens, r.output_tokens) for r in t.collect()} == {("a", 3, 0), ("b", 0, 0)}


def test_run_log_snapshot_and_plots(spark, tmp_path):
    class Tracker(list):
        def log(self, record):
            self.append(record)

        def finish(self):
            self.append("end")

    seen, path = Tracker(), str(tmp_path / "run" / "log.jsonl")
    for _ in range(2):
        with telemetry.RunLog(path, seen) as log:
            log.log({"update": 1, "mean_reward": 0.5, "name": "ü"})
    assert open(path, encoding="utf-8").read() == '{"update": 1, "mean_reward": 0.5, "name": "ü"}\n' and seen.count("end") == 2
    telemetry.snapshot({"a": 1}, str(tmp_path / "run" / "config.json"))
    made = telemetry.plot_run(spark, path, str(tmp_path / "run.png"))
    assert made is None or os.path.exists(made)


def test_download_knows_its_sets(tmp_path):
    with pytest.raises(ValueError):
        kgqa.download("other", str(tmp_path))
    paths = kgqa.download("cwq", str(tmp_path), lambda name: {"train": [{"id": name}], "test": []})
    assert [os.path.basename(p) for p in paths] == ["train.jsonl", "test.jsonl"] and "cwq" in open(paths[0]).read()


def test_command_line_reads_values():
    from loomgraph.plans import cli

    a = cli.parser().parse_args(["build-pairs", "--folder", "/x", "--floor", "0.5"])
    assert a.job == "build-pairs" and a.floor == 0.5 and a.seed == 42
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["build-pairs"])
