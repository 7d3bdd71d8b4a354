import math
import random

import pytest

from loomgraph.operators import decoding as d

enc = lambda s: [ord(c) for c in s]
END = 0
FLAT = lambda done, allowed: [0.0] * len(allowed)


def grammar(**kw):
    return d.claim_grammar(["supplier", "customer"], ["Acme", "Bolt Inc"], enc, END, **kw)


def wanting(text):
    ids = enc(text) + [END]
    return lambda done, allowed: [5.0 if len(done) < len(ids) and t == ids[len(done)] else 0.0 for t in allowed]


def test_choose():
    a = d.relation_automaton(["r_hi", "r_lo", "r_hi"], enc, END)
    assert d.choose(wanting(" r_lo"), a).candidate == "r_lo"
    c = d.choose(FLAT, d.relation_automaton(["only"], enc, END, stop=False))
    assert c.candidate == "only" and c.logprob == 0.0
    assert {d.choose(FLAT, a, 1.0, random.Random(i)).candidate for i in range(40)} == {"r_hi", "r_lo", "[STOP]"}
    with pytest.raises(ValueError):
        d.relation_automaton([], enc, END)
    with pytest.raises(ValueError):
        d.relation_automaton(["a", "b"], lambda s: [7], END)
    with pytest.raises(KeyError):
        d.allowed_along(a, enc(" x"))


def test_extract_round_trip():
    g = grammar(most=3, sentinels=["ESCALATE"])
    for claims in ([], [("supplier", "Acme")], [("customer", "Bolt Inc"), ("supplier", "Acme")], [("supplier", "Acme")] * 3):
        ids = d.encode_claims(claims, g)
        x = d.extract(lambda done, allowed: [9.0 if t == ids[len(done)] else 0.0 for t in allowed], g)
        assert list(x.triples) == claims and list(x.ids) == ids and x.sentinel is None
        allowed = d.claims_allowed_along(g, ids)
        assert len(allowed) == len(ids) and all(t in a for t, a in zip(ids, allowed))
    assert d.extract(wanting(" ESCALATE"), g).sentinel == "ESCALATE"
    assert ord(" ") not in d.claims_allowed_along(g, d.encode_claims([("supplier", "Acme")] * 3, g))[-1]
    with pytest.raises(ValueError):
        d.encode_claims([("supplier", "Acme")] * 4, g)
    with pytest.raises(ValueError):
        d.encode_claims([("supplier", "X")], g)
    with pytest.raises(ValueError):
        d.claims_allowed_along(g, ids[:-1])
    with pytest.raises(ValueError):
        d.claims_allowed_along(g, [*ids, 1])


def test_sampling_stays_in_the_grammar():
    g = grammar(most=2)
    for seed in range(50):
        x = d.extract(FLAT, g, 1.0, random.Random(seed))
        assert d.encode_claims(x.triples, g) == list(x.ids) and len(x.triples) <= 2


def test_empty_targets_and_reserved_names():
    g = d.claim_grammar(["r"], [], enc, END, sentinels=["S"])
    assert d.extract(FLAT, g, 1.0, random.Random(1)).triples == ()
    for bad in (dict(relations=[]), dict(relations=["NONE"]), dict(targets=["a ; b"]), dict(targets=[" "]), dict(most=0)):
        with pytest.raises(ValueError):
            d.claim_grammar(**({"relations": ["r"], "targets": ["t"], "encode": enc, "end": END} | bad))
    with pytest.raises(ValueError):
        d.claim_grammar(["r"], ["t", "tt"], lambda s: enc(s.replace(" ;", "t")), END)


def test_scores():
    g = d.claim_grammar(["a", "b"], ["T"], enc, END, sentinels=["Z"])
    whole = lambda done, allowed: ([0.0] * len(allowed), math.log(len(allowed) * 2))
    x = d.extract(whole, g, 1.0, random.Random(3))
    assert x.agreement == pytest.approx(0.5) and x.min_agreement == pytest.approx(0.5)
    assert d.extract(FLAT, g).agreement is None
    assert d.sentinel_logprob(FLAT, g, "Z") == pytest.approx(math.log(1 / 4))
    y = d.extract(FLAT, d.claim_grammar(["a"], [], enc, END))
    assert (y.n_choices, y.confidence) == (0, 1.0)


def test_labels_cut_the_prompt_on_the_left():
    assert d.completion_labels([1, 2, 3], [8, 9], 4) == ([2, 3, 8, 9], [-100, -100, 8, 9])


def test_table(spark):
    chunks = spark.createDataFrame([("k1", " supplier :: Acme"), ("k2", None)], "key string, prompt string")
    def scorer_of():
        from loomgraph.operators.decoding import NONE

        def scorer(prompt):
            ids = [ord(c) for c in (prompt or f" {NONE}")] + [0]
            return lambda done, allowed: [5.0 if len(done) < len(ids) and t == ids[len(done)] else 0.0 for t in allowed]

        return scorer

    def grammar_of():
        from loomgraph.operators.decoding import claim_grammar

        return claim_grammar(["supplier"], ["Acme"], lambda s: [ord(c) for c in s], 0)

    got = {r.key: [tuple(t) for t in r.triples] for r in d.decode_table(chunks, scorer_of, grammar_of).collect()}
    assert got == {"k1": [("supplier", "Acme")], "k2": []}
