import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text

TEXT = "We rely on Taiwan Semiconductor Manufacturing Company for wafer fabrication. We compete directly with Intel Corporation and NVIDIA."


def col(spark, *values, names="abcdef"):
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names[: len(values)]))


@pytest.mark.parametrize("target, span", [("Intel Corporation", "Intel Corporation"), ("NVIDIA Corp", "NVIDIA"), ("intel", "Intel"), ("Broadcom", None), ("", None)])
def test_grounding(spark, target, span):
    s = col(spark, target, TEXT).select(text.ground_span(F.col("a"), F.col("b")).alias("s")).first().s
    assert (None if s is None else TEXT[s.start : s.end]) == span


def test_grounding_counts_code_points_and_aliases(spark):
    s = col(spark, "Intel", "😀 Intel").select(text.ground_span(F.col("a"), F.col("b")).alias("s")).first().s
    assert (s.start, s.end) == (2, 7)
    a = col(spark, "Team Blue", TEXT).select(text.ground_span(F.col("a"), F.col("b"), F.array(F.lit("None such"), F.lit("Intel"))).alias("s")).first().s
    assert TEXT[a.start : a.end] == "Intel"


def test_names(spark):
    names = ["NVIDIA Corp.", "Company", "Inc Corp", "  A  B,Holdings Group", "Nestlé S.A.", "", None]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = df.select(text.normalize_name(F.col("a")).alias("n"), text.core_name(F.col("a")).alias("c")).collect()
    for n, r in zip(names, got):
        if n is None:
            assert r.n is None
            continue
        norm = re.sub(r"[^a-z0-9 ]+", " ", n.lower()).strip()
        words = norm.split()
        while len(words) > 1 and words[-1] in text.SUFFIXES:
            words.pop()
        assert r.n == norm and r.c == " ".join(words)


def spans(spark, t, filer=None, people=()):
    df = spark.createDataFrame([(t, filer)], "t string, f string")
    return df.select(text.candidate_spans(F.col("t"), F.col("f"), people).alias("s")).first().s


def test_candidate_spans(spark):
    got = spans(spark, "The Company sells to Bank of America and to Intel. We See IBM, Intel; John Doe of Acme Corp likes Acme Corp, Inc. Risk Factors. An", "Acme Corp, Inc.", ["John Doe"])
    assert got == ["Bank of America", "Intel", "IBM", "John Doe of Acme Corp"] or got[:3] == ["Bank of America", "Intel", "We See IBM"]
    assert spans(spark, None) == [] and spans(spark, "") == []
    assert len(spans(spark, " x ".join(f"Name{i}" for i in range(100)))) == 64
    assert spans(spark, "Advanced Micro Devices makes chips", "Advanced Micro Devices, Inc.") == []


def test_match_candidate_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([("NVIDIA Corp", ["NVIDIA Corporation", "Nvidia-Corporation", "Intel"])], "t string, c array<string>")
    assert df.select(text.match_candidate(F.col("t"), F.col("c")).alias("m")).first().m == "Nvidia-Corporation"
    assert df.select(text.match_candidate(F.lit("AMD"), F.col("c")).alias("m")).first().m is None


@pytest.mark.parametrize(
    "body, filer, want",
    [
        ("We sell to us and the US.", "Gap Inc.", "[F]We[/F] sell to [F]us[/F] and the US."),
        # the full name ends in a dot, after which no word boundary follows, so its core is what is marked
        ("The gap of Gap Inc. and Gap", "Gap Inc.", "The gap of [F]Gap[/F] Inc. and [F]Gap[/F]"),
        ("The gap of Gap Inc. and Gap", "Gap Inc", "The gap of [F]Gap Inc[/F]. and [F]Gap[/F]"),
        ("the Company buys", None, "[F]the Company[/F] buys"),
        ("nothing here", "XY", "nothing here"),
        ("", "Acme", ""),
        (None, "Acme", None),
    ],
)
def test_markers(spark, body, filer, want):
    df = spark.createDataFrame([(body, filer)], "t string, f string")
    assert df.select(text.mark_filer_mentions(F.col("t"), F.col("f")).alias("m")).first().m == want


def test_party(spark):
    df = spark.createDataFrame([("Sales to us grew",), ("The registrant",), ("bus stop",), (None,), ("",)], "t string")
    assert [r.p for r in df.select(text.filer_is_party(F.col("t")).alias("p")).collect()] == [True, True, False, False, False]


def test_rendering(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.verbalize(F.lit("company:Acme"), F.array(F.lit("competitor_of"), F.lit("customer_of")))) == "who are the suppliers of competitors of Acme?"
    assert get(text.verbalize(F.lit("Ann"), F.array(F.lit("officer_of")))) == "who are the companies led by Ann?"
    assert [get(text.confidence_bucket(F.lit(x).cast("double"))) for x in (0.0, 0.39, 1.0, 7.0, None)] == ["0.0", "0.3", "1.0", "1.0", "unknown"]
    path = lambda *n: F.struct(F.lit(None).cast("string").alias("root"), F.array(*[F.struct(F.lit(a).alias("head"), F.lit("r").alias("relation"), F.lit(b).alias("tail")) for a, b in zip(n, n[1:])]).alias("triples"))
    assert get(text.chain(path("a", "b", "c"))) == "a -[r]-> b -[r]-> c"
    many = F.array(*[path("a", f"b{i}") for i in range(10)])
    assert get(text.serialize_state(F.lit("q"), F.lit(1), many)).endswith("a -[r]-> b7 | ... (+2 more)")
    assert get(text.verbalize_paths(F.array(path("a", "b")))) == "- a -[r]-> b"
    answers = text.reader_answers(F.lit("Paris., unknown\nparis; Rome"), F.array(F.lit("paris"), F.lit("ROME")), F.array(F.lit("t")))
    assert get(answers) == ["paris", "ROME"]
    assert get(text.reader_answers(F.lit("none"), F.array(F.lit("x")), F.array(F.lit("t"), F.lit("t")))) == ["t"]
    prompt = get(text.controller_prompt(F.lit("S"), F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: i.cast("string"))))
    assert prompt.endswith("- 64\n- ... (+6 more)\n- [STOP]\nnext:")
