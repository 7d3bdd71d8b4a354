import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import cutoffs, languages, leaks, mixing, names, packing, splits, tables
from loomgraph.llm.textkernel import Words


# names ---------------------------------------------------------------------------------------------------------------
def clusters(spark, *values):
    df = spark.createDataFrame([(v, "x", "y") for v in values], "name string, cluster string, node string")
    by = {}
    for r in names.linked(df).collect():
        by.setdefault(r.cluster, set()).add(r.name)
    return sorted(map(sorted, by.values()))


def test_company_variants_are_linked(spark):
    same = ["Ducwip Padpad Medical Devices Company", "Ducwip & Padpad Medical Devices, Co.", "Ducwíp Padpad Med Dev Company", "DUCWIP-PADPAD Medical Devices Company", "Medical Devices, Ducwip Padpad Company", "The Ducwpi Padpad Medical Devices", "DucwipPadpad Company"]
    assert clusters(spark, *same) == [sorted(same)]


def test_companies_that_differ_stay_apart(spark):
    apart = ["Mojhug Gocbuz Laboratories GmbH", "Mojhug Gocbuz Resources GmbH", "Bowlec Wuvjic Capital Partners II Ltd.", "Bowlec Wuvjic Capital Partners III Ltd."]
    assert clusters(spark, *apart, "Mojhug Gocbuz GmbH") == sorted([[a] for a in apart] + [["Mojhug Gocbuz GmbH"]])


def test_persons(spark):
    a = ["Alexandra Nacjuhmere", "Nacjuhmere, Alex", "Ms. Alexandra H. Nacjuhmere", "Alexanrda Nacjuhmere", "A. Nacjuhmere"]
    b = ["William Nacjuhmere", "Bill Nacjuhmere"]
    assert clusters(spark, *a, *b) == sorted([sorted(a), sorted(b)])


def test_names_of_nobody(spark):
    assert clusters(spark, None, "", " ", "-", "N/A", "various") == []
    assert clusters(spark) == []
    assert clusters(spark, "X" * 5000, "The", "123", "日本") and clusters(spark, "Acme", "Acme") == [["Acme"]]


def test_jaro_winkler():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.jaro_winkler("", "a") == 0 and names.edits("abcd", "abdc") == 1 and names.edits("kitten", "sitting") == 3


# splits --------------------------------------------------------------------------------------------------------------
def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"f{rng.randrange(60)}", f"c{rng.randrange(90):03}") for _ in range(80)] + [(f"chain{i}", f"x{i + d:03}") for i in range(40) for d in (0, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = {}
    for f, c in edges:
        by.setdefault(f, []).append(c)
        find(c)
    for cs in by.values():
        for c in cs[1:]:
            a, b = sorted((find(cs[0]), find(c)))
            parent[b] = a
    df = spark.createDataFrame([*edges, *edges, (None, "c000"), ("f", None)], "record string, entity string")
    assert {r.entity: r.label for r in splits.components(df).collect()} == {c: find(c) for _, c in edges}
    assert splits.components(df.limit(0)).count() == 0


def test_groups_are_assigned_in_the_shares(spark):
    rng = random.Random(1)
    rows = [(f"g{i}", rng.choice(["a", "b", None]), rng.choice([1, 1, 2, 5, 40])) for i in range(3000)] + [("hot", "a", 3000)]
    df = spark.createDataFrame(rows, "grp string, label string, n long").groupBy("grp", "label").agg(F.sum("n").alias("n"))
    got = {r.grp: r.split for r in splits.assign(df, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()}
    assert set(got) == {r[0] for r in rows}
    total, per = sum(r[2] for r in rows), Counter()
    for g, label, n in rows:
        per[got[g], label] += n
        per[got[g]] += n
    assert per["train"] / total == pytest.approx(0.8, abs=0.01)
    for label in ("a", "b", None):
        own = sum(n for _, x, n in rows if x == label)
        assert per["dev", label] / own == pytest.approx(0.1, abs=0.02)
    small = splits.assign(df.limit(0), {"train": 1.0})
    assert small.count() == 0


def test_hashed_small_groups_keep_the_shares(spark, monkeypatch):
    monkeypatch.setattr(splits, "LARGE", 20)
    df = spark.range(20000).select(F.concat(F.lit("g"), "id").alias("grp"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.lit(1).cast("long").alias("n")).unionByName(spark.createDataFrame([("hot", "a", 10000)], "grp string, label string, n long"))
    got = {r.split: r.n for r in splits.assign(df, {"train": 0.8, "dev": 0.2}).join(df, "grp").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert got["train"] / 30000 == pytest.approx(0.8, abs=0.02)


def test_plain_forms(spark):
    items = {"Item 1": "Item 1", " item_1a ": "Item 1A", "Part II, Item 7": "Item 7", "7A": "Item 7A", "Item 1 - Business": "Item 1", "ITEM 9A.": "Item 9A", "Exhibit 99": None, "Signatures": None, "": None, None: None, "Item  13": "Item 13"}
    df = spark.createDataFrame([(k,) for k in items], "k string")
    assert {r.k: r.v for r in df.select("k", tables.plain_item(F.col("k")).alias("v")).collect()} == items
    f = {"0090000026-13-000023": "009000002613000023", " 0090000026–13–000023 ": "009000002613000023", "N/A": None, "000000000000000000": None, None: None, "123": None}
    df = spark.createDataFrame([(k,) for k in f], "k string")
    assert {r.k: r.v for r in df.select("k", tables.plain_filing(F.col("k")).alias("v")).collect()} == f


# cutoffs -------------------------------------------------------------------------------------------------------------
def brute_cutoff(scores, share):
    for s in sorted(set(scores), reverse=True):
        if sum(x >= s for x in scores) / len(scores) >= share:
            return s, sum(x >= s for x in scores)
    return None, 0


@pytest.mark.parametrize("bins", [2, 1024])
def test_cutoffs_equal_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(cutoffs, "BINS", bins)
    rng = random.Random(bins)
    data = {"a": [rng.random() for _ in range(500)], "b": [rng.choice([0.1, 0.2, 0.3]) for _ in range(99)], "c": [0.5] * 7, "d": [1e-300, 5e-324, 0.0, 1.0], "e": [0.1 + i * 1e-17 for i in range(50)]}
    share = {"a": 0.37, "b": 0.5, "c": 0.2, "d": 0.5, "e": 0.99, "none": 0.5}
    rows = [(s, x, "z") for s, xs in data.items() for x in xs] + [("a", None, ""), ("a", float("nan"), ""), (None, 0.5, ""), ("other", 0.5, "")]
    got = {r.source: r for r in cutoffs.cutoffs(spark.createDataFrame(rows, "source string, score double, cutoff string"), spark.createDataFrame(list(share.items()), "source string, share double")).collect()}
    for s, xs in data.items():
        assert (got[s].cutoff, got[s].kept, got[s].records) == (*brute_cutoff(xs, share[s]), len(xs))
    assert (got["none"].records, got["none"].cutoff, got["none"].kept) == (0, None, 0) and "other" not in got
    odd = spark.createDataFrame([("a", 1.5), ("b", 0.0), ("c", None)], "source string, share double")
    got = {r.source: r.kept for r in cutoffs.cutoffs(spark.createDataFrame(rows, "source string, score double, x string"), odd).collect()}
    assert got["a"] == 0 and got["c"] == 0 and got["b"] == data["b"].count(0.3)
    assert cutoffs.cutoffs(spark.createDataFrame([], "source string, score double"), odd.limit(0)).count() == 0


# mixing --------------------------------------------------------------------------------------------------------------
def brute_seats(cells, size):
    got = {c: min(n, least) for c, (n, _, least) in cells.items()}
    queue = sorted(((r - 0.5) / t, c) for c, (n, t, _) in cells.items() if t > 0 for r in range(got[c] + 1, n + 1))
    for _, c in queue[: max(0, size - sum(got.values()))]:
        got[c] += 1
    return got


def test_seats_equal_the_priorities():
    rng = random.Random(2)
    for _ in range(60):
        cells = {(i,): (rng.choice([0, 1, 5, 50, 700]), rng.choice([0.01, 0.1, 0.3, 0.0]), rng.randrange(6)) for i in range(8)}
        size = rng.choice([0, 3, 40, 300, 5000])
        assert mixing.seats(cells, size) == brute_seats(cells, size)


def test_sample_has_its_seats(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("k"), F.lit(1).alias("h"))
    t = spark.createDataFrame([("x", 0.5, 3), ("y", 0.5, 1), ("z", 0.1, 2)], "k string, target_share double, min_rows int")
    rep = mixing.cell_report(df, t, 0.2, ["k"])
    r = {x.k: x for x in rep.collect()}
    assert (r["x"].seats, r["y"].seats, r["z"].seats) == (300, 300, 0) and r["z"].short and not r["x"].short
    got = mixing.sample(df, rep, ["k"])
    assert {x.k: x["count"] for x in got.groupBy("k").count().collect()} == {"x": 300, "y": 300}
    assert sorted(x.id for x in got.collect()) == sorted(x.id for x in mixing.sample(df.repartition(3), rep, ["k"]).collect())
    assert mixing.cell_report(df.limit(0), t, 0.2, ["k"]).filter("short").count() == 3


# packing -------------------------------------------------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([0, 1, 7, 10, 64, 65, 100, 129, 1000, rng.randrange(1, 128)])) for i in range(2000)]
    df = spark.createDataFrame(items, "id long, tokens long")
    got = packing.pack(df, 128).collect()
    want = Counter({i: max(1, math.ceil(n / 128)) for i, n in items})
    assert Counter(r.id for r in got) == want and sum(r.size for r in got) == sum(n for _, n in items)
    assert all(r.container is None for r in got if r.size == 0)
    fill = Counter()
    for r in got:
        if r.container is not None:
            fill[r.container] += r.size
    assert max(fill.values()) <= 128 and sorted(fill) == list(range(len(fill)))
    # as few containers as first fit by falling size, item by item
    room = []
    for n in sorted((r.size for r in got if r.size), reverse=True):
        at = next((i for i, x in enumerate(room) if x >= n), None)
        if at is None:
            room.append(128 - n)
        else:
            room[at] -= n
    assert len(fill) <= len(room) * 1.005
    assert packing.pack(df.limit(0), 128).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_token_counts(spark):
    import os

    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 1), (3, None, 1), (None, "x", 1)], "doc_id long, text string, tokens int")
    assert {r.id: r.tokens for r in packing.token_counts(df, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0}


# leaks ---------------------------------------------------------------------------------------------------------------
def test_leaks_equal_brute_force(spark):
    import re

    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 13, 40])))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(200):
        w = [rng.choice(vocabulary) for _ in range(80)]
        if i % 4 == 0:
            src = items[rng.randrange(30)][1].split()
            n = rng.choice([12, 13, 20])
            at = rng.randrange(max(1, len(src) - n + 1))
            w[30:30] = src[at : at + n]
        t = " ".join(w)
        docs.append((i, t.upper() if i % 8 == 0 else t.replace("word", "wo­rd") if i % 12 == 4 else t))
    docs += [(500, None), (501, ""), (None, items[2][1]), (502, "\n".join([items[3][1]] * 3000))]
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").replace("­", "").lower())
    want = set()
    for d, t in docs:
        w = norm(t)
        runs = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for i, x in items:
            y = norm(x)
            if d is not None and any(tuple(y[k : k + 13]) in runs for k in range(len(y) - 12)):
                want.add((d, i))
    ddf = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = leaks.leaked(ddf, idf)
    assert {(r.doc_id, r.item_id) for r in found.filter("same_windows > 0").collect()} == want
    assert leaks.leaked(ddf.limit(0), idf).count() == 0 and leaks.leaked(ddf, idf.limit(0)).count() == 0


def test_fingerprints_within_the_radius_are_all_found():
    rng = np.random.default_rng(1)
    text = " ".join(f"t{rng.integers(500)}" for _ in range(400))
    index = leaks.ItemIndex([7], [text])
    prints = index.w.print.copy()
    for k in range(len(prints)):
        for bit in rng.choice(64, leaks.RADIUS, replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    a, b = index.candidates(prints)
    assert set(range(len(prints))) <= {int(x) for x, y in zip(a, b) if x == y}
    brute = {(int(i), int(j)) for i in range(len(prints)) for j in range(len(prints)) if bin(int(prints[i]) ^ int(index.w.print[j])).count("1") <= leaks.RADIUS}
    assert set(zip(a.tolist(), b.tolist())) == brute


# languages -----------------------------------------------------------------------------------------------------------
EN = "the company reported growth in sales and the board approved a new plan for the coming year with care."
DE = "die gesellschaft meldete ein wachstum der verkäufe und der vorstand genehmigte einen neuen plan für das kommende jahr."
SV = "bolaget rapporterade en ökning av försäljningen och styrelsen godkände en ny plan för det kommande året med stor omsorg."


def documents(spark, extra):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (SV, "sv")] * 30)]
    return spark.createDataFrame([(d, t, lang, "x") for d, t, lang in rows + extra], "doc_id long, text string, lang string, label string")


def test_languages(spark):
    extra = [(1000, EN, None), (1001, DE, "en_GB"), (1002, f"{EN} {SV}", "English"), (1003, "", None), (1004, None, None), (1005, "[Reserved]", "und"), (1006, SV, "SV-se"), (1007, "1 2 3 " * 40, "en"), (None, EN, None), (1008, f"{DE}\n" * 2000, "ger"), (1009, EN + " Kommende Jahr. " + EN, "eng")]
    got = languages.languages(documents(spark, extra)).filter("doc_id >= 1000").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.language, r.mixed))
        assert 0.5 < r.confidence <= 1
    assert by == {1000: {("en", False)}, 1001: {("de", False)}, 1002: {("en", True), ("sv", True)}, 1006: {("sv", False)}, 1008: {("de", False)}, 1009: {("en", False)}}
    assert languages.languages(documents(spark, []).limit(0)).count() == 0


def test_labels(spark):
    labels = {"en": "en", "EN": "en", "en_GB": "en", "English": "en", " deu ": "de", "pt-BR": "pt", "xx": None, "mul": None, "": None, None: None, "und": None, "Swedish": "sv"}
    df = spark.createDataFrame([(k,) for k in labels], "k string")
    assert {r.k: r.v for r in df.select("k", languages.plain_language(F.col("k")).alias("v")).collect()} == labels


def test_every_query_runs_and_the_rest_does_not_need_this_package(spark):
    import os
    import subprocess
    import sys

    from loomgraph.llm import queries

    data = "/root/testdata/sf0.001"
    if os.path.isdir(data):
        for name, f in queries.queries().items():
            assert f(spark, data).count() >= 0, name
    code = "import sys; sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('p1_') for k in e.queries()) and e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_member_pairs_of_groups_of_any_size(spark, monkeypatch):
    rows = [("g", f"m{i:02}") for i in range(30)] + [("h", "a"), ("h", "b"), ("i", "alone")]
    df = spark.createDataFrame(rows, "grp string, m string")
    every = {(a, b) for k in "ghi" for a, b in combinations(sorted(m for g, m in rows if g == k), 2)}
    monkeypatch.setattr(splits, "PART", 7)
    assert {tuple(r) for r in splits.member_pairs(df, "grp", "m", "x", "y").collect()} == every
    monkeypatch.setattr(splits, "PAIRS", 10)
    assert {tuple(r) for r in splits.member_pairs(df, "grp", "m", "x", "y").collect()} == {("m00", f"m{i:02}") for i in range(1, 30)} | {("a", "b")}


def test_p3_found_gives_all_pairs_at_any_size(spark, monkeypatch):
    rows = [(f"f{i}", f"c{j:02}") for i in range(29) for j in (i, i + 1)] + [("x", "d1"), ("x", "d2")]
    monkeypatch.setattr(splits, "_ties", lambda *_: spark.createDataFrame(rows, "record string, entity string"))
    monkeypatch.setattr(splits, "PAIRS", 10)
    monkeypatch.setattr(splits, "PART", 7)
    got = [tuple(r) for r in splits.p3_found(spark, "").collect()]
    assert len(got) == len(set(got)) and set(got) == {*combinations([f"c{i:02}" for i in range(30)], 2), ("d1", "d2")}


def test_a_foreign_run_inside_a_sentence_without_stops():
    words = {0: [f"en{i}" for i in range(40)], 1: [f"de{i}" for i in range(40)]}
    slots = np.zeros(languages.SLOTS, languages.MASK)
    for k, w in words.items():
        for s in languages._slots(Words([" ".join(w)]).hash):
            slots[s] |= languages.MASK(1 << k)
    text = " ".join([*words[0][:30], *words[1][:20], *words[0][:30]])
    of, first, size, worded, lang, share = languages.Detector(slots).segments([text])
    assert lang.tolist() == [0, 1, 0] and size.sum() == 80 and abs(size[1] - 20) <= 6
