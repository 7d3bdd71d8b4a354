import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import alike, near
from loomgraph.llm.textkernel import Words, blocks, plain

WORDS = [f"w{i}" for i in range(400)]


def shingles(t, n=3):
    import re

    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def brute(rows, like):
    got = set()
    g = [(k, *shingles(t, like.words)) for k, t in rows if k is not None and t is not None]
    for i, (a, x, n) in enumerate(g):
        for b, y, m in g[i + 1 :]:
            if a != b and min(n, m) >= like.min_words and x | y and len(x & y) / len(x | y) >= like.threshold:
                got.add((min(a, b), max(a, b)))
    return got


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(WORDS) for _ in range(60))
        rows.append((f"c{i}", t))
        if i % 3 == 0:
            w = t.split()
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((f"d{i}", " ".join(w)))
        if i % 7 == 0:
            rows.append((f"e{i}", t))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "key string, text string, c string, n int, side string")


def pairs(spark, rows, like=near.CHUNKS):
    return {tuple(r) for r in near.near_pairs(frame(spark, rows), "key", "text", like).collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    assert pairs(spark, rows) == brute(rows, near.CHUNKS)
    assert pairs(spark, rows * 2) == brute(rows, near.CHUNKS)
    five = alike.Likeness()
    assert pairs(spark, rows, five) == brute(rows, five)


def test_boilerplate_does_not_hide_or_make_links(spark):
    rng = random.Random(4)
    head = " ".join(rng.choice(WORDS) for _ in range(50))
    rows = [(f"b{i}", head + " " + " ".join(rng.choice(WORDS) for _ in range(70))) for i in range(400)]
    rows += [(f"z{i}", rows[i][1] + " and a little more") for i in range(40)]
    assert pairs(spark, rows) == brute(rows, near.CHUNKS)


def test_near_copies_that_are_all_frequent_are_linked(spark):
    base = " ".join(WORDS[:40])
    rows = [(f"k{i:03}", f"{base} tail{i}") for i in range(300)]
    assert len(pairs(spark, rows)) == 300 * 299 // 2


def near_copies(seed, n, changed, words=143):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randrange(*changed)):
            w[at] = f"x{i}y{at}"
        rows.append((f"k{i:03}", " ".join(w)))
    return rows


def test_many_near_copies_of_one_text_equal_brute_force(spark):
    rows = near_copies(7, 300, (5, 16)) + corpus(8, 120)
    want = brute(rows, near.CHUNKS)
    assert len(want) > 10_000
    assert pairs(spark, rows) == want


def test_near_copies_beside_many_other_texts(spark):
    # the copies' shingles are not frequent here
    rows = near_copies(11, 40, (5, 13)) + [(f"o{i}", " ".join(f"o{i}w{j}" for j in range(30))) for i in range(4000)]
    assert pairs(spark, rows) == brute(rows[:40], near.CHUNKS)


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(alike, "LONG", 20)
    rows = near_copies(9, 120, (5, 12)) + corpus(10, 90)
    found, _ = near.similar_texts(frame(spark, rows), "key", "text")
    got = found.filter("ca != cb").select("ca", "cb").collect()
    assert len(got) == len(set(got)) and pairs(spark, rows) == brute(rows, near.CHUNKS)


@pytest.mark.parametrize("like", [alike.Likeness(words=1, threshold=0.5), alike.Likeness(words=2, threshold=0.7), alike.Likeness()])
def test_short_texts_are_found_exactly(spark, like):
    rng = random.Random(3)
    rows = [(f"s{i}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    assert pairs(spark, rows, like) == {p for p in brute(rows, like)}


def test_odd_rows(spark):
    long = " ".join(WORDS * 500)
    rows = [(None, "x " * 30), ("a", None), ("b", ""), ("c", "too short"), ("d", "too short"), ("e", long), ("f", long), ("g", long + " end"), ("e", long)]
    assert pairs(spark, rows) == {("e", "f"), ("e", "g"), ("f", "g")}
    assert pairs(spark, []) == set()
    twenty = " ".join(WORDS[:20])
    assert pairs(spark, [("a", twenty), ("b", twenty.upper()), ("c", " ".join(WORDS[:19]))]) == {("a", "b")}


def test_large_copy_groups_are_given_by_their_least_key(spark):
    t = " ".join(WORDS[:30])
    rows = [(f"k{i:03}", t) for i in range(100)] + [("z", t + " one more")]
    got = pairs(spark, rows)
    assert got == {("k000", f"k{i:03}") for i in range(1, 100)} | {("k000", "z")}


def test_cross_split(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for i in range(80):
        t = " ".join(rng.choice(WORDS) for _ in range(50))
        split = rng.choice(["train", "dev", "test"])
        rows.append(("t1", f"a{i}", split, t))
        if i % 2:
            other = rng.choice(["train", "test"])
            rows.append(("t1", f"b{i}", other, t + " extra" if i % 4 == 1 else t))
            if (split == "train") != (other == "train"):
                want.add((f"a{i}", f"b{i}"))
        rows.append(("t2", f"a{i}", "train", t))
    rows += [("t1", "n", None, rows[0][3]), ("t1", None, "train", rows[0][3]), ("t1", "o", "train", None)]
    df = spark.createDataFrame(rows, "record_table string, key string, split string, text string")
    found, members = near.cross_split_links(df)
    m = members.select("record_table", "c", "key", "split")
    e = m.filter("split != 'train'").select(F.col("c").alias("ca"), F.col("key").alias("x"))
    t = m.filter("split = 'train'").select(F.col("c").alias("cb"), F.col("key").alias("y"))
    got = {(min(r.x, r.y), max(r.x, r.y)) for r in found.join(e, "ca").join(t, "cb").collect()}
    assert got == want


def test_words_equal_a_plain_tokenizer():
    import re

    texts = ["Ab c-d_e 12", "", None, "ÄÖ ß Ünïcode 日本語 x", "a" * 5000 + " b", "İstanbul", "\n\n"]
    for part in (texts, texts[:3], ["plain ascii only"]):
        w = Words(part)
        for i, t in enumerate(part):
            want = re.findall(r"[^\W_]+", (t or "").lower())
            assert w.first[i + 1] - w.first[i] == len(want)
    one, two = Words(["x Zürich y"]).hash[1], Words(["日本 zürich"]).hash[1]
    assert one == two and Words(["ascii word"]).hash[1] == Words(["日 WORD"]).hash[1]
    assert plain("ﬁne­ly x​y ２") == "finely xy 2"
    assert list(blocks(["ab", None, "c"], chars=2, count=9)) == [(0, 1), (1, 3)] or list(blocks([])) == []


@pytest.mark.parametrize("name", ["p4_found", "p2_found"])
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    from loomgraph.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    df = queries.queries()[name](spark, data)
    assert {tuple(r) for r in df.collect()} == set(c.execute(queries.oracle_sql()[name]).fetchall())


def test_report_counts_every_record_of_large_classes(spark):
    t = " ".join(WORDS[:30])
    rows = [("t1", f"e{i:03}", "dev" if i % 2 else "test", t) for i in range(100)] + [("t1", f"t{i:03}", "train", t) for i in range(80)] + [("t1", "near", "train", t + " one more")]
    rows += [("t1", "both", "train", t), ("t1", "both", "dev", t), ("t1", "alone", "dev", " ".join(WORDS[100:130]))]
    got = {(r.key, r.split): r.train_records for r in near.overlaps(spark.createDataFrame(rows, "record_table string, key string, split string, text string")).collect()}
    assert got == {(f"e{i:03}", "dev" if i % 2 else "test"): 82 for i in range(100)} | {("both", "dev"): 81}


def test_cross_split_gives_every_record_of_large_classes(spark):
    t = " ".join(WORDS[:30])
    rows = [("t1", f"e{i:03}", "dev", t) for i in range(100)] + [("t1", f"t{i:03}", "train", t) for i in range(80)]
    rows += [("t1", "near", "train", t + " one more"), ("t2", "u", "train", t)]
    got = near.cross_split_pairs(spark.createDataFrame(rows, "record_table string, key string, split string, text string"))
    pairs_ = {(r.eval_key, r.train_key) for r in got.collect()}
    assert {e for e, _ in pairs_} == {f"e{i:03}" for i in range(100)} and {t for _, t in pairs_} == {f"t{i:03}" for i in range(80)} | {"near"}
    assert ("e000", "near") in pairs_ and ("e000", "t000") in pairs_ and len(pairs_) < 300


def test_cross_split_gives_small_classes_in_full(spark):
    t = " ".join(WORDS[:30])
    rows = [("t1", f"e{i}", "dev", t) for i in range(5)] + [("t1", f"t{i}", "train", t) for i in range(7)] + [("t1", "near", "train", t + " one more")]
    got = near.cross_split_pairs(spark.createDataFrame(rows, "record_table string, key string, split string, text string"))
    assert {(r.eval_key, r.train_key) for r in got.collect()} == {(f"e{i}", k) for i in range(5) for k in [f"t{j}" for j in range(7)] + ["near"]}
