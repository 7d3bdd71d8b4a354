"""Names whose words stand in none of the module's tables."""

import random
from itertools import combinations

from loomgraph.llm import names

LINES = {"Biotechnology": ["Biotech"], "Refrigeration": ["Refrig"], "Plastics": ["Plast", "Plastic"], "Textiles": ["Txtls"], "Robotics": ["Robot"], "Minerals": ["Min", "Mineral"], "Furniture": ["Furn"], "Automotive": ["Auto"]}
GIVEN = {"Ronald": ["Ron", "Ronnie"], "Philip": ["Phil"], "Gerald": ["Gerry"], "Raymond": ["Ray"], "Walter": ["Walt"], "Russell": ["Russ"], "Eugene": ["Gene"], "Roland": [], "Philippa": [], "Geraldine": []}
FORMS = ["SARL", "Oy", "KK", "Pty", "Inc", "Ltd"]
PARTS = ["bra", "cle", "dor", "fen", "gra", "hol", "kar", "lin", "mor", "nes", "pol", "rus", "sta", "tor", "val", "wen", "zan", "mil", "ber", "sol"]


def world(seed, n):
    r = random.Random(seed)
    families = list({"".join(r.choice(PARTS) for _ in range(3)).capitalize() for _ in range(3 * n)})
    of: dict[str, set] = {}

    def typo(w):
        at = r.randrange(1, len(w) - 2)
        return w[:at] + w[at + 1] + w[at] + w[at + 2 :]

    for _ in range(n):
        a, b = r.sample(families, 2)
        line, form = r.choice(list(LINES)), r.choice(FORMS)
        spelled = [f"{a} {b} {line} {form}"] + [f"{a} {b} {r.choice(LINES[line])} {form}"] * (r.random() < 0.5) + [f"{typo(a)} {b} {line} {form}"] * (r.random() < 0.3) + [f"{a} {b} {line}, {form}.".upper()] * (r.random() < 0.3)
        for s in spelled:
            of.setdefault(s, set()).add((a, b, line))
        if r.random() < 0.3:
            other = r.choice([x for x in LINES if x != line])
            of.setdefault(f"{a} {b} {other} {form}", set()).add((a, b, other))
    for _ in range(n):
        s, g = r.choice(families), r.choice(list(GIVEN))
        spelled = [f"{g} {s}"] + [f"{r.choice(GIVEN[g] or [g])} {s}"] * (r.random() < 0.7) + [f"{s}, {g}"] * (r.random() < 0.4) + [f"{g} {r.choice('ABCDEFGH')}. {s}"] * (r.random() < 0.3)
        for x in spelled:
            of.setdefault(x, set()).add((g, s))
        if r.random() < 0.4:
            other = r.choice([x for x in GIVEN if x != g])
            of.setdefault(f"{other} {s}", set()).add((other, s))
    return {k: next(iter(v)) for k, v in of.items() if len(v) == 1}


def test_words_of_no_table_are_learned(spark):
    entity = world(5, 350)
    assert not {w.lower() for w in [*LINES, *GIVEN]} & ({*names.LINES} | {*names.NICKNAMES})
    cluster = {r.name: r.cluster for r in names.linked(spark.createDataFrame([(x,) for x in entity], "name string")).collect()}

    def together(key):
        groups: dict = {}
        for n in entity:
            groups.setdefault(key(n), []).append(n)
        return {tuple(sorted(p)) for v in groups.values() for p in combinations(v, 2)}

    want, got = together(lambda n: entity[n]), together(lambda n: cluster[n])
    assert len(want) > 800
    assert len(want & got) >= 0.9 * len(want)
    assert len(want & got) >= 0.97 * len(got)


def test_learned_parts():
    lexicon = names.Lexicon(frozenset({"sarl"}), {"biotech": "biotechnology", "biotechnology": "biotechnology"}, {"philip": ("philip",), "phil": ("philip",)})
    assert names.parse("Helix Biotech SARL", lexicon) == names.parse("HELIX, Biotechnology Sarl.", lexicon)
    assert names.parse("Phil Jones", lexicon) == names.parse("Jones, Philip", lexicon)
    assert names.parse("Phil Jones", lexicon)[0] == "p" and names.parse("Phil Jones")[0] == "c"


def test_short_forms():
    for a, b in [("gerry", "gerald"), ("ronnie", "ronald"), ("gene", "eugene"), ("mfg", "manufacturing"), ("biotech", "biotechnology")]:
        assert names.short_for(a, b)
    for a, b in [("roland", "ronald"), ("gerald", "gerry"), ("ab", "abraham"), ("line", "gasoline2x")]:
        assert not names.short_for(a, b)


def test_large_blocks_are_split_and_whole(spark, monkeypatch):
    rows = [(f"Sam{x} Smithe",) for x in "abcdefghijklmnop"] + [("Zed Holdings Inc",), ("Zed Hldgs Inc",), (None,), ("",), ("Zed Holdings",)]
    df = spark.createDataFrame(rows * 2, "name string")
    want = {tuple(r) for r in names.linked(df).collect()}
    monkeypatch.setattr(names, "HOT", 3)
    assert {tuple(r) for r in names.linked(df).collect()} == want
    by = dict(want)
    assert by["Zed Holdings Inc"] == by["Zed Hldgs Inc"] == by["Zed Holdings"]


def test_no_names(spark):
    assert names.linked(spark.createDataFrame([], "name string")).collect() == []
    assert names.linked(spark.createDataFrame([(None,), ("",), ("n/a",)], "name string")).collect() == []
