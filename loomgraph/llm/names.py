"""Problem 1: variant spellings of names typed by people.

A name is parsed into what names consist of: family words, line of business, number, legal form for organisations; surname,
given name and initials for persons. Names that parse to the same parts are one node. Nodes are blocked by the phonetic codes
of their sorted words (and by keys that survive the typing errors which change a code: one word together with the first or last letter of the
other, the words' first and last letters, the sorted letters), compared by Jaro-Winkler similarity of the words and the nickname table, and accepted pairs are
clustered by connected components.

Line of business, number, legal form and given name must agree. A name that leaves one of them out, or gives an initial, is
linked with the one fuller name it can stand for; if it can stand for several different ones, with none of them.

What is a line of business, a legal form or a given name, and which of them is short for which, is partly public knowledge
(the tables below, a parameter) and for the rest learned from all names at hand (``learn``): a word that comes last or next to last beside
many different words is a line or form, one that comes first beside many surnames and never in a company's name is a given name, and one is short for
another if it begins or abridges it and stands beside the same words.

Nulls, empty strings and placeholders name nobody. Names are compared without case, accents, punctuation and titles.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ship import ship
from .splits import components, member_pairs
from .tables import table

SIMILAR = 0.80
SIMILAR_MEAN = 0.90

# fixed values: usual words of names -------------------------------------------------------------------------------
PLACEHOLDERS = {"", "-", "--", "n a", "na", "none", "null", "nil", "unknown", "various", "other", "others", "tbd", "not applicable", "not available", "not disclosed", "undisclosed", "unnamed", "confidential"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "esq", "phd", "md", "jr", "sr", "mba", "cpa"}
JOINERS = {"the", "and", "of", "et", "und"}
LEGAL = {
    "company": ["company", "co"],
    "corporation": ["corporation", "corp"],
    "incorporated": ["incorporated", "inc"],
    "limited": ["limited", "ltd"],
    "llc": ["llc"],
    "llp": ["llp"],
    "lp": ["lp"],
    "plc": ["plc"],
    "gmbh": ["gmbh", "mbh", "gesellschaft"],
    "ag": ["ag"],
    "sa": ["sa"],
    "nv": ["nv"],
    "bv": ["bv"],
    "spa": ["spa"],
    "ab": ["ab"],
}
LINES = {
    "aerospace": ["aero"],
    "capital": ["cap"],
    "chemicals": ["chem", "chems", "chemical"],
    "communications": ["comm", "comms", "communication"],
    "devices": ["dev", "devs", "device"],
    "electronics": ["elec", "electr", "electronic"],
    "energy": ["enrgy", "ener", "nrg"],
    "engineering": ["eng", "engr", "engrg", "engg"],
    "foods": ["fds", "food", "fd"],
    "holdings": ["hldg", "hldgs", "holding"],
    "industries": ["ind", "inds", "indus", "industry"],
    "instruments": ["instr", "instrs", "inst", "instrument"],
    "insurance": ["ins", "insur"],
    "international": ["int", "intl", "internat"],
    "laboratories": ["lab", "labs", "laboratory"],
    "logistics": ["log", "logist", "logistic"],
    "manufacturing": ["mfg", "manuf", "mfrg"],
    "medical": ["med", "medic"],
    "packaging": ["pkg", "pack", "packg"],
    "partners": ["ptnr", "ptnrs", "ptrs", "partner"],
    "pharmaceuticals": ["pharm", "pharma", "pharms", "pharmaceutical"],
    "resources": ["res", "resource", "rsrcs"],
    "semiconductor": ["semi", "semicond", "semis", "semiconductors"],
    "services": ["serv", "servs", "svc", "svcs", "service"],
    "systems": ["sys", "syst", "systs", "system"],
    "technologies": ["tech", "techs", "technology"],
    "group": ["grp"],
    "solutions": ["sol", "solns"],
    "ventures": ["vent"],
}
NICKNAMES = {
    "alexander": ["alex", "sandy", "alec", "sasha"],
    "alexandra": ["alex", "sandra", "lexi", "sandy", "sasha"],
    "charles": ["charlie", "chuck", "chas"],
    "edward": ["ed", "eddie", "ted", "ned", "teddy"],
    "elizabeth": ["beth", "liz", "betty", "eliza", "lizzie"],
    "frederick": ["fred", "freddie", "freddy"],
    "gabriela": ["gaby", "gabby", "gabi"],
    "henrietta": ["hettie", "etta", "hetty"],
    "jonathan": ["jon", "jonny", "john"],
    "katherine": ["kathy", "kate", "katie", "kat", "kathie"],
    "leonard": ["len", "lenny", "leo"],
    "margaret": ["maggie", "meg", "peggy", "marge", "greta"],
    "nicholas": ["nick", "nicky"],
    "oswald": ["ozzie", "oz", "os"],
    "patricia": ["pat", "patty", "trish", "tricia"],
    "patrick": ["pat", "paddy"],
    "richard": ["rick", "dick", "rich", "richie", "ricky"],
    "robert": ["bob", "rob", "bobby", "robbie"],
    "susannah": ["sue", "susie", "suzy", "susan"],
    "theodore": ["theo", "ted", "teddy"],
    "victoria": ["vicky", "vicki", "tori"],
    "william": ["bill", "will", "billy", "willy", "liam"],
    "james": ["jim", "jimmy", "jamie"],
    "joseph": ["joe", "joey"],
    "michael": ["mike", "mick", "mickey"],
    "thomas": ["tom", "tommy"],
    "anthony": ["tony"],
    "benjamin": ["ben", "benny"],
    "christopher": ["chris", "kit"],
    "daniel": ["dan", "danny"],
    "david": ["dave", "davy"],
    "deborah": ["deb", "debbie"],
    "dorothy": ["dot", "dottie", "dolly"],
    "gregory": ["greg"],
    "jennifer": ["jen", "jenny"],
    "matthew": ["matt"],
    "samuel": ["sam", "sammy"],
    "samantha": ["sam", "sammy"],
    "stephen": ["steve"],
    "timothy": ["tim", "timmy"],
}
# -------------------------------------------------------------------------------------------------------------------
_LEGAL = {x: k for k, v in LEGAL.items() for x in v}
_LINE = {x: k for k, v in LINES.items() for x in [k, *v]}
_GIVEN: dict[str, set[str]] = {}
for _k, _v in NICKNAMES.items():
    for _x in [_k, *_v]:
        _GIVEN.setdefault(_x, set()).add(_k)
_NUMBER = re.compile(r"(?=[ivx])(x{0,3})(ix|iv|v?i{0,3})")
_SOUND = {c: d for d, s in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in s}


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn one word into the other."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def close(a: str, b: str, most: int) -> float:
    """Jaro-Winkler similarity; 0 for a weak one of words that differ by more than ``most`` edits."""
    s = jaro_winkler(a, b)
    return s if s >= 0.88 or (s >= SIMILAR and edits(a, b) <= most) else 0.0


def phonetic(word: str) -> str:
    """First letter and the classes of the other consonants, equal neighbours once."""
    out = [word[:1]]
    last = _SOUND.get(word[:1])
    for c in word[1:]:
        d = _SOUND.get(c)
        if d and d != last:
            out.append(str(d))
        last = d or last
    return "".join(out)


def words_of(name: str) -> list[str]:
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z])", " ", s).lower()
    s = re.sub(r"(?<=\w)['’](?=\w)", "", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", "") if m.group().replace(".", "") in _LEGAL or m.group().replace(".", "") in TITLES else m.group(), s)
    return re.findall(r"[a-z0-9]+", s)


#: different words beside a word that make it a line of business or legal form; a given name. The larger of the number and the share of all names
LINE_BESIDE, GIVEN_BESIDE = (20, 1 / 2000), (8, 1 / 5000)
#: share of a short form's neighbours that the long form must have too, and how many at least
SHARED, SHARED_LEAST = 0.25, 3
#: rows of a block that one task compares at most
HOT = 1_000


@dataclass(frozen=True)
class Lexicon:
    """Learned legal forms, lines of business with their full forms, and given names with the names they may stand for."""

    legal: frozenset = frozenset()
    line: dict = field(default_factory=dict)
    given: dict = field(default_factory=dict)


def _known_given(word: str, lexicon: Lexicon) -> tuple[frozenset, bool]:
    """The given names that a word may stand for, and whether it is one as written."""
    if word in _GIVEN:
        return frozenset(_GIVEN[word]), True
    if word in lexicon.given:
        return frozenset(lexicon.given[word]), True
    if len(word) < 5:
        return frozenset(), False
    close = [(jaro_winkler(word, g), g) for names in (NICKNAMES, lexicon.given) for g in names if abs(len(g) - len(word)) <= 2 and len(g) >= 5]
    best = max(close, default=(0, ""))
    return (frozenset(lexicon.given.get(best[1], {best[1]})) if best[0] >= 0.89 else frozenset()), False


class Parser:
    """Splits names into parts by the tables and a learned lexicon."""

    def __init__(self, lexicon: Lexicon | None = None):
        self.lexicon = lexicon or Lexicon()
        self._given = lru_cache(1 << 18)(lambda w: _known_given(w, self.lexicon))

    def parse(self, name: str | None) -> tuple | None:
        """``(kind, words, line, number, legal, given, initials)``, None if the name names nobody."""
        if name is None:
            return None
        words = words_of(name)
        if " ".join(words) in PLACEHOLDERS:
            return None
        titled = any(w in TITLES for w in words)
        words = [w for w in words if w not in TITLES and w not in JOINERS]
        forms = lambda w: _LEGAL.get(w) or (w if w in self.lexicon.legal else None)
        trade = lambda w: _LINE.get(w) or self.lexicon.line.get(w)
        legal = sorted({forms(w) for w in words if forms(w)})
        rest = [w for w in words if not forms(w)]
        line = sorted({trade(w) for w in rest if trade(w)})
        own = [w for w in rest if not trade(w)]
        number = next((w for w in own if w.isdigit() or (_NUMBER.fullmatch(w) and len(w) <= 4)), None) if line or legal else None
        if number:
            own.remove(number)
        initials = "".join(w for w in own if len(w) == 1)
        own = [w for w in own if len(w) > 1]
        if not own:
            own = [w for w in rest if len(w) > 1] or rest or words
            line = []
        if not legal and not line:
            given = [(w, *self._given(w)) for w in own]
            known = [x for x in given if x[1]]
            if known and len(own) >= 2:
                first = ([x for x in known if x[2]] or known)[0]
                return "p", sorted(w for w in own if w != first[0]), None, None, None, sorted(first[1]), initials
            if len(own) == 1 and initials or titled and len(own) == 1:
                return "p", own, None, None, None, [], initials
        return "c", sorted(own), " ".join(line) or None, number, " ".join(legal) or None, [], initials


def parse(name: str | None, lexicon: Lexicon | None = None) -> tuple | None:
    return Parser(lexicon).parse(name)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a name that no table has: the word, its place, whether the name is a company's, and the words beside it."""
    for batch in batches:
        out = []
        for name in batch.column(0).to_pylist():
            words = [w for w in words_of(name) if w not in TITLES and w not in JOINERS]
            company = any(w in _LEGAL or w in _LINE for w in words)
            own = [w for w in words if len(w) > 1 and w not in _LEGAL and not w.isdigit() and not _NUMBER.fullmatch(w)]
            turned = not company and "," in name and len(own) == 2
            named = [w for w in own if w not in _LINE]
            for i, w in enumerate(own[::-1] if turned else own):
                if w not in _LINE and len(own) > 1:
                    out.append((w, i == 0, i + 2 >= len(own) and len(own) > 2, i + 1 == len(own), company, len(own), " ".join(sorted(x for x in named if x != w))))
        cols = list(zip(*out)) if out else [()] * 7
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "first", "late", "last", "company", "words", "beside"])


def short_for(a: str, b: str) -> bool:
    """Whether ``a`` may be short for ``b``: its beginning (also with an ending in y or ie), its end, or some of its letters in order."""
    stem = a[:-2] if a.endswith("ie") else a[:-1] if a.endswith("y") else a
    stem = stem[:-1] if len(stem) > 3 and stem[-1] == stem[-2] else stem
    if len(stem) >= len(b) or len(a) < 3:
        return False
    if b.startswith(a) or (len(stem) >= 3 and b.startswith(stem)) or (4 <= len(a) < len(b) and b.endswith(a)):
        return True
    at = iter(b)
    return len(a) < len(b) and len(a) <= 5 and a[0] == b[0] and all(c in at for c in a) and sum(c in "aeiou" for c in a) <= 1


def learn(names: DataFrame) -> Lexicon:
    """A lexicon of the distinct names of the column ``name``.

    Only words beside at least a fixed share of all names' words reach the driver: at most a few times 5,000, whatever the number of names.
    """
    total = names.count()
    words = cut(names.mapInArrow(_beside, "word string, first boolean, late boolean, last boolean, company boolean, words int, beside string").filter("beside != ''").distinct())
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    each = words.groupBy("word").agg(F.count_distinct("beside").alias("n"), share("first"), share("late"), share("last"), share("company"))
    least = lambda x: max(x[0], x[1] * total)
    # a short form is rarer than what it is short for
    rows = each.filter((F.col("n") >= least(GIVEN_BESIDE)) & (((F.col("first") >= 0.8) & (F.col("company") <= 0.1)) | (F.col("late") >= 0.8))).collect()
    trade = {r.word: r for r in rows if r.late >= 0.8 and r.n >= least(GIVEN_BESIDE)}
    given = {r.word: r.n for r in rows if r.first >= 0.8 and r.company <= 0.1}
    if not trade and not given:
        return Lexicon()
    spark = names.sparkSession
    some = F.broadcast(spark.createDataFrame([(w,) for w in [*trade, *given]], "word string"))
    beside = cut(words.join(some, "word", "left_semi").select("word", "beside").distinct())
    pairs = beside.alias("x").join(beside.alias("y"), F.expr("x.beside = y.beside and x.word != y.word and length(x.word) <= length(y.word)")).groupBy(F.col("x.word").alias("a"), F.col("y.word").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED_LEAST)
    count = {w: r.n for w, r in trade.items()} | given
    full: dict[str, set[str]] = {}
    for a, b, n in pairs.collect():
        if (a in trade) == (b in trade) and n >= SHARED * count[a] and short_for(a, b):
            full.setdefault(a, set()).add(b)
    common = {w for w, r in trade.items() if r.n >= least(LINE_BESIDE)}
    trade = {w: r for w, r in trade.items() if w in common or full.get(w, set()) & common}
    legal = frozenset(w for w, r in trade.items() if r.last >= 0.9 and len(w) <= 5 and w not in full and not any(w in f for f in full.values()))
    line = {w: max(full.get(w, {w}) & set(trade) or {w}, key=lambda x: (count[x], x)) for w in trade if w not in legal}
    return Lexicon(legal, line, {w: tuple(sorted(full.get(w, {w}))) for w in given})


def block_keys(words: list[str]) -> list[str]:
    joined = "".join(words)
    keys = {"P" + "|".join(sorted(map(phonetic, words))), "L" + "".join(sorted(joined)), "G" + "|".join(sorted(w[0] + w[-1] for w in words))}
    for i, w in enumerate(words):
        other = "".join(words[:i] + words[i + 1 :])
        keys |= {f"F{w}|{other[:1]}", f"E{w}|{other[-1:]}"} if other else {f"F{w[: len(w) // 2 + 1]}", f"E{w[-(len(w) // 2) - 1 :]}"}
    return sorted(keys)


def alike(a: list[str], b: list[str], most: int = 2) -> bool:
    """Whether two lists of words are spellings of the same words, with up to ``most`` edits in a word that is little similar."""
    if a == b:
        return True
    ja, jb = "".join(a), "".join(b)
    if len(a) != len(b):
        return len(a) + len(b) == 3 and max(jaro_winkler("".join(x), y) for one, two in ((a, b), (b, a)) if len(one) == 2 for x in (one, one[::-1]) for y in two) >= 0.96
    if len(a) == 1:
        return jaro_winkler(ja, jb) >= 0.93
    if len(a) == 2:
        pairs = [(a[0], b[0], a[1], b[1]), (a[0], b[1], a[1], b[0])]
        best = max(((min(x, y), (x + y) / 2) for x, y in ((close(p, q, most), close(r, s, most)) for p, q, r, s in pairs)), key=lambda v: v[1])
        return best[0] >= SIMILAR and best[1] >= SIMILAR_MEAN
    left = list(b)
    for w in a:
        best = max(left, key=lambda x: jaro_winkler(w, x))
        if jaro_winkler(w, best) < 0.88:
            return False
        left.remove(best)
    return True


_NODE = "name string, node string, kind string, words array<string>, line string, number string, legal string, given array<string>, initials string, keys array<string>"


def _parse_batch(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(lexicon.value)
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                p = parser.parse(name)
                if p:
                    kind, words, line, number, legal, given, initials = p
                    first = initials[:1] if kind == "p" and not given else ""
                    node = "\x1f".join((kind, " ".join(words), line or "", number or "", legal or "", "/".join(given), first))
                    out.append((name, node, kind, words, line, number, legal, given, first, block_keys(words)))
            cols = list(zip(*out)) if out else [()] * 10
            kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in _NODE.split(", ")])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wa, wb, most = (batch.column(i).to_pylist() for i in (2, 3, 6))
        keep = pa.array([i for i in range(len(wa)) if alike(wa[i], wb[i], most[i])], pa.int64())
        exact = pa.array([wa[i] == wb[i] for i in keep.to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), exact, batch.column(4).take(keep), batch.column(5).take(keep)], ["a", "b", "exact", "strict", "full"])


def _pairs(nodes: DataFrame) -> DataFrame:
    """Compared pairs ``a, b, exact, strict, full``: ``strict`` if all parts agree, else ``a`` leaves out what ``b`` (with ``full`` parts) has."""
    keyed = nodes.select("node", "kind", "words", "line", "number", "legal", "given", "initials", F.explode("keys").alias("key"))
    # a company is met under its own parts and, by names that leave some out, under what is left of them; a person under the given names
    parts = lambda line, legal, number: F.concat_ws("\x1f", F.lit("c"), F.coalesce(line, F.lit("\x1e")), F.coalesce(legal, F.lit("\x1e")), F.coalesce(number, F.lit("\x1e")))
    line, legal, number, none = F.col("line"), F.col("legal"), F.col("number"), F.lit(None).cast("string")
    company = F.array_distinct(F.array(parts(line, legal, number), parts(none, legal, number), parts(line, none, number), parts(none, none, number), parts(none, legal, none), parts(none, none, none)))
    person = F.array(F.lit("p"))
    is_company = F.col("kind") == "c"
    a = keyed.withColumn("block", F.xxhash64("key", F.when(is_company, parts(line, legal, number)).otherwise("p")))
    b = keyed.withColumn("block", F.explode(F.when(is_company, company).otherwise(person))).withColumn("block", F.xxhash64("key", "block"))
    # large blocks are split: b's rows by hash, a's rows to each part
    many = cut(b.groupBy("block").count().filter(F.col("count") > HOT).select("block", F.ceil(F.col("count") / HOT).cast("int").alias("parts")))
    split = F.coalesce("parts", F.lit(1))
    a = a.join(many, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), split - 1))).drop("parts", "key")
    b = b.join(many, "block", "left").withColumn("part", F.pmod(F.xxhash64("node"), split).cast("int")).drop("parts", "key")
    a, b = (x.select("block", "part", *[F.col(c).alias(f"{c}_{y}") for c in ("node", "kind", "words", "line", "number", "legal", "given", "initials")]) for x, y in ((a, "a"), (b, "b")))
    same = lambda c: F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    left_out = lambda c: F.col(f"{c}_a").isNull() & F.col(f"{c}_b").isNotNull()
    company = (F.col("kind_a") == "c") & (F.col("kind_b") == "c")
    person = (F.col("kind_a") == "p") & (F.col("kind_b") == "p")
    one = lambda x: F.size(f"given_{x}") == 1
    strict_c = company & same("line") & same("number") & same("legal") & (F.col("node_a") < F.col("node_b"))
    strict_p = person & same("given") & same("initials") & (F.col("node_a") < F.col("node_b"))
    wild_c = company & (same("line") | left_out("line")) & (same("legal") | left_out("legal")) & (same("number") | (left_out("number") & left_out("line"))) & ~(same("line") & same("legal") & same("number"))
    starts = F.exists("given_b", lambda g: g.startswith(F.col("initials_a")))
    wild_p = person & one("b") & ~one("a") & F.when(F.size("given_a") > 1, F.arrays_overlap("given_a", "given_b")).otherwise((F.col("initials_a") == "") | starts)
    full = F.col("line_b").isNotNull().cast("int") + F.col("legal_b").isNotNull().cast("int")
    found = a.join(b, ["block", "part"]).filter((F.col("node_a") != F.col("node_b")) & (strict_c | strict_p | wild_c | wild_p))
    # without a line of business in common there is less to go by
    most = F.when(same("line") & F.col("line_a").isNotNull(), 2).otherwise(1)
    found = found.select("node_a", "node_b", "words_a", "words_b", (strict_c | strict_p).alias("strict"), full.alias("full"), most.alias("most")).distinct()
    return found.mapInArrow(_compare, "a string, b string, exact boolean, strict boolean, full int")


def _joined(pairs: DataFrame) -> DataFrame:
    """Bipartite edges of pairs, for connected components."""
    record = F.xxhash64("a", "b")
    return pairs.select(record.alias("record"), F.col("a").alias("entity")).union(pairs.select(record, "b"))


def linked(names: DataFrame) -> DataFrame:
    """``name, cluster``: each distinct non-placeholder name of the column ``name`` and the least node of its cluster.

    Names that are alone in their cluster are there too. Other columns and repeated rows are not looked at.
    """
    ship(names.sparkSession)
    distinct = cut(names.select("name").filter("name is not null").distinct())
    lexicon = names.sparkSession.sparkContext.broadcast(learn(distinct))
    parsed = cut(distinct.mapInArrow(_parse_batch(lexicon), _NODE))
    nodes = parsed.drop("name").dropDuplicates(["node"])
    pairs = cut(_pairs(nodes))
    strict = pairs.filter("strict").select("a", "b")
    group = components(_joined(strict)).select(F.col("entity").alias("b"), F.col("label").alias("group"))
    wild = pairs.filter("not strict").join(group, "b", "left").withColumn("group", F.coalesce("group", "b"))
    # of what a name may stand for, the same words count before similar ones, then the fullest
    best = wild.groupBy("a").agg(F.max(F.struct("exact", "full")).alias("best"))
    one = wild.join(best, "a").filter("exact = best.exact and full = best.full").groupBy("a").agg(F.min("group").alias("b"), F.max("group").alias("other")).filter("b = other").select("a", "b")
    label = components(_joined(strict.unionByName(one))).select(F.col("entity").alias("node"), "label")
    return parsed.select("name", "node").join(label, "node", "left").select("name", F.coalesce("label", "node").alias("cluster"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "company_relationships")
    return t.select(F.col("source_company_name").alias("name")).union(t.select("target_company_name")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_pairs(linked(_names(spark, sf_dir)), "cluster", "name", "name_a", "name_b")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its cluster."""
    return linked(_names(spark, sf_dir))
