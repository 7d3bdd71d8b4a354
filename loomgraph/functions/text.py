"""Text rules as column expressions: names, spans, grounding, rendering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.ship import ship
from .taxonomy import NOUN, lookup

# fixed values -------------------------------------------------------------------------------------------------------
SUFFIXES = "incorporated corporation company holdings limited technologies inc corp co ltd llc plc lp sa ag nv group".split()
CONNECTORS = ("of", "the", "de", "da", "van", "von", "for", "&")
FURNITURE = (
    "the we our us you they it its he she a an and or but if in on at as of for "
    "from to with under over during however company corporation registrant item "
    "part note see form table exhibit section management board directors officers "
    "january february march april may june july august september october november "
    "december quarter annual report business overview risk factors states"
).split()
PARTY = r"(?i)\b(we|our|us|the company|the corporation|the registrant)\b"
OPEN, CLOSE = "[F]", "[/F]"
FIRST_PERSON = r"\b(we|our|ourselves|the Company|the Corporation|the Registrant|the Partnership)\b"
LEGAL_TAIL = r"[\s,]+(inc|inc\.|incorporated|corp|corp\.|corporation|co|co\.|company|ltd|ltd\.|llc|l\.l\.c\.|plc|lp|l\.p\.|holdings|group)\b\.?"
STOP, NONE = "[STOP]", "NONE"
STATE_CHAINS, LISTED, READ_PATHS = 8, 64, 10
_CAP = r"[A-Z][A-Za-z0-9&'\-]*"
_SPAN = rf"\b{_CAP}(?:\s+(?:{_CAP}|(?:{'|'.join(CONNECTORS)})\s+{_CAP}))*"
# --------------------------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without outer white space of any kind (SQL's trim takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """Lower case, each run of characters other than ``a-z0-9`` and blank one blank, without outer blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def core_name(c: Column) -> Column:
    """The normal name without trailing corporate suffixes, one word at least left."""
    return F.regexp_replace(F.regexp_replace(normalize_name(c), " +", " "), rf"(?: (?:{'|'.join(SUFFIXES)}))+$", "")


def filer_is_party(text: Column) -> Column:
    """Whether the text speaks in the filer's first person."""
    return F.coalesce(F.regexp_like(text, F.lit(PARTY)), F.lit(False))


def candidate_spans(text: Column, filer: Column | None = None, people: Sequence[str] = (), most: int = LISTED) -> Column:
    """Capitalised spans that may name a target: first appearances in order, at most ``most``.

    Without sentence furniture, ``people``, the filer and beginnings of the filer's name. Null text: no spans.
    """
    words = lambda s: F.split(s, r"\s+")
    furniture = F.array(*[F.lit(x) for x in FURNITURE])
    loose = F.array(*[F.lit(x) for x in sorted({*FURNITURE, *CONNECTORS})])
    people_ = F.array(*[F.lit(" ".join(p.split())) for p in people]) if people else F.array().cast("array<string>")
    people_ = F.transform(people_, normalize_name)

    def tidy(s: Column) -> Column:
        w = words(F.regexp_replace(s, r"[.',&-]+$", ""))
        cut = F.regexp_replace(F.array_join(w, " "), rf"(?i)(?:(?:^| )(?:{'|'.join(CONNECTORS)}))+$", "")
        return F.trim(cut)

    def keep(s: Column) -> Column:
        w = words(s)
        single = ~F.array_contains(furniture, F.lower(s)) & ((F.length(s) >= 4) | ((F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) >= 2)))
        several = ~F.forall(w, lambda x: F.array_contains(loose, F.lower(x)))
        norm = normalize_name(s)
        ok = (s != "") & F.when(F.size(w) == 1, single).otherwise(several) & (norm != "") & ~F.array_contains(people_, norm)
        if filer is not None:
            f = normalize_name(F.coalesce(filer, F.lit("")))
            ok = ok & ~F.startswith(f, norm)
        return ok

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SPAN), F.lit(0))
    return F.slice(F.array_distinct(F.filter(F.transform(found, tidy), keep)), 1, most)


def match_candidate(target: Column, candidates: Column) -> Column:
    """The candidate with the target's normal name, else with its core name; of several the last; null if none."""
    def last(name) -> Column:
        return F.try_element_at(F.filter(candidates, lambda c: name(c) == name(target)), F.lit(-1))

    return F.coalesce(last(normalize_name), last(core_name))


def _span_of(name: Column, text: Column) -> Column:
    """0-based ``start, end`` of the first place where the words of ``name`` stand; null if none."""
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace(name, " +", r"[\\W_]+"), F.lit(r"\b"))
    before = F.call_function("regexp_extract", text, F.concat(F.lit("(?isU)^(.*?)(?:"), pattern, F.lit(")")), F.lit(1))
    here = F.call_function("regexp_extract", text, F.concat(F.lit("(?isU)("), pattern, F.lit(")")), F.lit(1))
    span = F.struct(F.length(before).alias("start"), (F.length(before) + F.length(here)).alias("end"))
    return F.when((name != "") & (here != ""), span)


def ground_span(target: Column, text: Column, aliases: Column | None = None) -> Column:
    """``struct<start,end>`` of the target in the text: full name, core name, then each alias likewise; null if nowhere."""
    own = F.coalesce(_span_of(normalize_name(target), text), _span_of(core_name(target), text))
    if aliases is None:
        return own
    tried = F.transform(aliases, lambda a: F.coalesce(_span_of(normalize_name(a), text), _span_of(core_name(a), text)))
    return F.coalesce(own, F.try_element_at(F.filter(tried, lambda s: s.isNotNull()), F.lit(1)))


def _mark(text: str | None, filer: str | None) -> str | None:
    import re

    if text is None:
        return None
    name = (filer or "").strip()
    core = re.sub(LEGAL_TAIL, "", name, flags=re.I).strip().rstrip(".,")
    found = [m.span() for m in re.finditer(FIRST_PERSON, text, re.I)] + [m.span() for m in re.finditer(r"\bus\b", text)]
    names = sorted({v for v in (name, core) if len(v) >= 3}, key=lambda v: (-len(v), v))
    if names:
        both = "|".join(r"\s+".join(map(re.escape, v.split())) for v in names)
        found += [m.span() for m in re.finditer(rf"\b(?:{both})\b", text)]
    # one pass over the characters' cover: mentions that overlap are one, touching ones are two
    ends: list[list[int]] = []
    for a, b in sorted(found):
        if ends and a < ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    for a, b in reversed(ends):
        text = f"{text[:a]}{OPEN}{text[a:b]}{CLOSE}{text[b:]}"
    return text


@F.pandas_udf(StringType())
def _marked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, filer in batches:
        yield pd.Series([_mark(t if isinstance(t, str) else None, f if isinstance(f, str) else None) for t, f in zip(text, filer)], dtype=object)


def mark_filer_mentions(text: Column, filer: Column) -> Column:
    """The text with the filer's name (case counts), first-person words and lower-case ``us`` in markers; null text stays null."""
    ship()
    return _marked(text, filer)


def confidence_bucket(c: Column) -> Column:
    """Tenth below the confidence, clamped to 0..1, as ``0.0`` to ``1.0``; ``unknown`` for null."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(c.isNull(), "unknown").otherwise(F.format_string("%.1f", F.floor(clamped * 10) / 10))


def judge_input(filer: Column, relation: Column, target: Column, text: Column) -> Column:
    return F.concat(F.lit("filer: "), filer, F.lit("\nclaim: the filer is the "), relation, F.lit(" of "), target, F.lit("\nevidence: "), text)


def gate_input(filer: Column, text: Column, confidence: Column) -> Column:
    return F.concat(F.lit("confidence: "), confidence_bucket(confidence), F.lit("\nfiler: "), filer, F.lit("\n\n"), text)


def extraction_prompt(filer: Column, text: Column, relations: Sequence[str], marked: bool = False) -> Column:
    """The extractor's input. ``marked``: with the filer's mentions in markers."""
    hint = f" ({OPEN}…{CLOSE} marks the filer; judge each relation from the filer's side)" if marked else ""
    body = mark_filer_mentions(text, filer) if marked else text
    head = F.lit("extract the filer's company relationships from this SEC filing text.\nfiler: ")
    tail = F.lit(f"\nrelations: {' | '.join(relations)} (or {NONE} if the text states none){hint}\nextraction:")
    return F.concat(head, filer, F.lit("\ntext: "), body, tail)


def _more(items: Column, most: int, mark: str) -> Column:
    hidden = F.size(items) - most
    shown = F.slice(items, 1, most)
    return F.when(hidden > 0, F.concat(shown, F.array(F.format_string(mark, hidden)))).otherwise(shown)


def controller_prompt(state: Column, candidates: Column) -> Column:
    """The controller's input: the state, up to ``LISTED`` candidates and the stop token."""
    listed = _more(F.transform(candidates, lambda c: F.concat(F.lit("- "), c)), LISTED, "- ... (+%d more)")
    return F.concat(state, F.lit("\ncandidates:\n"), F.array_join(F.concat(listed, F.array(F.lit(f"- {STOP}"))), "\n"), F.lit("\nnext:"))


def chain(path: Column) -> Column:
    """``a -[r]-> b …`` of a path, its root if it has no triples, ``?`` without either."""
    t = path["triples"]
    steps = F.transform(t, lambda x: F.concat(F.lit("-["), x["relation"], F.lit("]-> "), x["tail"]))
    return F.when(F.size(t) > 0, F.concat_ws(" ", F.get(t, F.lit(0))["head"], F.array_join(steps, " "))).otherwise(F.coalesce(path["root"], F.lit("?")))


def serialize_state(question: Column, step: Column, frontier: Column) -> Column:
    """``Q: … || step=n || frontier: …`` with up to ``STATE_CHAINS`` chains."""
    chains = F.array_join(_more(F.transform(frontier, chain), STATE_CHAINS, "... (+%d more)"), " | ")
    return F.concat(F.lit("Q: "), question, F.lit(" || step="), step.cast("string"), F.lit(" || frontier: "), F.when(F.size(frontier) > 0, chains).otherwise("(empty)"))


def verbalize(topic: Column, sequence: Column) -> Column:
    """The question of a relation sequence: the last relation's noun first, the topic without its kind last."""
    name = F.regexp_replace(topic, "^[^:]*:", "")

    def add(phrase: Column, relation: Column) -> Column:
        noun = lookup(NOUN, relation)
        return F.concat(noun, F.when(noun.endswith(" by"), " ").otherwise(" of "), phrase)

    return F.concat(F.lit("who are the "), F.aggregate(sequence, name, add), F.lit("?"))


def verbalize_paths(paths: Column, most: int = READ_PATHS) -> Column:
    """A line for each of the first paths that has triples; a fixed line if none has."""
    lines = F.transform(F.filter(F.slice(paths, 1, most), lambda p: F.size(p["triples"]) > 0), lambda p: F.concat(F.lit("- "), chain(p)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- (no paths retrieved)")


def reader_answers(generated: Column, nodes: Column, tails: Column) -> Column:
    """Generated names that are nodes of the paths, in order, without case; the frontier's tails if there are none."""
    said = F.transform(F.split(generated, r"[,\n;]+"), lambda s: F.lower(strip(F.regexp_replace(strip(s), r"\.+$|^\.+", ""))))
    found = F.transform(said, lambda s: F.try_element_at(F.filter(nodes, lambda n: F.lower(n) == s), F.lit(1)))
    kept = F.array_distinct(F.filter(found, lambda s: s.isNotNull()))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(tails))


def claim_key(filer: Column, relation: Column, target: Column) -> Column:
    """A claim without the case and outer blanks of its names."""
    return F.struct(F.lower(strip(filer)).alias("filer"), relation.alias("relation"), F.lower(strip(target)).alias("target"))


def sector_name(c: Column) -> Column:
    return F.regexp_replace(c, "^[^:]*:", "")


def target_text(c: Column) -> Column:
    """How a candidate stands in generated text."""
    return F.concat(F.lit(" "), c)
