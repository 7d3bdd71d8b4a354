"""Decoding under a grammar, used inside Arrow functions on workers.

A grammar is one automaton: numbered states, each with its outgoing tokens, and at the end of a phrase a state without any, which
says what the phrase means and where the next one starts. Choosing a relation and extracting claims are two automata for the
same walk.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.ship import ship

STOP, NONE = "[STOP]", "NONE"
BETWEEN, NEXT = " ::", " ;"

Tokens = tuple[int, ...]
#: scores of the allowed tokens after what was generated, with the log of the whole mass if it is known
Scorer = Callable[[Tokens, list[int]], "Sequence[float] | tuple[Sequence[float], float]"]


def target_text(candidate: str) -> str:
    """How a candidate stands in generated text."""
    return " " + candidate


def log_sum_exp(values: Sequence[float]) -> float:
    top = max(values)
    return top + math.log(math.fsum(math.exp(v - top) for v in values))


@dataclass
class Automaton:
    """``moves[state]``: token -> state; ``ends[state]``: (meaning, what follows) where a phrase ends."""

    moves: list[dict[int, int]] = field(default_factory=list)
    ends: dict[int, tuple] = field(default_factory=dict)

    def state(self) -> int:
        self.moves.append({})
        return len(self.moves) - 1

    def add(self, start: int, phrase: Tokens, meaning: object, follows: str | None = None) -> None:
        """A phrase from a start state. Phrases that are equal, or of which one begins another, are a ValueError."""
        if not phrase:
            raise ValueError(f"{meaning!r} has no tokens")
        at = start
        for t in phrase:
            if at in self.ends:
                raise ValueError(f"{meaning!r} begins with the tokens of {self.ends[at][0]!r}")
            if t not in self.moves[at]:
                self.moves[at][t] = self.state()
            at = self.moves[at][t]
        if at in self.ends or self.moves[at]:
            other = self.ends[at][0] if at in self.ends else "another phrase"
            raise ValueError(f"the tokens of {meaning!r} are those of {other!r} or begin them")
        self.ends[at] = (meaning, follows)

    def allowed(self, at: int) -> list[int]:
        return sorted(self.moves[at])


def relation_automaton(candidates: Sequence[str], encode: Callable[[str], Sequence[int]], end: int, stop: bool = True) -> Automaton:
    """One of the candidates, or the stop token, then ``end``."""
    names = list(dict.fromkeys(candidates))
    if not names:
        raise ValueError("there is nothing to choose from")
    a = Automaton()
    root = a.state()
    for name in [*names, *[STOP] * (stop and STOP not in names)]:
        a.add(root, (*encode(target_text(name)), end), name)
    return a


@dataclass(frozen=True)
class Choice:
    ids: Tokens
    candidate: str
    logprob: float


@dataclass(frozen=True)
class Extraction:
    """What was extracted; log-probabilities are those of the allowed tokens alone, the mass that of all tokens."""

    ids: Tokens
    triples: tuple[tuple[str, str], ...]
    logprob: float
    n_choices: int
    sentinel: str | None = None
    kept_logmass: float | None = None
    least_logmass: float | None = None

    @property
    def confidence(self) -> float:
        return math.exp(self.logprob / self.n_choices) if self.n_choices else 1.0

    @property
    def agreement(self) -> float | None:
        if self.kept_logmass is None:
            return None
        return math.exp(self.kept_logmass / len(self.ids)) if self.ids else 1.0

    @property
    def min_agreement(self) -> float | None:
        return None if self.least_logmass is None else math.exp(self.least_logmass)


@dataclass
class _Walk:
    """A decoder's position and what it has gathered."""

    scorer: Scorer
    temperature: float = 0.0
    rng: random.Random | None = None
    ids: list[int] = field(default_factory=list)
    logprob: float = 0.0
    choices: int = 0
    masses: list[float] = field(default_factory=list)

    def phrase(self, a: Automaton, at: int) -> tuple:
        while at not in a.ends:
            options = a.allowed(at)
            scores = self.scorer(tuple(self.ids), options)
            if isinstance(scores, tuple):
                scores, whole = scores
                self.masses.append(min(0.0, log_sum_exp(scores) - whole))
            scores = list(scores)
            norm = log_sum_exp(scores)
            if self.temperature <= 0:
                k = scores.index(max(scores))
            else:
                hot = log_sum_exp([s / self.temperature for s in scores])
                weights = [math.exp(s / self.temperature - hot) for s in scores]
                k = (self.rng or random).choices(range(len(scores)), weights)[0]
            self.logprob += scores[k] - norm
            self.choices += len(options) > 1
            self.ids.append(options[k])
            at = a.moves[at][options[k]]
        return a.ends[at]


def choose(scorer: Scorer, automaton: Automaton, temperature: float = 0.0, rng: random.Random | None = None) -> Choice:
    """Exactly one candidate: the likeliest token each time at temperature 0 (the first of equals), else drawn."""
    walk = _Walk(scorer, temperature, rng)
    name, _ = walk.phrase(automaton, 0)
    return Choice(tuple(walk.ids), name, walk.logprob)


@dataclass(frozen=True)
class ClaimGrammar:
    """``NONE``, a sentinel, or ``relation :: target`` joined by ``;`` up to ``most`` times, then the end token."""

    automaton: Automaton
    start: dict[str, int]
    most: int
    relations: dict[str, Tokens]
    targets: dict[str, Tokens]
    none: Tokens
    separator: Tokens
    end: int
    sentinels: dict[str, Tokens]


def claim_grammar(relations: Sequence[str], targets: Sequence[str], encode: Callable[[str], Sequence[int]], end: int, most: int = 8, sentinels: Sequence[str] = ()) -> ClaimGrammar:
    """The grammar of a taxonomy and a closed set of targets.

    Without targets only ``NONE`` and the sentinels are left. No relations, ``most`` below 1, empty names and names that are or contain a reserved
    word are ValueErrors.
    """
    rels, tgts, sents = (list(dict.fromkeys(x)) for x in (relations, targets, sentinels))
    if not rels:
        raise ValueError("a grammar needs a relation")
    if most < 1:
        raise ValueError("a grammar needs room for a claim")
    for n in (*rels, *tgts):
        if not n.strip():
            raise ValueError("a name is empty")
        if n in (NONE, *sents) or BETWEEN.strip() in n or NEXT.strip() in n:
            raise ValueError(f"{n!r} is or contains a reserved word")
    code = lambda s: tuple(encode(s))
    sep = code(NEXT)
    g = ClaimGrammar(
        Automaton(), {}, most, {r: code(target_text(r)) + code(BETWEEN) for r in rels}, {t: code(target_text(t)) for t in tgts},
        code(target_text(NONE)) + (end,), sep, end, {s: code(target_text(s)) + (end,) for s in sents},
    )
    a = g.automaton
    g.start.update({k: a.state() for k in ("open", "relation", "target", "last")})
    a.add(g.start["open"], g.none, NONE)
    for s, ids in g.sentinels.items():
        a.add(g.start["open"], ids, s)
    if tgts:
        for r, ids in g.relations.items():
            for k in ("open", "relation"):
                a.add(g.start[k], ids, r, "target")
        for t, ids in g.targets.items():
            for k in ("target", "last"):
                a.add(g.start[k], (*ids, end), t)
            a.add(g.start["target"], ids + sep, t, "relation")
    return g


def _steps(g: ClaimGrammar, phrase: Callable[[int], tuple]) -> tuple[list[tuple[str, str]], str | None]:
    """Walk the grammar by a function that reads a phrase from a state: the claims, or the sentinel."""
    claims: list[tuple[str, str]] = []
    meaning, follows = phrase(g.start["open"])
    if follows is None:
        return claims, meaning if meaning != NONE else None
    while True:
        relation = meaning
        target, follows = phrase(g.start["last" if len(claims) + 1 >= g.most else "target"])
        claims.append((relation, target))
        if follows is None:
            return claims, None
        meaning, _ = phrase(g.start["relation"])


def extract(scorer: Scorer, g: ClaimGrammar, temperature: float = 0.0, rng: random.Random | None = None) -> Extraction:
    walk = _Walk(scorer, temperature, rng)
    claims, sentinel = _steps(g, lambda at: walk.phrase(g.automaton, at))
    m = walk.masses
    return Extraction(tuple(walk.ids), tuple(claims), walk.logprob, walk.choices, sentinel, sum(m) if m else None, min(m) if m else None)


def allowed_along(a: Automaton, ids: Sequence[int], at: int = 0) -> list[list[int]]:
    """The allowed tokens before each position of a phrase; KeyError where it leaves the automaton."""
    out = []
    for t in ids:
        out.append(a.allowed(at))
        at = a.moves[at][t]
    return out


def claims_allowed_along(g: ClaimGrammar, ids: Sequence[int]) -> list[list[int]]:
    """The same along a whole output; ValueError if it is cut short or goes on after the end."""
    out: list[list[int]] = []

    def phrase(at: int) -> tuple:
        while at not in g.automaton.ends:
            if len(out) == len(ids):
                raise ValueError("the ids end inside a phrase")
            out.append(g.automaton.allowed(at))
            at = g.automaton.moves[at][ids[len(out) - 1]]
        return g.automaton.ends[at]

    _steps(g, phrase)
    if len(out) != len(ids):
        raise ValueError("the ids go on after the end")
    return out


def encode_claims(claims: Sequence[tuple[str, str]], g: ClaimGrammar) -> list[int]:
    """The ids that decoding gives for these claims; ValueError if it cannot give them."""
    if not claims:
        return list(g.none)
    if len(claims) > g.most:
        raise ValueError(f"more than {g.most} claims")
    out: list[int] = []
    for k, (r, t) in enumerate(claims):
        if r not in g.relations or t not in g.targets:
            raise ValueError(f"({r}, {t}) is outside the grammar")
        out += [*g.relations[r], *g.targets[t], *(g.separator if k < len(claims) - 1 else (g.end,))]
    return out


def sentinel_logprob(scorer: Scorer, g: ClaimGrammar, sentinel: str = "ESCALATE") -> float:
    """Log-probability of a sentinel among what the grammar allows."""
    at, total, done = g.start["open"], 0.0, []
    for t in g.sentinels[sentinel]:
        options = g.automaton.allowed(at)
        scores = scorer(tuple(done), options)
        scores = list(scores[0] if isinstance(scores, tuple) else scores)
        total += scores[options.index(t)] - log_sum_exp(scores)
        at = g.automaton.moves[at][t]
        done.append(t)
    return total


_RESULT = "key string, triples array<struct<rel:string,target:string>>, sentinel string, logprob double, n_choices int, gen_tokens int, confidence double, agreement double, min_agreement double"


def decode_table(chunks: DataFrame, scorer_of: Callable[[], Callable[[str], Scorer]], grammar_of: Callable[[], ClaimGrammar]) -> DataFrame:
    """Decode each row of ``chunks`` (``key``, ``prompt``) on the workers.

    ``scorer_of`` and ``grammar_of`` run once a task; what the former returns gives the scorer of a prompt. Null prompts are decoded as ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, g = scorer_of(), grammar_of()
        names = [f.split()[0] for f in _RESULT.split(", ")]
        claim = pa.list_(pa.struct([("rel", pa.string()), ("target", pa.string())]))
        kinds = [pa.string(), claim, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        for b in batches:
            rows = []
            for key, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = extract(scorer(prompt or ""), g)
                rows.append((key, [{"rel": r, "target": t} for r, t in x.triples], x.sentinel, x.logprob, x.n_choices, len(x.ids), x.confidence, x.agreement, x.min_agreement))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    ship(chunks.sparkSession)
    return chunks.select("key", "prompt").mapInArrow(run, _RESULT)


def completion_labels(prompt: Sequence[int], completion: Sequence[int], most: int) -> tuple[list[int], list[int]]:
    """Ids and labels of a supervised example: the prompt masked by -100 and cut on the left so that all fits ``most``."""
    room = max(0, most - len(completion))
    kept = list(prompt)[-room:] if room else []
    return kept + list(completion), [-100] * len(kept) + list(completion)
