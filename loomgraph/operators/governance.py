"""Policies over hops and over proposed edges, audits, certificates and provenance."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import TYPES
from ..functions.text import filer_is_party, ground_span, normalize_name


@dataclass(frozen=True)
class HopPolicy:
    """A named check on ``action`` and ``nodes``; stopping is always allowed."""

    name: str
    check: Column
    mandatory: bool = True
    #: sourced edges (``[qid,] head, relation``) that the check looks at
    sources: DataFrame | None = None

    def passed(self) -> Column:
        return (F.col("action.type") == "STOP") | F.coalesce(self.check, F.lit(False))


def allow_all() -> HopPolicy:
    return HopPolicy("allow_all", F.lit(True))


def relation_allowlist(patterns: Sequence[str] = ("*",), mandatory: bool = True) -> HopPolicy:
    regex = "|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'Z', '$').replace(chr(92) + 'z', '$')})" for p in patterns)
    return HopPolicy("relation_allowlist", F.coalesce(F.col("action.relation"), F.lit("")).rlike(f"^(?:{regex})$" if regex else "(?!)"), mandatory)


def confidence_floor(floor: float = 0.0, mandatory: bool = True) -> HopPolicy:
    return HopPolicy("confidence_floor", F.col("action.score") >= floor, mandatory)


def provenance_required(sources: DataFrame | None = None, mandatory: bool = True) -> HopPolicy:
    """Some frontier node must have a sourced edge of the relation; without ``sources`` (``[qid,] head, relation``) no expansion passes.

    The traversal joins the sources with the frontier and gives the relations that are sourced there as ``sourced``.
    """
    if sources is None:
        return HopPolicy("provenance_required", F.lit(False), mandatory)
    return HopPolicy("provenance_required", F.array_contains("sourced", F.col("action.relation")), mandatory, sources.filter("head is not null and relation is not null"))


HOP_POLICIES = {"allow_all": allow_all, "relation_allowlist": relation_allowlist, "confidence_floor": confidence_floor, "provenance_required": provenance_required}


def build_policies(names: Sequence[str | dict]) -> tuple[HopPolicy, ...]:
    """Policies by name, or by ``{"name": …, …}`` with arguments; an unknown name is a KeyError; no names: allow all."""
    if not names:
        return (allow_all(),)
    return tuple(HOP_POLICIES[n]() if isinstance(n, str) else HOP_POLICIES[n["name"]](**{k: v for k, v in n.items() if k != "name"}) for n in names)


def hop_checks(policies: Sequence[HopPolicy]) -> Column:
    """All policies' results by name; none is skipped."""
    if not policies:
        return F.create_map().cast("map<string,boolean>")
    return F.create_map(*[x for p in policies for x in (F.lit(p.name), p.passed())])


def hop_blocked(policies: Sequence[HopPolicy], checks: Column) -> Column:
    """Whether a mandatory policy failed."""
    out = F.lit(False)
    for p in policies:
        if p.mandatory:
            out = out | ~p.passed()
    return out


def hop_audits(results: DataFrame) -> DataFrame:
    """A row for each audited hop; stopping is recorded with the relation ''. A hop lists no sources: whether there were any is a check's result."""
    s = results.select("qid", F.inline("steps"))
    none = F.array().cast("array<string>").alias("provenance")
    return s.select("qid", "step", F.coalesce("action.relation", F.lit("")).alias("relation"), "checks_passed", F.col("action.score").alias("confidence"), none)


def certificates(audits: DataFrame) -> DataFrame:
    """``qid, hops, verdict``: true if every check of every hop passed."""
    ok = F.forall(F.map_values("checks_passed"), lambda v: v)
    return audits.groupBy("qid").agg(F.count("*").alias("hops"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("verdict"))


@dataclass(frozen=True)
class EdgePolicy:
    name: str
    check: Column
    mandatory: bool = True


def schema_allowlist(relations: Sequence[str] = TYPES) -> EdgePolicy:
    return EdgePolicy("schema_allowlist", F.coalesce(F.col("relation").isin(*relations), F.lit(False)))


def evidence_gates(people: Sequence[str] = (), aliases: Column | None = None) -> EdgePolicy:
    return EdgePolicy("evidence_gates", rule_gates(F.col("target"), F.col("text"), people, aliases)["passed"])


def edge_confidence_floor(floor: float = 0.0) -> EdgePolicy:
    return EdgePolicy("edge_confidence_floor", F.coalesce(F.coalesce("judge_score", "confidence") >= floor, F.lit(False)))


def rule_gates(target: Column, text: Column, people: Sequence[str] = (), aliases: Column | None = None) -> Column:
    """``struct<grounded, is_company, filer_party, passed>`` of a claim's target against its text."""
    grounded = F.coalesce(ground_span(target, text, aliases).isNotNull(), F.lit(False))
    company = ~normalize_name(target).isin(*people) if people else F.lit(True)
    party = filer_is_party(text)
    return F.struct(grounded.alias("grounded"), company.alias("is_company"), party.alias("filer_party"), (grounded & company & party).alias("passed"))


def rule_judge(gates: Column, in_gold: Column, type_score: Column | None = None) -> Column:
    """0 if a gate failed; else the type score clamped to 0..1, or 1 for a gold claim and 0 for another."""
    score = in_gold.cast("double") if type_score is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), type_score))
    return F.when(gates["passed"], score).otherwise(0.0)


def proposals(decisions: DataFrame, extractor: str = "") -> DataFrame:
    """Edges proposed by decisions: an extraction's own triples at decoding confidence, an escalation's gold at the teacher's.

    ``decisions``: ``filing, chunk, text, filer, gold, confidence, route, triples, logprob, n_choices``. A teacher's confidence
    that is null or 0 counts as 1; skips propose nothing; a null chunk is named after the filing.
    """
    extract = F.col("route") == "extract"
    teacher = F.when(F.coalesce("confidence", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("confidence"))
    own = F.exp(F.col("logprob") / F.greatest(F.lit(1), F.col("n_choices")))
    claims = F.when(extract, F.col("triples")).when(F.col("route") == "escalate", F.col("gold"))
    d = decisions.select("filing", "filer", F.coalesce(F.nullif("chunk", F.lit("")), F.concat("filing", F.lit(":chunk"))).alias("chunk"), "text", "route", F.when(extract, own).otherwise(teacher).alias("confidence"), F.explode(claims).alias("e"))
    return d.select("filing", "filer", F.col("e.rel").alias("relation"), F.col("e.target").alias("target"), "chunk", "text", "route", "confidence", F.lit(None).cast("double").alias("judge_score"), F.lit(extractor).alias("extractor"))


def audit_edges(edges: DataFrame, policies: Sequence[EdgePolicy]) -> DataFrame:
    """Each proposal with ``checks_passed``, ``committed`` and ``span``; all policies run, a failed mandatory one blocks."""
    blocked = F.lit(False)
    for p in policies:
        if p.mandatory:
            blocked = blocked | ~p.check
    checks = F.create_map(*[x for p in policies for x in (F.lit(p.name), p.check)]) if policies else F.create_map().cast("map<string,boolean>")
    return edges.withColumns({"checks_passed": checks, "committed": ~blocked, "span": ground_span(F.col("target"), F.col("text"))})


def write_certificates(audited: DataFrame) -> DataFrame:
    """``filing, n_committed, n_blocked, verdict``: whether every check of every committed edge passed."""
    ok = F.forall(F.map_values("checks_passed"), lambda v: v)
    return audited.groupBy("filing").agg(F.count_if("committed").alias("n_committed"), F.count_if(~F.col("committed")).alias("n_blocked"), F.coalesce(F.bool_and(F.when(F.col("committed"), ok)), F.lit(True)).alias("verdict"))


_RECORD = ("chunk", "span", "route", "confidence", "extractor")


def provenance(audited: DataFrame) -> DataFrame:
    """A row for each record that supports a committed edge: ``head, relation, tail`` and the record. An edge may have any number."""
    return audited.filter("committed").select(F.col("filer").alias("head"), "relation", F.col("target").alias("tail"), *_RECORD)


def provenance_counts(audited: DataFrame) -> DataFrame:
    """Records and distinct chunks of each committed edge."""
    return provenance(audited).groupBy("head", "relation", "tail").agg(F.count("*").alias("provenances"), F.count_distinct("chunk").alias("chunks"))


def provenance_of(audited: DataFrame, edges: DataFrame) -> DataFrame:
    """The records of the asked edges (``head, relation, tail``) as an array each; for a few edges, as a lookup."""
    asked = provenance(audited).join(edges.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_semi")
    return asked.groupBy("head", "relation", "tail").agg(F.array_sort(F.collect_list(F.struct(*_RECORD))).alias("provenance"))


def has_provenance(audited: DataFrame, edges: DataFrame) -> DataFrame:
    """The asked edges that have a record."""
    return edges.join(provenance(audited), ["head", "relation", "tail"], "left_semi")
