"""From exports to supervised pairs: grouping, vocabularies, leakage-safe splits, judge and gate rows, rewards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets
from ..functions.metrics import chunk_f1, quality
from ..functions.taxonomy import FLIP, TYPES, lookup
from ..functions.text import candidate_spans, claim_key, match_candidate
from ..plans.lineage import cut
from ..plans.prefix import running

_TINY = 1e-6


def group_export(rows: DataFrame, floor: float = 0.7, order: str = "ordinal", strict: bool = True) -> DataFrame:
    """Export rows grouped to pairs by (filing, chunk id or text).

    ``rows``: the export's columns and a unique ``order``. Text, filer, company and item come from the group's first row; gold are the
    claims with confidence at or above the floor or null, uncertain those below that are not gold, each distinct in order;
    the confidence is the least of the gold rows. Rows without a type are negatives. ``strict``: a type outside the taxonomy or a
    group with two filers is an error; else such rows are left out.
    """
    known = F.col("relationship_type").isin(*TYPES)
    claim = F.col("relationship_type").isNotNull() & F.col("target").isNotNull()
    if strict:
        checked = F.when(claim & ~known, F.raise_error(F.concat(F.lit("relation outside the taxonomy: "), "relationship_type"))).otherwise(claim)
    else:
        checked = claim & known
    gold = F.coalesce(F.col("confidence") >= floor, F.lit(True))
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), "chunk_text", "evidence_text", F.lit(""))
    text = F.coalesce(F.nullif("chunk_text", F.lit("")), "evidence_text")
    r = rows.select(F.coalesce("accession_number", F.lit("")).alias("filing"), key.alias("chunk"), F.col(order).alias("o"), text.alias("text"), "filer", F.col("company_id").alias("company"), "item_key", "confidence", F.struct(F.col("relationship_type").alias("rel"), F.col("target").alias("target")).alias("c"), checked.alias("ok"), gold.alias("sure"))
    first = F.struct("o", "text", "filer", "company", "item_key")
    # a claim's rows come together before the claims of a group do, so repeated deliveries fill no array
    at = lambda cond: F.min(F.when(cond, F.col("o")))
    claims = r.groupBy("filing", "chunk", "c").agg(
        F.min(first).alias("f"), at(F.col("ok") & F.col("sure")).alias("og"), at(F.col("ok") & ~F.col("sure")).alias("ou"),
        F.min(F.when(F.col("ok") & F.col("sure"), F.col("confidence"))).alias("confidence"), F.min("filer").alias("fa"), F.max("filer").alias("fb"),
    )
    take = lambda o: F.transform(F.array_sort(F.collect_list(F.when(F.col(o).isNotNull(), F.struct(F.col(o).alias("o"), "c")))), lambda x: x["c"]).alias(o[1])
    filers = F.when(F.min("fa") != F.max("fb"), 2).otherwise(1).alias("filers")
    g = claims.groupBy("filing", "chunk").agg(F.min("f").alias("f"), take("og"), take("ou"), F.min("confidence").alias("confidence"), filers)
    if strict:
        g = g.withColumn("filers", F.when(F.col("filers") > 1, F.raise_error(F.concat(F.lit("two filers in one chunk of "), "filing"))).otherwise(F.col("filers")))
    out = g.select("f.text", "f.filer", F.array_distinct("g").alias("triples"), "filing", "confidence", "f.company", "f.item_key", "chunk", F.array_except("u", "g").alias("uncertain"), "filers")
    return out.filter("filers <= 1").drop("filers")


def vocabulary(pairs: DataFrame) -> DataFrame:
    """Distinct gold targets; uncertain ones are none."""
    return pairs.select(F.explode("triples").alias("t")).select(F.col("t.target").alias("target")).distinct()


def counts(pairs: DataFrame) -> DataFrame:
    """What an export holds: pairs, positives, pairs with several triples, filings, companies."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.size("triples") > 0).alias("positives"), F.count_if(F.size("triples") > 1).alias("several"), F.count_distinct("filing").alias("filings"), F.count_distinct("company").alias("companies"))


def unit_split(df: DataFrame, unit: Column, fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, names: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """``df`` with ``split``: units shuffled by a hash, the first int(n * f) to each split, the rest to the last.

    All rows of a unit are in one split; a null unit is a unit. The hash is SHA-256 of ``seed|unit``.
    """
    work = df.withColumn("_u", F.coalesce(unit, F.lit("")))
    units = work.select("_u").distinct().withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}|"), "_u"), 256))
    ranks = running(units, [F.col("_k"), F.col("_u")], {}, "_r")
    size = units.agg(F.count("*").alias("_n"))
    bound, split = F.lit(0), F.lit(names[-1])
    cases = None
    for name, f in list(zip(names, fractions))[:-1]:
        bound = bound + F.floor(F.col("_n") * F.lit(float(f)))
        cases = F.when(F.col("_r") <= bound, name) if cases is None else cases.when(F.col("_r") <= bound, name)
    placed = ranks.crossJoin(F.broadcast(size)).select("_u", (cases.otherwise(split) if cases is not None else split).alias("split"))
    return work.join(placed, "_u").drop("_u")


def split_pairs(pairs: DataFrame, by: str = "auto", fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Pairs split by filing or by company (a null or empty company is its filing); ``auto``: by company if any pair has one."""
    company = F.coalesce(F.nullif("company", F.lit("")), "filing")
    if by == "auto":
        by = "company" if pairs.filter("company is not null and company != ''").limit(1).count() else "filing"
    if by not in ("company", "filing"):
        raise ValueError(f"cannot split on {by!r}")
    return unit_split(pairs, company if by == "company" else F.col("filing"), fractions, seed)


def dev_split(rows: DataFrame, unit: str = "filer", dev: float = 0.1, seed: int = 42, order: str = "ordinal") -> DataFrame:
    """Gate split: max(1, int(n * dev)) units to dev; with a single unit the same by row."""
    n = rows.select(F.coalesce(unit, F.lit("")).alias("u")).distinct().count()
    by = F.col(unit) if n > 1 else F.col(order).cast("string")
    n = n if n > 1 else rows.count()
    share = max(1, int(n * dev)) / max(n, 1)
    return unit_split(rows, by, (share + 1e-12, 1 - share), seed, ("dev", "train"))


def judge_rows(export: DataFrame, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Judge export as rows, and the count of rows left out: without filer, target or text, or with a type or verdict that is none.

    The text is the chunk's, else the quote; a null score is 1 for an accepted and 0 for a rejected claim; scores are clamped to 0..1.
    """
    verdict = F.lower(F.trim("verdict"))
    text = F.coalesce(F.nullif("chunk_text", F.lit("")), F.nullif("evidence_text", F.lit("")))
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    ok = full("filer") & full("target") & text.isNotNull() & F.coalesce(F.col("relationship_type").isin(*TYPES), F.lit(False)) & F.coalesce(verdict.isin("accept", "reject"), F.lit(False))
    score = F.coalesce("faithfulness", F.when(verdict == "accept", 1.0).otherwise(0.0))
    rows = export.filter(ok).select(F.col(order).alias("ordinal"), text.alias("text"), "filer", F.col("relationship_type").alias("relation"), "target", verdict.alias("verdict"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("faithfulness"), F.col("accession_number").alias("filing"))
    return rows, export.agg(F.count_if(~ok).alias("skipped"))


def direction_negatives(rows: DataFrame, least: float = 0.5, low: float = 0.0) -> DataFrame:
    """Rejected claims in the wrong direction, from accepted directional ones.

    Not where the turned claim is accepted anywhere, or stands with the same text already; one for each text and claim.
    """
    keyed = rows.withColumn("k", claim_key(F.col("filer"), F.col("relation"), F.col("target")))
    turned = rows.filter((F.col("verdict") == "accept") & (F.col("faithfulness") >= least)).withColumn("relation", lookup(FLIP, F.col("relation"))).filter("relation is not null")
    turned = turned.withColumn("k", claim_key(F.col("filer"), F.col("relation"), F.col("target")))
    accepted = keyed.filter("verdict = 'accept'").select("k").distinct()
    there = keyed.select("text", "k").distinct()
    new = turned.join(accepted, "k", "left_anti").join(there, ["text", "k"], "left_anti")
    first = new.groupBy("text", "k").agg(F.min(F.struct("ordinal", "filer", "relation", "target", "filing")).alias("f"))
    return first.select("text", "f.filer", "f.relation", "f.target", F.lit("reject").alias("verdict"), F.lit(min(1.0, max(0.0, low))).alias("faithfulness"), "f.filing")


def verdict_agreement(rows: DataFrame, pred: str, verdict: str, thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """Share of verdicts a threshold reproduces: overall, of the accepted and of the rejected (1 where there are none), and the mean of the two."""
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    # rows are counted by distinct score first, so the thresholds multiply levels, not rows
    levels = rows.groupBy(F.col(pred).alias("p"), (F.col(verdict) == "accept").alias("yes")).agg(F.count("*").alias("n"))
    right = F.when((F.col("p") >= F.col("threshold")) == F.col("yes"), F.col("n")).otherwise(0)
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    share = lambda c: F.when(of(c) > 0, F.sum(F.when(c, right).otherwise(0)) / of(c)).otherwise(1.0)
    a = levels.select("*", ts).groupBy("threshold").agg(F.sum("n").alias("n"), (F.sum(right) / F.sum("n")).alias("overall"), share(F.col("yes")).alias("accept"), share(~F.col("yes")).alias("reject"))
    return a.withColumn("balanced", (F.col("accept") + F.col("reject")) / 2)


def hard_chunk(gold: Column, text: Column, filer: Column, least: int = 4) -> Column:
    """Whether a chunk has gold and either at least ``least`` claims or a target that is none of its spans."""
    spans = candidate_spans(text, filer)
    return (F.size(gold) > 0) & ((F.size(gold) >= least) | F.exists(gold, lambda t: match_candidate(t["target"], spans).isNull()))


def gate_rows(outcomes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Gate examples: outcomes and pairs matched by key, the target the F1 of the claims by core names.

    A key without a partner on either side is an error, so that nothing is matched askew.
    """
    j = outcomes.join(pairs.select(F.col(key).alias("_k"), "text", "filer"), outcomes[key] == F.col("_k"), "full")
    whole = F.when(F.col(key).isNull() | F.col("_k").isNull(), F.raise_error(F.lit("outcomes and pairs do not match"))).otherwise(F.col("_k"))
    g, p = sets.by_core_name(F.col("gold")), sets.by_core_name(F.col("pred"))
    return j.select(whole.alias(key), "text", "filer", chunk_f1(g, p).alias("target"), F.size(F.array_distinct(g)).alias("n_gold"), F.size(F.array_distinct(p)).alias("n_pred"), "confidence")


def escalate_labels(pairs: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Keys to be labelled for escalation: the hard chunks and int(share * rest) of the others by hash."""
    hard = pairs.select(F.col(key).alias("key"), hard_chunk(F.col("triples"), F.col("text"), F.col("filer")).alias("hard"))
    hard = cut(hard)
    rest = hard.filter("not hard")
    n = int(rest.count() * share)
    extra = running(rest, [F.xxhash64(F.lit(seed), "key"), F.col("key")], {}, "r").filter(F.col("r") <= n).select("key")
    return hard.filter("hard").select("key", F.lit("hard").alias("why")).unionByName(extra.withColumn("why", F.lit("sample")))


def _judged(judge: Column | None) -> Column:
    score = F.col("in_gold").cast("double") if judge is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge))
    return score


def chunk_parts(decisions: DataFrame, key: Sequence[str], judge: Column | None = None) -> DataFrame:
    """What rewards need of each decision: emitted, accepted, sum of judged scores, gold, recovered.

    ``decisions``: ``key``, ``route``, ``triples``, ``gold``, ``uncertain``, ``gen_tokens``. Emitted claims count with repetitions; uncertain ones do
    not count; ``judge`` scores the columns ``rel, target, in_gold``.
    """
    known = F.when(~F.coalesce(F.col("route").isin("extract", "escalate", "skip"), F.lit(False)), F.raise_error(F.lit("unknown route"))).otherwise(F.col("route"))
    d = decisions.select(*key, known.alias("route"), sets.or_empty(F.col("triples")).alias("triples"), F.array_distinct(sets.or_empty(F.col("gold"))).alias("gold"), sets.or_empty(F.col("uncertain")).alias("uncertain"), F.coalesce("gen_tokens", F.lit(0)).alias("gen_tokens"))
    own = F.when(F.col("route") == "extract", F.col("triples")).otherwise(F.array().cast("array<struct<rel:string,target:string>>"))
    d = d.withColumn("own", own)
    n_gold = F.size("gold").cast("long")
    back = F.when(F.col("route") == "escalate", n_gold).otherwise(F.size(F.array_intersect("own", "gold")).cast("long"))
    counted = F.filter("own", lambda t: ~F.array_contains(F.col("uncertain"), t))
    if judge is None:
        hits = F.size(F.filter(counted, lambda t: F.array_contains(F.col("gold"), t))).cast("long")
        return d.select(*key, "route", "gen_tokens", n_gold.alias("n_gold"), back.alias("recovered"), F.size(counted).cast("long").alias("emitted"), hits.alias("accepted"), hits.cast("double").alias("score"))
    base = d.select(*key, "route", "gen_tokens", n_gold.alias("n_gold"), back.alias("recovered"), F.explode_outer(counted).alias("t"), "gold")
    base = base.select(*key, "route", "gen_tokens", "n_gold", "recovered", F.col("t.rel").alias("rel"), F.col("t.target").alias("target"), F.array_contains("gold", F.col("t")).alias("in_gold"))
    s = F.when(F.col("rel").isNotNull(), _judged(judge))
    return base.withColumn("s", s).groupBy(*key, "route", "gen_tokens", "n_gold", "recovered").agg(F.count("s").alias("emitted"), F.count_if(F.col("s") >= 0.5).alias("accepted"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("score"))


def filing_rewards(parts: DataFrame, unit: str = "filing", lam: float = 0.1, escalation: float = 2000.0, cap: float = 2000.0, mode: str = "f1") -> DataFrame:
    """Micro reward of each filing: quality of mean judged score and recall, less ``lam`` times the tokens' share of the cap."""
    if lam < 0 or cap <= 0:
        raise ValueError("lam must not be negative, the cap positive")
    g = parts.groupBy(unit).agg(*[F.sum(c).alias(c) for c in ("n_gold", "recovered", "emitted", "accepted", "score")], F.count("*").alias("chunks"), F.count_if(F.col("route") == "escalate").alias("escalated"), F.sum("gen_tokens").alias("tokens"))
    p = F.when(F.col("emitted") > 0, F.col("score") / F.col("emitted")).otherwise(1.0)
    r = F.when(F.col("n_gold") > 0, F.col("recovered") / F.col("n_gold")).otherwise(1.0)
    tokens = F.col("tokens") + escalation * F.col("escalated")
    cost = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tokens / (cap * F.greatest(F.lit(1), F.col("chunks")))))
    return g.select(unit, "chunks", "escalated", "emitted", "accepted", p.alias("precision"), r.alias("recall"), tokens.cast("double").alias("cost_tokens"), cost.alias("normalized_cost"), (quality(p, r, mode) - lam * cost).alias("reward"))


def chunk_rewards(parts: DataFrame, key: Sequence[str], lam: float = 0.1, escalation: float = 2000.0, cap: float = 2000.0, mode: str = "f1") -> DataFrame:
    """Reward of each decision by itself; the cost is clamped by chunk."""
    claims = F.col("emitted") > 0
    p = F.when(claims, F.col("score") / F.col("emitted")).otherwise(1.0)
    r = F.when(F.col("n_gold") > 0, F.col("recovered") / F.col("n_gold")).otherwise(1.0)
    tokens = F.col("gen_tokens") + F.when(F.col("route") == "escalate", escalation).otherwise(0.0)
    cost = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tokens / cap))
    return parts.select(*key, "route", p.alias("precision"), r.alias("recall"), cost.alias("cost"), (quality(p, r, mode) - lam * cost).alias("reward"))


def advantages(rewards: DataFrame, group: Sequence[str], scale: bool = False) -> DataFrame:
    """``advantage``: reward less its group's mean, divided by the group's population deviation if ``scale``."""
    # aggregated before the shuffle and joined back, so that a hot group is not one task
    level = rewards.groupBy(*group).agg(F.avg("reward").alias("_m"), F.stddev_pop("reward").alias("_s"))
    a = F.col("reward") - F.col("_m")
    return rewards.join(level, list(group)).withColumn("advantage", a / (F.col("_s") + _TINY) if scale else a).drop("_m", "_s")


def critic_score(verdict: Column, faithfulness: Column) -> Column:
    """An accepting critic's score clamped to 0..1, else 0."""
    return F.when(verdict == "accept", F.greatest(F.lit(0.0), F.least(F.lit(1.0), faithfulness))).otherwise(0.0)


def route_of(sentinel: Column, triples: Column) -> Column:
    """The route of a decoded result: a sentinel escalates (another is an error), triples extract, none skips."""
    bad = F.raise_error(F.concat(F.lit("unknown sentinel "), sentinel))
    return F.when(sentinel == "ESCALATE", "escalate").when(sentinel.isNotNull(), bad).when(F.size(triples) > 0, "extract").otherwise("skip")


def capped_groups(rows: DataFrame, unit: str, order: Column, most_units: int | None, most_rows: int | None, seed: int = 42) -> DataFrame:
    """Rows of the first ``most_units`` units by hash, the first ``most_rows`` of each in order."""
    out = rows
    if most_units is not None:
        units = running(rows.select(unit).distinct(), [F.xxhash64(F.lit(seed), unit), F.col(unit)], {}, "_r").filter(F.col("_r") <= most_units).select(unit)
        out = out.join(units, unit, "left_semi")
    if most_rows is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy(order))).filter(F.col("_r") <= most_rows).drop("_r")
    return out
