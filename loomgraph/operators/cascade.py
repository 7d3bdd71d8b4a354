"""Extraction outcomes: quality, escalation thresholds, frontiers, rank statistics.

Everything works on *scored* rows: ``key`` (unique, breaks ties), a score column, and ``tp, fp, fn, n_gold, exact``, the counts of a
row's masked prediction against its gold as sets (``scored``). Escalating a row makes its prediction the gold:
tp becomes ``n_gold``, fp and fn 0. So a sweep over thresholds is a running sum over the rows in order of the score, had once
for all thresholds, instead of a scan for each.

Empty cases: precision is 1 without predictions, recall 1 without gold, everything 1 (F1 too) without rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets
from ..functions.metrics import harmonic, ratio
from ..plans.lineage import cut
from ..plans.prefix import running, running_max_before

_SUMS = ("tp", "fp", "fn")


def signals() -> dict[str, Column]:
    """Escalation signals by name; an agreement that was not measured counts as 1."""
    c, a, m = F.col("confidence"), F.coalesce("agreement", F.lit(1.0)), F.coalesce("min_agreement", F.lit(1.0))
    return {"confidence": c, "agreement": a, "min_agreement": m, "conf_x_agree": c * a, "conf_x_min_agree": c * m}


def scored(outcomes: DataFrame, key: str, masked: bool = True) -> DataFrame:
    """``key``, the signals and the set counts of each outcome. ``masked``: predictions that are uncertain are none. Null arrays are empty."""
    gold = F.array_distinct(sets.or_empty(F.col("gold")))
    raw = F.array_distinct(sets.or_empty(F.col("pred")))
    pred = sets.effective_pred(F.col("pred"), F.col("uncertain")) if masked else raw
    tp, fp, fn = sets.counts(pred, gold)
    return outcomes.select(
        F.col(key).alias("key"), *[c.alias(n) for n, c in signals().items()], tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.size(gold).cast("long").alias("n_gold"), (F.size(raw) == 0).alias("says_none"), ((fp == 0) & (fn == 0)).cast("long").alias("exact"),
    )


def rates(tp: Column, fp: Column, fn: Column, exact: Column | None = None, n: Column | None = None) -> list[Column]:
    p, r = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    out = [p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1")]
    return out if exact is None else [*out, ratio(exact, n, 1.0).alias("exact")]


def micro_prf(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro precision, recall, F1 and share of exact rows, of all rows or of each group."""
    a = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_SUMS, "exact")], F.count("*").alias("n"))
    return a.select(*by, "n", *rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("exact"), F.col("n")))


def _levels(rows: DataFrame, score: str) -> DataFrame:
    """Rows summed by distinct score: what the running sums need of them."""
    gain = lambda c: F.sum(c).alias(c)
    return rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), gain("tp"), gain("fp"), gain("fn"), gain("n_gold"), gain("exact"))


def _at(below: DataFrame, total: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics when the rows summed in ``below`` (``e_*``) are escalated, out of ``total``."""
    j = below.crossJoin(F.broadcast(total))  # total is one row
    c = lambda n: F.col(n)
    tp, fp, fn = c("tp") - c("e_tp") + c("e_n_gold"), c("fp") - c("e_fp"), c("fn") - c("e_fn")
    exact = c("exact") - c("e_exact") + c("e_n")
    return j.select(*by, c("e_n").alias("escalated"), ratio(c("e_n"), c("n"), 0.0).alias("escalation_rate"), *rates(tp, fp, fn, exact, c("n")))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_SUMS, "exact")])


def sweep(rows: DataFrame, score: str, taus: DataFrame) -> DataFrame:
    """A row for each ``tau``: metrics when all rows with score < tau are escalated. A null score is never below."""
    names = ("n", *_SUMS, "n_gold", "exact")
    levels = _levels(rows.filter(F.col(score).isNotNull()), score).withColumn("kind", F.lit(0))
    marks = taus.select(F.col("tau").alias("score"), F.lit(-1).alias("kind")).distinct()
    both = levels.unionByName(marks, allowMissingColumns=True)
    # a threshold comes before the rows of its own score, so its running sums hold the rows below it
    summed = running(both, [F.col("score"), F.col("kind")], {f"e_{c}": F.coalesce(c, F.lit(0)) for c in names})
    return _at(summed.filter("kind = -1").select(F.col("score").alias("tau"), *[f"e_{c}" for c in names]), _totals(rows), ["tau"])


def sweep_2d(rows: DataFrame, none: Sequence[float], extract: Sequence[float]) -> DataFrame:
    """A row for each pair of thresholds: one for rows that predict nothing, one for the others; always on the confidence.

    The two kinds of rows are swept apart; the grid adds their sums.
    """
    spark = rows.sparkSession
    names = ("n", *_SUMS, "n_gold", "exact")
    parts = []
    for flag, taus, name in ((True, none, "tau_none"), (False, extract, "tau_extract")):
        own = _levels(rows.filter(F.col("says_none") == flag).filter("confidence is not null"), "confidence").withColumn("kind", F.lit(0))
        marks = spark.createDataFrame([(float(t),) for t in sorted(set(taus))], "score double").withColumn("kind", F.lit(-1))
        s = running(own.unionByName(marks, allowMissingColumns=True), [F.col("score"), F.col("kind")], {f"e_{c}": F.coalesce(c, F.lit(0)) for c in names})
        parts.append(s.filter("kind = -1").select(F.col("score").alias(name), *[F.col(f"e_{c}").alias(f"{name}_{c}") for c in names]))
    grid = parts[0].crossJoin(F.broadcast(parts[1]))  # two lists of thresholds of the caller's
    grid = grid.select("tau_none", "tau_extract", *[(F.col(f"tau_none_{c}") + F.col(f"tau_extract_{c}")).alias(f"e_{c}") for c in names])
    return _at(grid, _totals(rows), ["tau_none", "tau_extract"])


def headline(swept: DataFrame, min_recall: float = 0.8) -> DataFrame:
    """The cheapest threshold with at least the recall, of several the least; no row if none has it."""
    return swept.filter(F.col("recall") >= min_recall).orderBy("escalation_rate", "tau").limit(1)


def quantile_taus(rows: DataFrame, score: str, n: int = 41) -> DataFrame:
    """Thresholds between consecutive distinct scores, at most ``n - 2`` of them evenly by rank, and 0 and just above the largest; 0 alone without rows."""
    values = rows.filter(F.col(score).isNotNull()).select(F.col(score).alias("v")).distinct()
    ranked = running(values, [F.col("v")], {}, "r")
    mids = ranked.join(ranked.select((F.col("r") - 1).alias("r"), F.col("v").alias("w")), "r").select((F.col("r") - 1).alias("i"), ((F.col("v") + F.col("w")) / 2).alias("tau"))
    size = mids.agg(F.count("*").alias("m"))
    most = max(n - 2, 1)
    # index floor(j * m / most) for j = 0 .. most-1
    j = F.ceil(F.col("i") * most / F.col("m"))
    wanted = (F.col("m") <= most) | ((j < most) & (F.floor(j * (F.col("m") / most)) == F.col("i")))
    inner = mids.crossJoin(F.broadcast(size)).filter(wanted).select("tau")
    ends = values.agg(F.max("v").alias("v")).select(F.explode(F.when(F.col("v").isNull(), F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.col("v") + 1e-9))).alias("tau"))
    return inner.union(ends).distinct()


def auroc(rows: DataFrame, score: str, wrong: Column | None = None) -> DataFrame:
    """P(score of a wrong row < score of a right one), ties half; null if all rows are of one kind. By rank sums over distinct scores."""
    wrong = (F.col("fp") + F.col("fn") > 0) if wrong is None else wrong
    levels = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(wrong).alias("bad"), F.count_if(~wrong).alias("ok"))
    below = running(levels, [F.col("score")], {"bad_to": F.col("bad")})
    won = F.sum(F.col("ok") * (F.col("bad_to") - F.col("bad")) + F.col("ok") * F.col("bad") / 2)
    return below.agg(F.when((F.sum("ok") > 0) & (F.sum("bad") > 0), won / (F.sum("ok").cast("double") * F.sum("bad"))).alias("auroc"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong_rows"), F.coalesce(F.sum("ok"), F.lit(0)).alias("right_rows"))


def pareto_front(points: DataFrame, cost: str = "escalation_rate", gain: str = "recall") -> DataFrame:
    """Points no other point beats in one without losing in the other; equal points all stay."""
    best = points.groupBy(cost).agg(F.max(gain).alias("_g"))
    front = running_max_before(best, cost, "_g", "_before").filter(F.col("_before").isNull() | (F.col("_g") > F.col("_before")))
    return points.join(front.select(F.col(cost), F.col("_g").alias(gain)), [cost, gain])


def ranked(rows: DataFrame, score: str, descending: bool = False) -> DataFrame:
    """Rows with ``rank`` (1 first) by score, then key."""
    s = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return running(rows, [s, F.col("key").asc()], {}, "rank")


def budget_selection(rows: DataFrame, score: str, budget: float) -> DataFrame:
    """The floor(budget * n) rows of least (score, key), with their rank."""
    if not 0 <= budget <= 1:
        raise ValueError("a budget is a share of the rows")
    n = rows.count()
    return ranked(rows, score).filter(F.col("rank") <= int(budget * n))


def exact_frontier(rows: DataFrame, score: str) -> DataFrame:
    """Metrics at every number of escalated rows, 0 to n, in the order of (score, key)."""
    names = (*_SUMS, "n_gold", "exact")
    s = running(rows.withColumn("n", F.lit(1).cast("long")), [F.col(score).asc_nulls_last(), F.col("key").asc()], {f"e_{c}": F.col(c) for c in ("n", *names)})
    zero = rows.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(f"e_{c}") for c in ("n", *names)])
    return _at(s.select(*[f"e_{c}" for c in ("n", *names)]).unionByName(zero), _totals(rows), [])


def curve(rows: DataFrame, score: str, fractions: Sequence[float], descending: bool = False) -> DataFrame:
    """Metrics when the first int(fraction * n) rows of an ordering are escalated."""
    n = rows.count()
    order = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    names = ("n", *_SUMS, "n_gold", "exact")
    s = running(rows.withColumn("n", F.lit(1).cast("long")), [order, F.col("key").asc()], {f"e_{c}": F.col(c) for c in names})
    zero = rows.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(f"e_{c}") for c in names])
    want = rows.sparkSession.createDataFrame([(float(f), int(f * n)) for f in fractions], "fraction double, e_n long")
    points = s.select(*[f"e_{c}" for c in names]).unionByName(zero).join(F.broadcast(want), "e_n")
    return _at(points, _totals(rows), ["fraction"])


def gate_curves(rows: DataFrame, fractions: Sequence[float] = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40), gate: str | None = None, seed: int = 42) -> DataFrame:
    """The curve of each ordering: least confidence, least agreement and their product, most errors first (oracle), random by hash."""
    work = cut(rows.withColumns({"errors": F.col("fp") + F.col("fn"), "shuffled": F.sha2(F.concat(F.lit(f"{seed}|"), F.col("key").cast("string")), 256)}))
    orders = {"confidence": ("confidence", False), "agreement": ("agreement", False), "conf_x_agree": ("conf_x_agree", False), "oracle": ("errors", True), "random": ("shuffled", False)}
    if gate:
        orders["gate"] = (gate, False)
    out = None
    for name, (score, down) in orders.items():
        c = curve(work, score, fractions, down).withColumn("ordering", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


def escalate_sweep(rows: DataFrame, p: str, n_points: int = 41) -> DataFrame:
    """Metrics when rows with probability >= theta are escalated, for the distinct probabilities, 0 and 1+1e-9, thinned to ``n_points`` evenly by rank."""
    values = rows.select(F.col(p).cast("double").alias("v")).filter("v is not null").union(rows.sparkSession.createDataFrame([(0.0,), (1.0 + 1e-9,)], "v double")).distinct()
    ranks = running(values, [F.col("v")], {}, "r").select((F.col("r") - 1).alias("i"), "v")
    size = ranks.agg(F.count("*").alias("m"))
    j = F.ceil(F.col("i") / (F.col("m") / n_points))
    thin = (F.col("m") <= n_points) | ((j < n_points) & (F.floor(j * (F.col("m") / n_points)) == F.col("i")))
    thetas = ranks.crossJoin(F.broadcast(size)).filter(thin).select((-F.col("v")).alias("tau"))
    # p >= theta is -p <= -theta: rows below the mark and at it
    names = ("n", *_SUMS, "n_gold", "exact")
    levels = _levels(rows.filter(F.col(p).isNotNull()).withColumn("_m", -F.col(p)), "_m").withColumn("kind", F.lit(0))
    both = levels.unionByName(thetas.select(F.col("tau").alias("score"), F.lit(1).alias("kind")), allowMissingColumns=True)
    s = running(both, [F.col("score"), F.col("kind")], {f"e_{c}": F.coalesce(c, F.lit(0)) for c in names})
    return _at(s.filter("kind = 1").select((-F.col("score")).alias("theta"), *[f"e_{c}" for c in names]), _totals(rows), ["theta"])


def routed_scores(rows: DataFrame, route: str = "route") -> DataFrame:
    """Micro scores of routed rows: an escalation recovers its gold, an extraction counts as predicted, a skip misses its gold."""
    r = F.col(route)
    take = lambda e, x, s: F.sum(F.when(r == "escalate", e).when(r == "extract", x).otherwise(s))
    zero = F.lit(0).cast("long")
    a = rows.agg(
        F.count("*").alias("n"), take(F.col("n_gold"), F.col("tp"), zero).alias("tp"), take(zero, F.col("fp"), zero).alias("fp"), take(zero, F.col("fn"), F.col("n_gold")).alias("fn"),
        *[F.count_if(r == k).alias(f"n_{k}") for k in ("extract", "escalate", "skip")],
    )
    return a.select("n", "n_extract", "n_escalate", "n_skip", *rates(*[F.coalesce(F.col(c), zero) for c in _SUMS]))


def bucket_report(rows: DataFrame, dims: DataFrame, score: str, budget: float) -> DataFrame:
    """Metrics at one budget by dimension and bucket; ``gating`` from 30 rows.

    ``dims``: ``key, dimension, bucket``, a key may be in several buckets of a dimension.
    """
    chosen = budget_selection(rows, score, budget).select("key").withColumn("esc", F.lit(True))
    r = rows.join(chosen, "key", "left").withColumn("esc", F.coalesce("esc", F.lit(False)))
    pick = lambda yes, no: F.sum(F.when(F.col("esc"), yes).otherwise(no))
    zero = F.lit(0).cast("long")
    g = r.join(dims.distinct(), "key").groupBy("dimension", "bucket").agg(
        F.count("*").alias("n"), pick(F.col("n_gold"), F.col("tp")).alias("tp"), pick(zero, F.col("fp")).alias("fp"), pick(zero, F.col("fn")).alias("fn"), pick(zero + 1, F.col("exact")).alias("ex")
    )
    return g.select("dimension", "bucket", "n", (F.col("n") >= 30).alias("gating"), *rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("ex"), F.col("n")))


def rank_buckets(rows: DataFrame, order: Sequence[Column], parts: int, prefix: str, out: str) -> DataFrame:
    """``prefix1`` … by min(parts-1, rank * parts div n) in the order, which must be unique."""
    r = running(rows, list(order), {}, "_r")
    size = rows.agg(F.count("*").alias("_n"))
    at = F.least(F.lit(parts - 1), F.floor((F.col("_r") - 1) * parts / F.greatest(F.col("_n"), F.lit(1)))) + 1
    return r.crossJoin(F.broadcast(size)).withColumn(out, F.concat(F.lit(prefix), at.cast("string"))).drop("_r", "_n")


def gate_metrics(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    """Mean absolute and squared error, Spearman by plain ranks (ties by key), and AUC of gold > 0.5 by the same ranks."""
    r = running(rows.filter(F.col(pred).isNotNull() & F.col(gold).isNotNull()), [F.col(pred), F.col("key")], {}, "rp")
    r = running(r, [F.col(gold), F.col("key")], {}, "rg")
    pos = F.col(gold) > 0.5
    n_pos, n_neg = F.count_if(pos), F.count_if(~pos)
    auc = (F.sum(F.when(pos, F.col("rp"))) - n_pos * (n_pos + 1) / 2) / (n_pos.cast("double") * n_neg)
    return r.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(pred) - F.col(gold))).alias("mae"), F.avg(F.pow(F.col(pred) - F.col(gold), 2)).alias("mse"), F.corr("rp", "rg").alias("spearman"), F.when((n_pos > 0) & (n_neg > 0), auc).alias("auc"))


def run_rows(summaries: DataFrame, cost: str, accuracy: str) -> DataFrame:
    """Run summaries as rows ``run, mean_cost, accuracy, n_questions``; label from the run, else the data set, else ``run``; a missing metric is NaN."""
    nan = F.lit(float("nan"))
    get = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), nan)
    label = F.coalesce(F.nullif("run_label", F.lit("")), F.nullif("dataset", F.lit("")), F.lit("run"))
    return summaries.select(label.alias("run"), get(F.col("mean_cost"), cost).alias("mean_cost"), get(F.col("metrics"), accuracy).alias("accuracy"), "n_questions")


def accuracy_at(runs: DataFrame, budget: float) -> DataFrame:
    """Best accuracy within a mean cost; NaN if no run is."""
    return runs.agg(F.coalesce(F.max(F.when(F.col("mean_cost") <= budget, F.col("accuracy"))), F.lit(float("nan"))).alias("accuracy"))


def cost_at(runs: DataFrame, target: float) -> DataFrame:
    """Least mean cost with at least an accuracy; NaN if no run has it."""
    return runs.agg(F.coalesce(F.min(F.when(F.col("accuracy") >= target, F.col("mean_cost"))), F.lit(float("nan"))).alias("mean_cost"))


def run_label(controller: Column, synthesizer: Column, lam: Column) -> Column:
    """``controller-synthesizer``, with the cost weight where there is one."""
    return F.concat_ws("-", controller, synthesizer, F.when(lam.isNotNull(), F.concat(F.lit("lam"), lam.cast("string"))))


def cohort_weights(rows: DataFrame, strata: str, target: DataFrame) -> DataFrame:
    """Post-stratification: weight of a stratum = its target share over its share of the rows."""
    n = rows.groupBy(strata).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(target), strata).withColumn("weight", F.col("share") / (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))
