"""Queries over extraction outcomes: quality, thresholds, frontiers, rank statistics, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import chunk_f1
from ..functions.sets import or_empty
from ..operators import cascade, construct, traverse, validation
from ..sources import sinks
from .graph_queries import table
from .lineage import cut
from .registry import query

TAUS = [round(0.05 * i, 2) for i in range(22)]


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest evaluation of each outcome, if its confidence lies in 0 to 1."""
    t = table(spark, sf_dir, "extraction_outcomes")
    cols = [c for c in t.columns if c not in ("outcome_id", "evaluated_at")]
    last = t.filter("outcome_id is not null").groupBy("outcome_id").agg(F.max(F.struct("evaluated_at", *cols)).alias("l")).select("outcome_id", *[f"l.{c}" for c in cols])
    return last.filter("confidence >= 0 and confidence <= 1")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.scored(outcomes(spark, sf_dir), "outcome_id")


_ROWS = """l AS (SELECT *, row_number() OVER (PARTITION BY outcome_id ORDER BY evaluated_at DESC NULLS LAST, chunk_id DESC NULLS LAST, confidence DESC NULLS LAST) AS k FROM extraction_outcomes WHERE outcome_id IS NOT NULL),
o AS (SELECT outcome_id AS key, chunk_id, confidence, agreement AS a, min_agreement AS m, list_distinct(coalesce(gold, [])) AS g, list_distinct(coalesce(pred, [])) AS r, coalesce(uncertain, []) AS u FROM l WHERE k = 1 AND confidence BETWEEN 0 AND 1),
p AS (SELECT *, [x FOR x IN r IF NOT list_contains(u, x)] AS p FROM o),
s AS (SELECT key, chunk_id, confidence, coalesce(a, 1.0) AS agreement, coalesce(m, 1.0) AS min_agreement, confidence * coalesce(a, 1.0) AS conf_x_agree, g, r, len([x FOR x IN p IF list_contains(g, x)]) AS tp, len([x FOR x IN p IF NOT list_contains(g, x)]) AS fp,
  len([x FOR x IN g IF NOT list_contains(p, x)]) AS fn, len(g) AS n_gold, len(r) = 0 AS says_none FROM p),
d AS (SELECT *, CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 0 END AS exact FROM s)"""


def _rates(tp: str, fp: str, fn: str, ex: str | None = None, n: str | None = None) -> str:
    p = f"CASE WHEN {tp} + {fp} > 0 THEN ({tp})::DOUBLE / ({tp} + {fp}) ELSE 1.0 END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN ({tp})::DOUBLE / ({tp} + {fn}) ELSE 1.0 END"
    out = f"{p} AS precision, {r} AS recall, CASE WHEN {p} + {r} > 0 THEN 2 * ({p}) * ({r}) / ({p} + {r}) ELSE 0.0 END AS f1"
    return out if ex is None else f"{out}, CASE WHEN {n} > 0 THEN ({ex})::DOUBLE / {n} ELSE 1.0 END AS exact"


_SUMS = "coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn, coalesce(sum(exact), 0)::BIGINT AS ex, count(*) AS n"


def _escalated(condition: str) -> str:
    """Sums over ``d`` (aliased x) when the rows of a condition are escalated."""
    return (
        f"coalesce(sum(CASE WHEN {condition} THEN n_gold ELSE tp END), 0)::BIGINT AS tp, coalesce(sum(CASE WHEN {condition} THEN 0 ELSE fp END), 0)::BIGINT AS fp, coalesce(sum(CASE WHEN {condition} THEN 0 ELSE fn END), 0)::BIGINT AS fn, "
        f"coalesce(sum(CASE WHEN {condition} THEN 1 ELSE exact END), 0)::BIGINT AS ex, count(*) FILTER ({condition}) AS e, count(*) AS n"
    )


_OUT = f"e AS escalated, CASE WHEN n > 0 THEN e::DOUBLE / n ELSE 0.0 END AS escalation_rate, {_rates('tp', 'fp', 'fn', 'ex', 'n')}"
_TAUS = "t AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in TAUS) + "]) AS tau)"
_SWEEP = f"w AS (SELECT tau, {_escalated('confidence < tau')} FROM d, t GROUP BY tau), sw AS (SELECT tau, {_OUT} FROM w)"


def _taus(spark: SparkSession, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], "tau double")


@query(f"WITH {_ROWS}, a AS (SELECT {_SUMS} FROM d) SELECT n, {_rates('tp', 'fp', 'fn', 'ex', 'n')} FROM a")
def outcome_micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.micro_prf(rows(spark, sf_dir))


@query(f"WITH {_ROWS}, a AS (SELECT says_none, {_SUMS} FROM d GROUP BY 1) SELECT says_none, n, {_rates('tp', 'fp', 'fn', 'ex', 'n')} FROM a")
def outcome_prf_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.micro_prf(rows(spark, sf_dir), ["says_none"])


@query(f"WITH {_ROWS}, {_TAUS}, {_SWEEP} SELECT * FROM sw")
def cascade_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.sweep(rows(spark, sf_dir), "confidence", _taus(spark, TAUS))


_GRID_N, _GRID_E = [0.0, 0.3, 0.6, 1.05], [0.0, 0.5, 0.85, 1.05]


@query(f"WITH {_ROWS}, a AS (SELECT unnest({_GRID_N}::DOUBLE[]) AS tau_none), b AS (SELECT unnest({_GRID_E}::DOUBLE[]) AS tau_extract), w AS (SELECT tau_none, tau_extract, {_escalated('confidence < CASE WHEN says_none THEN tau_none ELSE tau_extract END')} FROM d, a, b GROUP BY 1, 2) SELECT tau_none, tau_extract, {_OUT} FROM w")
def cascade_sweep_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.sweep_2d(rows(spark, sf_dir), _GRID_N, _GRID_E)


@query(f"WITH {_ROWS}, {_TAUS}, {_SWEEP} SELECT * FROM sw WHERE recall >= 0.8 ORDER BY escalation_rate, tau LIMIT 1")
def headline_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.headline(cascade.sweep(rows(spark, sf_dir), "confidence", _taus(spark, TAUS)))


@query(f"WITH {_ROWS}, {_TAUS}, {_SWEEP} SELECT tau, escalation_rate, recall FROM sw x WHERE NOT EXISTS (SELECT 1 FROM sw y WHERE (y.escalation_rate <= x.escalation_rate AND y.recall > x.recall) OR (y.escalation_rate < x.escalation_rate AND y.recall >= x.recall))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut(cascade.sweep(rows(spark, sf_dir), "confidence", _taus(spark, TAUS)))
    return cascade.pareto_front(s).select("tau", "escalation_rate", "recall")


@query(f"WITH {_ROWS}, k AS (SELECT key, row_number() OVER (ORDER BY conf_x_agree, key) AS rank, count(*) OVER () AS n FROM d) SELECT key, rank FROM k WHERE rank <= floor(0.2::DOUBLE * n)")
def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.budget_selection(rows(spark, sf_dir), "conf_x_agree", 0.2).select("key", "rank")


@query(f"""WITH {_ROWS}, k AS (SELECT *, row_number() OVER (ORDER BY confidence, key) AS e FROM d), z AS (SELECT {_SUMS} FROM d),
c AS (SELECT e, sum(n_gold - tp) OVER w AS gain, sum(fp) OVER w AS lfp, sum(fn) OVER w AS lfn, sum(1 - exact) OVER w AS lex FROM k WINDOW w AS (ORDER BY e) UNION ALL SELECT 0, 0, 0, 0, 0),
w AS (SELECT c.e, (z.tp + c.gain)::BIGINT AS tp, (z.fp - c.lfp)::BIGINT AS fp, (z.fn - c.lfn)::BIGINT AS fn, (z.ex + c.lex)::BIGINT AS ex, z.n FROM c, z) SELECT {_OUT} FROM w""")
def exact_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.exact_frontier(rows(spark, sf_dir), "confidence")


_FRACTIONS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40]


@query(f"""WITH {_ROWS}, q AS (SELECT 'confidence' AS ordering, key, row_number() OVER (ORDER BY confidence, key) AS rank FROM d UNION ALL SELECT 'agreement', key, row_number() OVER (ORDER BY agreement, key) FROM d
  UNION ALL SELECT 'conf_x_agree', key, row_number() OVER (ORDER BY conf_x_agree, key) FROM d UNION ALL SELECT 'oracle', key, row_number() OVER (ORDER BY fp + fn DESC, key) FROM d UNION ALL SELECT 'random', key, row_number() OVER (ORDER BY sha256('42|' || key), key) FROM d),
f AS (SELECT unnest({_FRACTIONS}::DOUBLE[]) AS fraction), z AS (SELECT count(*) AS all_n FROM d),
w AS (SELECT ordering, fraction, {_escalated('rank <= floor(fraction * all_n)')} FROM q JOIN d USING (key), f, z GROUP BY 1, 2) SELECT ordering, fraction, {_OUT} FROM w""")
def gate_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.gate_curves(rows(spark, sf_dir), _FRACTIONS)


@query(f"""WITH {_ROWS}, k AS (SELECT fp + fn > 0 AS wrong, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS r FROM d)
SELECT (sum(r) FILTER (NOT wrong) - count(*) FILTER (NOT wrong) * (count(*) FILTER (NOT wrong) + 1) / 2.0) / ((count(*) FILTER (NOT wrong))::DOUBLE * count(*) FILTER (wrong)) AS auroc, count(*) FILTER (wrong) AS wrong_rows, count(*) FILTER (NOT wrong) AS right_rows FROM k""")
def routing_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.auroc(rows(spark, sf_dir), "confidence")


def _auroc_sql(signal: str) -> str:
    return f"""SELECT '{signal}' AS signal, (sum(r) FILTER (NOT wrong) - count(*) FILTER (NOT wrong) * (count(*) FILTER (NOT wrong) + 1) / 2.0) / ((count(*) FILTER (NOT wrong))::DOUBLE * count(*) FILTER (wrong)) AS auroc
FROM (SELECT fp + fn > 0 AS wrong, rank() OVER (ORDER BY {signal}) + (count(*) OVER (PARTITION BY {signal}) - 1) / 2.0 AS r FROM d)"""


@query(f"WITH {_ROWS} {' UNION ALL '.join(map(_auroc_sql, ('confidence', 'agreement', 'min_agreement', 'conf_x_agree')))}")
def comparison_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUROC table of the comparison of all signals."""
    r = cut(rows(spark, sf_dir))
    dims = r.select("key", F.lit("all").alias("dimension"), F.lit("all").alias("bucket"))
    return validation.comparison(r, ["confidence", "agreement", "min_agreement", "conf_x_agree"], dims, tables=("auroc",))["auroc"].select("signal", "auroc")


@query(f"""WITH {_ROWS}, v AS (SELECT DISTINCT agreement AS v FROM d), m AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, (v + lead(v) OVER (ORDER BY v)) / 2 AS tau FROM v), k AS (SELECT count(*) AS n FROM m WHERE tau IS NOT NULL),
j AS (SELECT DISTINCT floor(j * (n / 39.0::DOUBLE))::BIGINT AS i FROM k, range(39) AS x(j))
SELECT tau FROM m, k WHERE tau IS NOT NULL AND (n <= 39 OR i IN (SELECT i FROM j)) UNION SELECT 0.0 UNION SELECT max(v) + 1e-9::DOUBLE FROM v""")
def quantile_taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quantile_taus(rows(spark, sf_dir), "agreement", 41)


@query(f"""WITH {_ROWS}, b AS (SELECT *, 1.0::DOUBLE - confidence AS pe FROM d), v AS (SELECT DISTINCT pe AS v FROM b UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE + 1e-9::DOUBLE), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS m FROM v),
j AS (SELECT DISTINCT least(floor(j * (m / 41.0::DOUBLE))::BIGINT, m - 1) AS i FROM (SELECT max(m) AS m FROM k), range(41) AS x(j)), t AS (SELECT v AS theta FROM k WHERE m <= 41 OR i IN (SELECT i FROM j)),
w AS (SELECT theta, {_escalated('pe >= theta')} FROM b, t GROUP BY 1) SELECT theta, {_OUT} FROM w""")
def escalate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.escalate_sweep(rows(spark, sf_dir).withColumn("p_escalate", 1.0 - F.col("confidence")), "p_escalate")


_ROUTE = "CASE WHEN confidence < 0.4 THEN 'escalate' WHEN says_none THEN 'skip' ELSE 'extract' END"


@query(f"""WITH {_ROWS}, b AS (SELECT *, {_ROUTE} AS route FROM d), a AS (SELECT count(*) AS n, count(*) FILTER (route = 'extract') AS n_extract, count(*) FILTER (route = 'escalate') AS n_escalate, count(*) FILTER (route = 'skip') AS n_skip,
  sum(CASE route WHEN 'escalate' THEN n_gold WHEN 'extract' THEN tp ELSE 0 END)::BIGINT AS tp, sum(CASE route WHEN 'extract' THEN fp ELSE 0 END)::BIGINT AS fp, sum(CASE route WHEN 'extract' THEN fn WHEN 'skip' THEN n_gold ELSE 0 END)::BIGINT AS fn FROM b) SELECT n, n_extract, n_escalate, n_skip, {_rates('tp', 'fp', 'fn')} FROM a""")
def routed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.routed_scores(rows(spark, sf_dir).withColumn("route", F.expr(_ROUTE)))


_ITEM = "coalesce(min(trim(item_key)), '')"


@query(f"""WITH {_ROWS}, i AS (SELECT chunk_id, {_ITEM} AS item FROM company_relationships WHERE chunk_id IS NOT NULL GROUP BY 1),
b AS (SELECT key, 'positive' AS dimension, CASE WHEN n_gold > 0 THEN 'true' ELSE 'false' END AS bucket FROM d UNION SELECT key, 'relation', x.rel FROM (SELECT key, unnest(g) AS x FROM d) UNION SELECT key, 'item_key', coalesce(item, '') FROM d LEFT JOIN i USING (chunk_id)),
k AS (SELECT key, row_number() OVER (ORDER BY confidence, key) <= floor(0.2::DOUBLE * count(*) OVER ()) AS esc FROM d), w AS (SELECT dimension, bucket, {_escalated('esc')} FROM b JOIN d USING (key) JOIN k USING (key) GROUP BY 1, 2)
SELECT dimension, bucket, n, n >= 30 AS gating, {_rates('tp', 'fp', 'fn', 'ex', 'n')} FROM w""")
def bucket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at a fifth escalated, by having gold, by relation of the gold, by item of the chunk."""
    o = outcomes(spark, sf_dir)
    item = table(spark, sf_dir, "company_relationships").filter("chunk_id is not null").groupBy("chunk_id").agg(F.coalesce(F.min(F.trim("item_key")), F.lit("")).alias("item"))
    key = F.col("outcome_id").alias("key")
    positive = o.select(key, F.lit("positive").alias("dimension"), (F.size(or_empty(F.col("gold"))) > 0).cast("string").alias("bucket"))
    relation = o.select(key, F.explode("gold").alias("g")).select("key", F.lit("relation").alias("dimension"), F.col("g.rel").alias("bucket"))
    by_item = o.join(item, "chunk_id", "left").select(key, F.lit("item_key").alias("dimension"), F.coalesce("item", F.lit("")).alias("bucket"))
    return cascade.bucket_report(rows(spark, sf_dir), positive.unionByName(relation).unionByName(by_item), "confidence", 0.2)


@query("""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, 'q' || (least(3, (r * 4) // n) + 1) AS bucket FROM l""")
def length_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return cascade.rank_buckets(d, [F.col("n_chars").asc_nulls_first(), F.col("doc_id").asc()], 4, "q", "bucket").select("doc_id", "bucket")


@query("""WITH c AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY events, user_id) - 1 AS r, count(*) OVER () AS n FROM c) SELECT user_id, 'd' || (least(9, (r * 10) // n) + 1) AS bucket FROM l""")
def volume_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return cascade.rank_buckets(c, [F.col("events").asc(), F.col("user_id").asc()], 10, "d", "bucket").select("user_id", "bucket")


@query("SELECT user_id, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY 1")
def cost_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[(c if n == "max" else F.round(c, 6)).alias(n) for n, c in traverse.cost_statistics(F.col("value")).items()])


@query(f"""WITH {_ROWS}, f AS (SELECT key, agreement AS pred, CASE WHEN len(g) + len(r) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len([x FOR x IN g IF list_contains(r, x)]) / (len(g) + len(r)) END AS gold FROM d),
k AS (SELECT *, row_number() OVER (ORDER BY pred, key) AS rp, row_number() OVER (ORDER BY gold, key) AS rg FROM f)
SELECT count(*) AS n, round(avg(abs(pred - gold)), 6) AS mae, round(avg((pred - gold) ** 2), 6) AS mse, round(corr(rp, rg), 6) AS spearman, round((sum(rp) FILTER (gold > 0.5) - count(*) FILTER (gold > 0.5) * (count(*) FILTER (gold > 0.5) + 1) / 2.0) / ((count(*) FILTER (gold > 0.5))::DOUBLE * count(*) FILTER (gold <= 0.5)), 6) AS auc FROM k""")
def gate_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir).select(F.col("outcome_id").alias("key"), F.coalesce("agreement", F.lit(1.0)).alias("pred"), chunk_f1(F.col("gold"), F.col("pred")).alias("gold"))
    m = cascade.gate_metrics(o, "pred", "gold")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "spearman", "auc")])


@query(f"""WITH {_ROWS} SELECT key, CASE WHEN len(g) + len(r) = 0 THEN 1.0 ELSE 2.0 * len([x FOR x IN g IF list_contains(r, x)]) / (len(g) + len(r)) END AS f1 FROM d""")
def chunk_f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select(F.col("outcome_id").alias("key"), chunk_f1(F.col("gold"), F.col("pred")).alias("f1"))


_BUDGETS = f"""q AS (SELECT 'confidence' AS signal, key, row_number() OVER (ORDER BY confidence, key) AS rank FROM d UNION ALL SELECT 'agreement', key, row_number() OVER (ORDER BY agreement, key) FROM d UNION ALL SELECT 'min_agreement', key, row_number() OVER (ORDER BY min_agreement, key) FROM d),
f AS (SELECT unnest([0.15, 0.2, 0.25]::DOUBLE[]) AS budget), z AS (SELECT count(*) AS all_n FROM d),
w AS (SELECT signal, budget, {_escalated('rank <= floor(budget * all_n)')} FROM q JOIN d USING (key), f, z GROUP BY 1, 2), bm AS (SELECT signal, budget, {_OUT} FROM w)"""


@query(f"WITH {_ROWS}, {_BUDGETS} SELECT * FROM bm")
def signal_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.budget_metrics(cut(rows(spark, sf_dir)), ["confidence", "agreement", "min_agreement"])


@query(f"""WITH {_ROWS}, {_BUDGETS}, j AS (SELECT a.signal, a.recall - b.recall AS dr, a.f1 - b.f1 AS df, a.exact - b.exact AS dx FROM bm a JOIN bm b ON a.budget = b.budget AND b.signal = 'confidence' WHERE a.signal <> 'confidence'),
r AS (SELECT signal, bool_and(dr >= -0.002 AND df >= -0.002 AND dx >= -0.005) AND bool_or(dr >= 0.005 OR df >= 0.005) AS ready FROM j GROUP BY 1) SELECT CASE WHEN bool_or(ready) THEN 'ECONOMICS_READY' ELSE 'SIGNAL_NO_GO' END AS verdict FROM r""")
def signal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = validation.budget_metrics(cut(rows(spark, sf_dir)), ["confidence", "agreement", "min_agreement"])
    return validation.signal_verdict(cut(m))


@query(f"WITH {_ROWS}, w AS (SELECT {_escalated('confidence < 0.85')} FROM d) SELECT n, e AS escalated_calls, e::DOUBLE / n AS escalation_rate, {_rates('tp', 'fp', 'fn', 'ex', 'n')} FROM w")
def frozen_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen policy's counts and metrics (its digests are tested against a brute-force version)."""
    f = validation.freeze(rows(spark, sf_dir).withColumn("ordinal", F.col("key")), 0.85)
    return f.select("n", "escalated_calls", "escalation_rate", "precision", "recall", "f1", "exact")


_FROZEN = "n, e AS escalated_calls, e::DOUBLE / n AS escalation_rate, " + _rates("tp", "fp", "fn", "ex", "n")


@query(f"""WITH {_ROWS}, w AS (SELECT 1 AS g, {_escalated('confidence < 0.85')} FROM d UNION ALL SELECT 2, {_escalated('confidence < 0.8')} FROM d), x AS (SELECT g, {_FROZEN} FROM w), b AS (SELECT * FROM x WHERE g = 1), c AS (SELECT * FROM x WHERE g = 2)
SELECT (CASE WHEN b.escalated_calls <> c.escalated_calls THEN 'decision_sha256,escalated_calls' ELSE '' END || CASE WHEN abs(b.f1 - c.f1) > 0.002 THEN ',f1' ELSE '' END || CASE WHEN abs(b.recall - c.recall) > 0.002 THEN ',recall' ELSE '' END
  || CASE WHEN abs(b.escalation_rate - c.escalation_rate) > 0.002 THEN ',escalation_rate' ELSE '' END) AS failures, '' AS same FROM b, c""")
def reproduction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy at another threshold fails to reproduce, and that the same policy over repartitioned rows reproduces itself."""
    r = rows(spark, sf_dir).withColumn("ordinal", F.col("key"))
    a = cut(validation.freeze(r, 0.85))
    other = validation.reproduction_failures(a, cut(validation.freeze(r, 0.8))).select(F.array_join("failures", ",").alias("failures"))
    same = validation.reproduction_failures(a, cut(validation.freeze(r.repartition(5), 0.85))).select(F.array_join("failures", ",").alias("same"))
    return other.crossJoin(same)  # two tables of one row


@query(f"""WITH {_ROWS}, {_TAUS}, {_SWEEP} SELECT 'tau=' || printf('%.4f', tau) AS run, escalation_rate AS mean_cost, recall AS accuracy, (SELECT count(*) FROM d) AS n_questions FROM sw""")
def frontier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    s = sinks.threshold_summaries(cascade.sweep(r, "confidence", _taus(spark, TAUS)), r.count())
    return cascade.run_rows(s, "llm_calls", "recall")


@query(f"""WITH {_ROWS}, {_TAUS}, {_SWEEP} SELECT max(recall) FILTER (escalation_rate <= 0.25) AS accuracy FROM sw""")
def accuracy_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sinks.threshold_summaries(cascade.sweep(rows(spark, sf_dir), "confidence", _taus(spark, TAUS)), 0)
    return cascade.accuracy_at(cascade.run_rows(s, "llm_calls", "recall"), 0.25)


@query(f"""WITH {_ROWS}, {_TAUS}, {_SWEEP} SELECT min(escalation_rate) FILTER (recall >= 0.8) AS mean_cost FROM sw""")
def cost_at_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sinks.threshold_summaries(cascade.sweep(rows(spark, sf_dir), "confidence", _taus(spark, TAUS)), 0)
    return cascade.cost_at(cascade.run_rows(s, "llm_calls", "recall"), 0.8)


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6::DOUBLE), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("reward"))
    return construct.advantages(e, ["user_id"], scale=True).select("event_id", F.round("advantage", 6).alias("advantage"))
