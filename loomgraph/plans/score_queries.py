"""Queries of rewards, losses, advantages, scores and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, metrics, text
from ..operators import construct, governance, graph, training, traverse
from .graph_queries import table
from .lineage import cut
from .registry import query
from .traversal_queries import _WALK, _run, _scored


@query(f"""WITH {_WALK} SELECT qid, round(f1 - 0.1::DOUBLE * least(1.0, llm_calls / 20.0), 6) AS reward, round(hit - 0.1::DOUBLE * least(1.0, llm_calls / 20.0), 6) AS hit_reward,
round(f1 - 0.5::DOUBLE * least(1.0, greatest(0, llm_calls - 2) / 20.0), 6) AS regret_reward FROM r""")
def trajectory_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of the degree controller's trajectories: by F1, by hit, and against an oracle of two calls."""
    r = _scored(spark, sf_dir)
    a, g, c, n = F.col("answers"), F.col("golds"), F.col("llm_calls"), F.col("n_golds")
    made = {"reward": metrics.reward(a, g, c, n_gold=n), "hit_reward": metrics.reward(a, g, c, correct="hit"), "regret_reward": metrics.reward(a, g, c, lam=0.5, mode="regret", oracle=F.lit(2), n_gold=n)}
    return r.select("qid", *[F.round(v, 6).alias(k) for k, v in made.items()])


@query(f"""WITH {_WALK}, t AS (SELECT qid, 0 AS position, relation FROM c0 UNION ALL SELECT qid, 1, relation FROM c1 UNION ALL SELECT qid, 2, NULL FROM n2)
SELECT qid, position, relation, hit AS reward, round(hit + 0.1::DOUBLE * (3 - position), 6) AS shaped FROM t JOIN r USING (qid)""")
def shaped_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with the reward shaped by distances that fall by one a hop, from three to none."""
    d = graph.shaping_deltas(F.array(*[F.lit(x) for x in (3, 2, 1)]), F.lit(0), 0.1)
    out = traverse.rollout_rows(_scored(spark, sf_dir), F.col("hit"), d)
    return out.select("qid", "position", "action.relation", "reward", F.round("shaped", 6).alias("shaped"))


@query(f"WITH {_WALK}, p AS (SELECT qid, string_agg('- ' || chain, chr(10) ORDER BY i) AS paths FROM (SELECT qid, i, chain FROM f2 UNION ALL SELECT qid, i, chain FROM f1 WHERE qid NOT IN (SELECT qid FROM f2)) GROUP BY 1) SELECT r.qid, coalesce(paths, '- (no paths retrieved)') AS paths FROM r LEFT JOIN p USING (qid)")
def verbalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path reader is shown of each final frontier."""
    return _run(spark, sf_dir).select("qid", text.verbalize_paths(F.col("frontier")).alias("paths"))


@query(f"WITH {_WALK}, x AS (SELECT qid, node, i FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i) = 1) SELECT r.qid, CASE WHEN contains(x.node, ',') OR contains(x.node, ';') OR x.node <> trim(x.node) OR x.node LIKE '%.' OR x.node LIKE '.%' OR contains(x.node, chr(10)) THEN '?' ELSE x.node END AS answer FROM r JOIN x USING (qid)")
def path_reader_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that writes the first node in capitals and a name from nowhere; names that its answer format cannot hold are shown as ``?``."""
    first = traverse._node(F.get(F.col("frontier"), F.lit(0)))
    reader = traverse.PathReader(lambda prompt: F.concat(F.upper(first), F.lit(", nobody knows.")))
    r = _run(spark, sf_dir).withColumn("answers", reader.answers())
    plain = ~first.rlike(r"(?s)[,;\n]|^[\s.]|[\s.]$")
    return r.select("qid", F.when(plain, F.get("answers", F.lit(0))).otherwise("?").alias("answer"))


_LAST_EXAMPLE = "l AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC NULLS LAST, faithfulness DESC NULLS LAST) AS k FROM judge_examples WHERE example_id IS NOT NULL)"


@query("SELECT verdict, faithfulness, count(*) AS n, CASE WHEN verdict = 'reject' THEN 0.0 WHEN faithfulness IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, faithfulness)) END AS score FROM judge_examples WHERE verdict IN ('accept', 'reject') GROUP BY 1, 2")
def critic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the critic's verdicts."""
    j = table(spark, sf_dir, "judge_examples").filter("verdict in ('accept', 'reject')").groupBy("verdict", "faithfulness").agg(F.count("*").alias("n"))
    return j.withColumn("score", construct.critic_score(F.col("verdict"), F.col("faithfulness")))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS t FROM e), s AS (SELECT vec_id, v, t + ln(list_sum([exp(x - t) FOR x IN v])) AS whole FROM m) SELECT vec_id, round(v[1] - whole, 5) AS first, round(list_max(v) - whole, 5) AS best FROM s")
def log_softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of the first and the best of a vector's entries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", metrics.log_softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return e.select("vec_id", F.round(F.get("p", F.lit(0)), 5).alias("first"), F.round(F.array_max("p"), 5).alias("best"))


@query("SELECT event_id, round(CASE WHEN user_id % 4 > 0 THEN exp(-value / 100 / (user_id % 4)) ELSE 1.0 END, 6) AS confidence, round(CASE WHEN user_id % 5 > 0 THEN exp(-value / 200 / (user_id % 5)) ELSE 1.0 END, 6) AS agreement, round(exp(-value / 300), 6) AS min_agreement FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL")
def decode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding confidence and agreements of logged masses (an event's value, its user's number as the length)."""
    e = table(spark, sf_dir, "events").filter("value is not null and user_id is not null")
    v, u = F.col("value"), F.col("user_id")
    return e.select(
        "event_id", F.round(metrics.decode_confidence(-v / 100, u % 4), 6).alias("confidence"), F.round(metrics.agreement(-v / 200, u % 5), 6).alias("agreement"), F.round(metrics.min_agreement(-v / 300), 6).alias("min_agreement")
    )


_STEPS = """e AS (SELECT user_id AS update, event_id % 8 AS rollout, 1 + event_id % 5 AS tokens, value / 500 AS lp, value / 400 AS old, value / 450 AS ref, CASE WHEN event_type = 'click' THEN 1.0 ELSE -0.5 END AS adv FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
l AS (SELECT *, -least(exp(lp - old) * adv, greatest(0.8::DOUBLE, least(1.28::DOUBLE, exp(lp - old))) * adv) + 0.04::DOUBLE * (lp - ref) / tokens AS loss FROM e)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null and user_id is not null")
    return e.select(
        F.col("user_id").alias("update"), (F.col("event_id") % 8).alias("rollout"), (1 + F.col("event_id") % 5).alias("tokens"), (F.col("value") / 500).alias("lp"), (F.col("value") / 400).alias("old"),
        (F.col("value") / 450).alias("ref"), F.when(F.col("event_type") == "click", 1.0).otherwise(-0.5).alias("adv"),
    )


@query(f"WITH {_STEPS}, g AS (SELECT update, rollout, avg(loss) AS a, sum(loss * tokens) / 64 AS b FROM l GROUP BY 1, 2) SELECT update, round(avg(a), 6) AS grpo, round(avg(b), 6) AS dr_grpo FROM g GROUP BY 1")
def policy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by both norms over logged steps (events: a user is an update, a step's rollout and tokens come from its number)."""
    s = _steps(spark, sf_dir)
    loss = training.step_loss(F.col("adv"), F.col("lp"), F.col("old"), F.col("tokens"), F.col("ref"), kl=0.04)
    a, b = training.batch_loss(s, loss), training.batch_loss(s, loss, "dr_grpo", 64.0).withColumnRenamed("loss", "b")
    return a.join(b, "update").select("update", F.round("loss", 6).alias("grpo"), F.round("b", 6).alias("dr_grpo"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id, event_type), 6) AS advantage FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def matched_pair_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards against the mean at the same position of the same episode (events: users and types)."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null").withColumnRenamed("value", "reward")
    return training.matched_advantages(e, ["user_id"], "event_type").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT user_id AS update, count(*) AS n_rollouts, round(avg(value), 6) AS mean_reward, round(avg(value / 2), 6) AS mean_precision, round(avg(value / 4), 6) AS mean_recall, avg((event_type = 'click')::INT) AS mean_escalated, avg((event_type = 'view')::INT) AS mean_skip, avg((event_type = 'purchase')::INT) AS mean_extract FROM events GROUP BY 1")
def update_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy run's records (events: a user is an update, the type the route)."""
    e = table(spark, sf_dir, "events")
    of = lambda t: (F.col("event_type") == t).cast("int")
    r = e.select(F.col("user_id").alias("update"), F.col("value").alias("reward"), (F.col("value") / 2).alias("precision"), (F.col("value") / 4).alias("recall"), of("click").alias("n_escalated"), of("view").alias("n_skip"), of("purchase").alias("n_extract"))
    out = training.update_records(r)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_reward", "mean_precision", "mean_recall")})


@query("""SELECT sha256(coalesce(string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' || chr(10), '' ORDER BY n_nationkey), '')) AS digest FROM nation""")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the nations' canonical JSON lines."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))).alias("row"))
    return spark.createDataFrame([(digest.jsonl_digest(n, "n_nationkey", F.col("row")),)], "digest string")


@query(f"""WITH {_LAST_EXAMPLE} SELECT example_id, 'confidence: ' || CASE WHEN faithfulness IS NULL THEN 'unknown' ELSE printf('%.1f', floor(greatest(0.0, least(1.0, faithfulness)) * 10) / 10) END || chr(10) || 'filer: ' || filer AS head,
lower(trim(filer)) AS filer, lower(trim(target)) AS target FROM l WHERE k = 1 AND filer IS NOT NULL AND target IS NOT NULL AND text IS NOT NULL AND filer = regexp_replace(filer, '^\\s+|\\s+$', '', 'g') AND target = regexp_replace(target, '^\\s+|\\s+$', '', 'g')""".replace("\\\\", "\\"))
def gate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of each example's gate input, and its claim's key."""
    last = F.max_by(F.struct("filer", "target", "text", "faithfulness", "relation"), F.struct("loaded_at", "faithfulness")).alias("x")
    j = table(spark, sf_dir, "judge_examples").filter("example_id is not null").groupBy("example_id").agg(last).select("example_id", "x.*")
    j = j.filter("filer is not null and target is not null and text is not null").filter(r"not filer rlike '^\\s|\\s$' and not target rlike '^\\s|\\s$'")
    key = text.claim_key(F.col("filer"), F.col("relation"), F.col("target"))
    return j.select("example_id", F.array_join(F.slice(F.split(text.gate_input(F.col("filer"), F.col("text"), F.col("faithfulness")), "\n"), 1, 2), "\n").alias("head"), key["filer"].alias("filer"), key["target"].alias("target"))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END, 6) AS by_rules, round(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE greatest(0.0, least(1.0, c_acctbal / 5000)) END, 6) AS by_model FROM customer""")
def judge_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same claims judged by the rules alone and with a model's type scores; the distant judge is none."""
    assert training.choose_judge("distant") is None
    gates = F.struct((F.col("c_acctbal") >= 0).alias("passed"))
    gold = F.col("c_mktsegment") == "BUILDING"
    rules, model = training.choose_judge("rules"), training.choose_judge("folder", lambda _: F.col("c_acctbal") / 5000)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(rules(gates, gold), 6).alias("by_rules"), F.round(model(gates, gold), 6).alias("by_model"))
