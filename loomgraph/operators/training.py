"""The data sides of training: encoded examples, rollout records, advantages, losses over logged log-probabilities, and fits of small models.

Gradients of language models are taken elsewhere; everything before and after them is a table here.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import clipped_surrogate
from ..plans.ship import ship
from .decoding import ClaimGrammar, Scorer, completion_labels, encode_claims, extract, sentinel_logprob

Encode = Callable[[str], Sequence[int]]
_LONGS = pa.list_(pa.int64())
_CLAIMS = pa.list_(pa.struct([("rel", pa.string()), ("target", pa.string())]))


def _encoded(df: DataFrame, columns: Sequence[str], load: Callable, one: Callable) -> DataFrame:
    """``key, input_ids, labels, dropped``: ``one`` gives ids and labels of a row, or None for a row that cannot be encoded."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = load()
        for b in batches:
            rows = [one(tools, *r) for r in zip(*(b.column(i + 1).to_pylist() for i in range(len(columns))))]
            ids, labels = ([None if r is None else r[k] for r in rows] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, _LONGS), pa.array(labels, _LONGS), pa.array([r is None for r in rows])], ["key", "input_ids", "labels", "dropped"])

    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", *columns).mapInArrow(run, f"key {kind}, input_ids array<long>, labels array<long>, dropped boolean")


def controller_examples(rows: DataFrame, load: Callable[[], Encode], end: int, most: int) -> DataFrame:
    """Supervised decisions (``key, prompt, target``): only the target's tokens and the end have labels; prompts lose their beginning first."""

    def one(encode: Encode, prompt: str | None, target: str | None):
        if target is None:
            return None
        done = [*encode(" " + target), end]
        return completion_labels(list(encode(prompt or "")), done, most) if len(done) < most else None

    return _encoded(rows, ("prompt", "target"), load, one)


def extraction_examples(rows: DataFrame, load: Callable[[], tuple[Encode, ClaimGrammar]], most: int, sentinel: str = "ESCALATE") -> DataFrame:
    """Supervised extractions (``key, prompt, triples, escalate``): the target is the sentinel where ``escalate``, else the canonical claims.

    A row whose claims the grammar cannot give, or whose target leaves no room for a prompt, is marked ``dropped`` and has no ids.
    """

    def one(tools, prompt: str | None, triples, escalate):
        encode, g = tools
        try:
            done = list(g.sentinels[sentinel]) if escalate else encode_claims([(t["rel"], t["target"]) for t in triples or []], g)
        except ValueError:
            return None
        return completion_labels(list(encode(prompt or "")), done, most) if len(done) < most else None

    return _encoded(rows, ("prompt", "triples", "escalate"), load, one)


def surface_targets(pairs: DataFrame, spans: Column, match: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs with their gold targets as they stand in the text (``match`` of a target and the spans); claims without a match are left out and counted in ``unmatched``."""
    p = pairs.withColumn("_s", spans)
    told = F.transform("triples", lambda t: F.struct(t["rel"].alias("rel"), match(t["target"], F.col("_s")).alias("target")))
    kept = F.array_distinct(F.filter(told, lambda t: t["target"].isNotNull()))
    return p.withColumn("_t", told).withColumns({"triples": kept, "unmatched": F.size(F.filter("_t", lambda t: t["target"].isNull()))}).drop("_s", "_t")


def judge_examples(rows: DataFrame, load: Callable[[], Encode], most: int) -> DataFrame:
    """``key, input_ids, label``: rendered claims (``key, prompt, faithfulness``), long ones without their end."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(encode(t or ""))[:most] for t in b.column(1).to_pylist()], _LONGS), b.column(2)], ["key", "input_ids", "label"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "prompt", F.col("faithfulness").cast("double").alias("faithfulness")).mapInArrow(run, f"key {kind}, input_ids array<long>, label double")


# rollouts --------------------------------------------------------------------------------------------------------------
def claims_logprob(scorer: Scorer, g: ClaimGrammar, ids: Sequence[int]) -> tuple[float, int]:
    """Log-probability of a whole output under the grammar, and the number of its tokens; forced tokens add nothing."""
    from .decoding import claims_allowed_along, log_sum_exp

    total = 0.0
    for k, options in enumerate(claims_allowed_along(g, ids)):
        if len(options) > 1:
            scores = scorer(tuple(ids[:k]), options)
            scores = list(scores[0] if isinstance(scores, tuple) else scores)
            total += scores[options.index(ids[k])] - log_sum_exp(scores)
    return total, len(ids)


_ROLLOUT = "key string, rollout int, ids array<long>, triples array<struct<rel:string,target:string>>, sentinel string, logprob double, n_choices int"


def rollouts(chunks: DataFrame, scorer_of: Callable[[], Callable[[str], Scorer]], grammar_of: Callable[[], ClaimGrammar], n: int, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """``n`` sampled outputs of each chunk (``key``, ``prompt``). The same seed, key and rollout give the same sample on any worker."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, g = scorer_of(), grammar_of()
        names = [f.split()[0] for f in _ROLLOUT.split(", ")]
        kinds = [pa.string(), pa.int32(), _LONGS, _CLAIMS, pa.string(), pa.float64(), pa.int32()]
        for b in batches:
            rows = []
            for key, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in range(n):
                    x = extract(scorer(prompt or ""), g, temperature, random.Random(f"{seed}/{key}/{k}"))
                    rows.append((key, k, list(x.ids), [{"rel": r, "target": t} for r, t in x.triples], x.sentinel, x.logprob, x.n_choices))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    return chunks.select("key", "prompt").mapInArrow(run, _ROLLOUT)


_ROUTED = "key string, p_escalate double, triples array<struct<rel:string,target:string>>, confidence double"


def routing_outcomes(chunks: DataFrame, scorer_of: Callable[[], Callable[[str], Scorer]], grammar_of: Callable[[], ClaimGrammar], plain_of: Callable[[], ClaimGrammar]) -> DataFrame:
    """Two passes over each chunk (``key``, ``prompt``): the probability of escalating, and what is extracted by the grammar without that way out."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        scorer, g, plain = scorer_of(), grammar_of(), plain_of()
        for b in batches:
            keys, prompts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [(math.exp(sentinel_logprob(scorer(p or ""), g)), extract(scorer(p or ""), plain)) for p in prompts]
            claims = [[{"rel": r, "target": t} for r, t in x.triples] for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([p for p, _ in found], pa.float64()), pa.array(claims, _CLAIMS), pa.array([x.confidence for _, x in found], pa.float64())], ["key", "p_escalate", "triples", "confidence"])

    return chunks.select("key", "prompt").mapInArrow(run, _ROUTED)


# advantages and losses -------------------------------------------------------------------------------------------------
def matched_advantages(rewards: DataFrame, episode: Sequence[str], position: str) -> DataFrame:
    """``rewards`` (one row a rollout and position) with ``advantage``: the reward less the mean of all rollouts at the same position of the same episode.

    The means are had by an aggregation and joined back, so an episode of any number of rollouts is no window.
    """
    on = [*episode, position]
    return rewards.join(rewards.groupBy(*on).agg(F.avg("reward").alias("_mean")), on).withColumn("advantage", F.col("reward") - F.col("_mean")).drop("_mean")


def step_loss(advantage: Column, logprob: Column, old: Column, tokens: Column, reference: Column | None = None, kl: float = 0.0, low: float = 0.2, high: float = 0.28) -> Column:
    """Negative clipped surrogate of exp(logprob - old), plus ``kl`` times (logprob - reference) a token."""
    loss = -clipped_surrogate(F.exp(logprob - old), advantage, low, high)
    return loss if reference is None else loss + kl * (logprob - reference) / F.greatest(tokens, F.lit(1))


def batch_loss(steps: DataFrame, loss: Column, norm: str = "grpo", constant: float = 1.0, update: str = "update", rollout: str = "rollout", tokens: str = "tokens") -> DataFrame:
    """``update, loss`` of steps with their rollout and tokens: mean over rollouts of the mean over steps (``grpo``), or of the token-weighted sum over a constant (``dr_grpo``)."""
    if norm not in ("grpo", "dr_grpo"):
        raise ValueError(f"unknown loss norm {norm!r}")
    s = steps.withColumn("_l", loss)
    each = F.avg("_l") if norm == "grpo" else F.sum(F.col("_l") * F.col(tokens)) / constant
    return s.groupBy(update, rollout).agg(each.alias("_l")).groupBy(update).agg(F.avg("_l").alias("loss"))


def update_records(episodes: DataFrame, update: str = "update") -> DataFrame:
    """A row an update over its rollouts (``reward, precision, recall, n_escalated, n_skip, n_extract``): means, and how many."""
    names = {"reward": "reward", "precision": "precision", "recall": "recall", "n_escalated": "escalated", "n_skip": "skip", "n_extract": "extract"}
    return episodes.groupBy(update).agg(F.count("*").alias("n_rollouts"), *[F.avg(c).alias(f"mean_{n}") for c, n in names.items()])


# small models ----------------------------------------------------------------------------------------------------------
def fit_scores(rows: DataFrame, features: Sequence[str], target: str, binary: bool = True, regularization: float = 0.01):
    """A logistic (``binary``) or linear model of ``target`` over numeric features, nulls as 0, fitted by the cluster. Gives a pipeline model; see ``predict``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ready = rows.select(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features], F.col(target).cast("double").alias("_y")).filter("_y is not null")
    last = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=regularization) if binary else LinearRegression(featuresCol="_x", labelCol="_y", regParam=regularization)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), last]).fit(ready)


def predict(model, rows: DataFrame, features: Sequence[str], key: str = "key") -> DataFrame:
    """``key, score`` clamped to 0..1: the probability of a logistic model, the value of a linear one."""
    from pyspark.ml.functions import vector_to_array

    ready = rows.select(key, *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    out = model.transform(ready)
    value = vector_to_array(F.col("probability"))[1] if "probability" in out.columns else F.col("prediction")
    return out.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))


def choose_judge(spec: str, type_scores: Callable[[str], Column] | None = None) -> Callable[[Column, Column], Column] | None:
    """A reward judge by name: ``distant`` is none (gold decides), ``rules`` scores by the gates, anything else is a model's folder.

    A judge takes the gates' result and whether the claim is gold. ``type_scores`` gives the scores column of the model in a folder.
    """
    from .governance import rule_judge

    if spec == "distant":
        return None
    if spec == "rules":
        return lambda gates, in_gold: rule_judge(gates, in_gold)
    if type_scores is None:
        raise ValueError(f"no way to load the judge {spec!r}")
    scores = type_scores(spec)
    return lambda gates, in_gold: rule_judge(gates, in_gold, scores)
