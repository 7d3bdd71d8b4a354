"""Whole jobs, from files to files: what the command line tools of such a system do, as plain functions."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, construct, governance, traverse
from ..sources import kgqa, sinks, telemetry, synthetic
from .lineage import cut

FIXED_TAUS = [round(0.05 * i, 2) for i in range(22)]


def generate_questions(spark: SparkSession, folder: str, companies: int = 120, n: int = 600, depths: Sequence[int] = (1, 2, 3), seed: int = 42) -> int:
    """A synthetic graph, questions over it with their subgraphs, in three splits by position. Gives the number of questions."""
    e = cut(synthetic.graph(spark, companies, seed))
    qs = None
    for d in depths:
        part = synthetic.questions(e, n // len(depths), d, seed)
        qs = part if qs is None else qs.unionByName(part)
    qs = cut(qs.dropDuplicates(["qid"]))
    from ..operators.graph import neighborhood

    near = neighborhood(qs.select("qid", F.col("topic").alias("node")), e, max(depths), seed=seed)
    graphs = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "head", "relation", "tail"))), lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"))).alias("graph"))
    full = qs.join(graphs, "qid").withColumn("topics", F.array("topic"))
    placed = sinks.position_split(full, [F.col("qid")])
    sinks.write_splits(sinks.question_record(placed).join(placed.select(F.col("qid").alias("id"), "split"), "id"), folder)
    return qs.count()


def build_pairs(spark: SparkSession, folder: str, export: str | None = None, floor: float = 0.7, seed: int = 42) -> dict:
    """Pairs of an export, or synthetic ones, in leakage-safe splits with their vocabulary. Gives their counts."""
    p = construct.group_export(kgqa.load_export(spark, export), floor) if export else synthetic.pairs(synthetic.graph(spark, seed=seed), seed=seed)
    p = cut(p)
    sinks.export_pairs(p, folder, seed=seed)
    return construct.counts(p).first().asDict()


def split_judge(spark: SparkSession, export: str, folder: str, negatives: bool = False, seed: int = 42) -> int:
    """A judge export in splits by filing; ``negatives``: wrong-direction claims added to train only. Gives the rows left out."""
    raw = spark.read.schema("evidence_text string, chunk_text string, filer string, relationship_type string, target string, faithfulness double, verdict string, accession_number string").json(export)
    rows, skipped = construct.judge_rows(cut(raw.withColumn("ordinal", F.monotonically_increasing_id())))
    if not rows.limit(1).count():
        raise ValueError(f"{export} has no usable rows")
    s = cut(construct.unit_split(rows, F.col("filing"), (0.9, 0.05, 0.05), seed))
    if negatives:
        s = s.unionByName(construct.direction_negatives(s.filter("split = 'train'")).withColumn("split", F.lit("train")), allowMissingColumns=True)
    sinks.write_splits(s.drop("ordinal"), folder)
    return skipped.first().skipped


def gate_data(outcomes: DataFrame, pairs: DataFrame, folder: str, hardness: bool = False) -> None:
    """Gate examples of outcomes and pairs (both with ``key``), the target the F1 or the hardness, in train and dev."""
    g = construct.gate_rows(outcomes, pairs, "key")
    if hardness:
        h = pairs.select("key", construct.hard_chunk(F.col("triples"), F.col("text"), F.col("filer")).cast("double").alias("target"))
        g = g.drop("target").join(h, "key")
    sinks.write_splits(construct.dev_split(g.withColumn("ordinal", F.xxhash64("key"))), folder)


def cascade_report(outcomes: DataFrame, key: str, folder: str, min_recall: float = 0.8) -> dict[str, DataFrame]:
    """Sweeps of every signal, their summaries written, the cheapest threshold of each and its AUROC."""
    rows = cut(cascade.scored(outcomes, key))
    n, out = rows.count(), {}
    for s in cascade.signals():
        taus = rows.sparkSession.createDataFrame([(t,) for t in FIXED_TAUS], "tau double") if s == "confidence" else cascade.quantile_taus(rows, s)
        swept = cut(cascade.sweep(rows, s, taus))
        sinks.write_summaries(sinks.threshold_summaries(swept, n), f"{folder}/{s}")
        out[s] = swept
        out[f"{s} headline"] = cascade.headline(swept, min_recall)
        out[f"{s} auroc"] = cascade.auroc(rows, s)
    return out


def gate_report(outcomes: DataFrame, key: str, gate: DataFrame) -> DataFrame:
    """Curves of a gate's scores (``key, score``) beside the reference orderings; a row without a score is an error."""
    rows = cascade.scored(outcomes, key).join(gate.select("key", F.col("score").alias("gate")), "key", "left")
    whole = F.coalesce("gate", F.raise_error(F.lit("an outcome has no gate score")).cast("double"))
    return cascade.gate_curves(rows.withColumn("gate", whole), gate="gate")


def routing_report(outcomes: DataFrame, key: str, routes: DataFrame, curve: bool = False) -> DataFrame:
    """The scores of routed outcomes (``key, route[, p_escalate]``), or their curve over the escalation probability."""
    rows = cascade.scored(outcomes, key).join(routes, "key")
    return cascade.escalate_sweep(rows, "p_escalate") if curve else cascade.routed_scores(rows)


def frontier(spark: SparkSession, runs: str, out: str, cost: str = "llm_calls", accuracy: str = "hit") -> DataFrame:
    """Summaries below a folder as one table by mean cost, written as CSV."""
    rows = cascade.run_rows(kgqa.load_summaries(spark, runs), cost, accuracy)
    sinks.write_frontier(rows, out)
    return rows


def evaluate(spark: SparkSession, folder: str, split: str, dataset: str, controller: traverse.Controller, out: str, budget: traverse.Budget | None = None, policies: tuple[governance.HopPolicy, ...] = (), synthesizer: traverse.Synthesizer | None = None, config: dict | None = None) -> DataFrame:
    """Traverse a split's questions; write a row a question, one summary and, if given, the configuration."""
    recs = cut(kgqa.load_records(spark, folder, split, dataset))
    runs = cut(traverse.traverse(recs, kgqa.edges_of(recs), controller, budget, policies=policies, synthesizer=synthesizer))
    runs.select("qid", "answers", "golds", "hit", "hops", "llm_calls", "verdict").write.mode("overwrite").json(f"{out}/questions")
    s = traverse.summary(runs)
    s.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    if config is not None:
        text = json.dumps(config, default=str, ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/config")
    return s


def plot_telemetry(spark: SparkSession, folder: str, out: str) -> list[str]:
    """Pictures of a run's losses and policy log, of whichever there is; their paths (none without a plotting package)."""
    made = []
    for name, draw in (("trainer_state.json", telemetry.plot_losses), ("log.jsonl", telemetry.plot_run)):
        path = os.path.join(folder, name)
        if os.path.exists(path) and (p := draw(spark, path, os.path.join(out, name.split(".")[0] + ".png"))):
            made.append(p)
    return made


def mine(spark: SparkSession, folder: str, split: str, dataset: str, out: str, max_hops: int = 4) -> dict:
    """Mine a split's trajectories and write their supervised rows; gives the counters."""
    recs = cut(kgqa.load_records(spark, folder, split, dataset))
    hits, stats = traverse.mine(recs, kgqa.edges_of(recs), max_hops)
    sinks.write_jsonl(traverse.sft_rows(hits), out)
    return stats.first().asDict()


