"""Writing tables as JSON lines, CSV and summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import TYPES
from ..operators.construct import split_pairs, unit_split, vocabulary
from ..plans.files import write_text
from ..plans.prefix import running


#: targets that are gathered in one record at most
IN_ONE = 1_000_000


def write_jsonl(df: DataFrame, path: str) -> int:
    """Rows as JSON lines, non-ASCII text as it is; gives their number."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def pair_record(pairs: DataFrame) -> DataFrame:
    """Pairs as they stand on disk: claims as arrays of relation and target."""
    two = lambda c: F.transform(c, lambda t: F.array(t["rel"], t["target"])).alias(c)
    return pairs.select("text", "filer", two("triples"), "filing", "confidence", "company", "item_key", "chunk", two("uncertain"))


def question_record(questions: DataFrame) -> DataFrame:
    """Questions as they stand on disk: golds sorted, edges as arrays of three."""
    edges = F.transform("graph", lambda t: F.array(t["head"], t["relation"], t["tail"]))
    cols = [F.col("qid").alias("id"), "question", F.col("topics").alias("q_entity"), F.array_sort("golds").alias("a_entity"), edges.alias("graph")]
    return questions.select(*cols, *(["path"] if "path" in questions.columns else []))


def position_split(df: DataFrame, order: Sequence[Column], fractions: Sequence[float] = (0.7, 0.15, 0.15), names: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """``split`` by the place in a unique order: int(n * f) rows each, the rest to the last."""
    n = df.count()
    ends = [0]
    for f in fractions[:-1]:
        ends.append(ends[-1] + int(n * f))
    r = running(df, list(order), {}, "_r")
    out = F.lit(names[-1])
    for name, end in reversed(list(zip(names, ends[1:]))):
        out = F.when(F.col("_r") <= end, name).otherwise(out)
    return r.withColumn("split", out).drop("_r")


def write_splits(df: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").json(folder)


def export_pairs(pairs: DataFrame, folder: str, by: str = "auto", fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> None:
    """Leakage-safe splits of pairs, the targets in order, one a row, and, of at most ``IN_ONE`` targets, the vocabulary as one record."""
    write_splits(pair_record_split(split_pairs(pairs, by, fractions, seed)), f"{folder}/pairs")
    targets = vocabulary(pairs).orderBy("target")
    targets.write.mode("overwrite").json(f"{folder}/targets")
    if targets.count() > IN_ONE:
        return
    v = targets.agg(F.array(*[F.lit(t) for t in TYPES]).alias("relations"), F.array_sort(F.collect_list("target")).alias("targets"))
    v.coalesce(1).write.mode("overwrite").json(f"{folder}/vocab")


def pair_record_split(pairs: DataFrame) -> DataFrame:
    two = lambda c: F.transform(c, lambda t: F.array(t["rel"], t["target"])).alias(c)
    return pairs.select("text", "filer", two("triples"), "filing", "confidence", "company", "item_key", "chunk", two("uncertain"), "split")


def export_judge(rows: DataFrame, folder: str, seed: int = 42) -> None:
    write_splits(unit_split(rows, F.col("filing"), (0.9, 0.05, 0.05), seed), folder)


def outcome_record(outcomes: DataFrame) -> DataFrame:
    """Outcomes as they stand on disk; which claims were uncertain is not kept."""
    return outcomes.select("gold", "pred", "confidence", "agreement", "min_agreement")


def threshold_summaries(swept: DataFrame, n_questions: int) -> DataFrame:
    """A run summary for each threshold; the calls are the escalation rate."""
    m = F.create_map(*[x for c in ("precision", "recall", "f1", "exact") for x in (F.lit(c), F.col(c))])
    cost = F.create_map(F.lit("escalation_rate"), F.col("escalation_rate"), F.lit("llm_calls"), F.col("escalation_rate"))
    return swept.select(F.format_string("tau=%.4f", "tau").alias("run_label"), F.lit("backfill").alias("dataset"), "tau", F.lit(n_questions).cast("long").alias("n_questions"), m.alias("metrics"), cost.alias("mean_cost"))


def write_summaries(summaries: DataFrame, folder: str) -> list[PurePosixPath]:
    """One ``….summary.json`` a run (a table of runs is small), on any file system; their paths."""
    out = []
    for row in summaries.toJSON().collect():
        d = json.loads(row)
        path = f"{folder.rstrip('/')}/{d['run_label'].replace('=', '_')}.summary.json"
        out.append(PurePosixPath(path))
        write_text(summaries.sparkSession, path, json.dumps(d, indent=2, sort_keys=True, ensure_ascii=False))
    return out


def write_frontier(runs: DataFrame, path: str) -> None:
    """Runs by mean cost as CSV with a header."""
    runs.orderBy("mean_cost", "run").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_edges(audited: DataFrame, path: str) -> None:
    """Append committed edges with their provenance to the edge store (Parquet)."""
    record = F.struct("chunk", "span", "route", "confidence", "extractor").alias("provenance")
    audited.filter("committed").select(F.col("filer").alias("head"), "relation", F.col("target").alias("tail"), record).write.mode("append").parquet(path)
