"""Reading question subgraphs, triples and run summaries from JSON lines."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import REVERSE
from ..functions.text import strip
from ..operators.graph import adjacency, entity_types, with_reverses
from ..plans.files import exists

# fixed values: the names a field may have, first one first
FIELDS = {
    "id": ("id", "qid", "ID", "QuestionId"),
    "question": ("question", "text", "ProcessedQuestion", "RawQuestion"),
    "topics": ("q_entity", "topic_entities", "question_entities", "q_entities", "entities"),
    "golds": ("a_entity", "gold_answers", "answers", "answer", "a_entities"),
    "graph": ("graph", "subgraph", "triples", "kg"),
}
SPLITS = {
    "train": ("train.jsonl", "train.json"),
    "dev": ("dev.jsonl", "validation.jsonl", "dev.json", "valid.jsonl"),
    "validation": ("validation.jsonl", "dev.jsonl", "valid.jsonl"),
    "test": ("test.jsonl", "test.json"),
}


def split_path(folder: str, split: str, spark: SparkSession | None = None) -> str:
    """The file of a split, by its own name or one that means the same; with a session, on any file system."""
    tried = [os.path.join(folder, n) for n in SPLITS.get(split, (f"{split}.jsonl", f"{split}.json"))]
    for p in tried:
        if os.path.exists(p) if spark is None else exists(spark, p):
            return p
    raise FileNotFoundError(f"no file of split {split!r}: tried {', '.join(tried)}")


# fixed values: names under which the public question sets are published
RELEASES = {"webqsp": "rmanluo/RoG-webqsp", "cwq": "rmanluo/RoG-cwq", "metaqa": "rmanluo/RoG-metaqa"}


def download(dataset: str, folder: str, fetch=None) -> list[str]:
    """The splits of a published question set as ``<split>.jsonl``; their paths. An unknown set is a ValueError.

    ``fetch`` takes a release's name and gives its splits, each rows of mappings; without one the ``datasets`` package is used.
    """
    if dataset not in RELEASES:
        raise ValueError(f"unknown dataset {dataset!r}: one of {', '.join(sorted(RELEASES))}")
    if fetch is None:
        from datasets import load_dataset as fetch  # not installed everywhere
    os.makedirs(folder, exist_ok=True)
    out = []
    for split, rows in fetch(RELEASES[dataset]).items():
        out.append(os.path.join(folder, f"{split}.jsonl"))
        with open(out[-1], "w", encoding="utf-8") as f:
            f.writelines(json.dumps(dict(r), ensure_ascii=False) + "\n" for r in rows)
    return out


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their place: ``value`` and ``ordinal`` (grows with the place in the file).

    A file is one partition, so that the places are those of the file; convert large inputs to Parquet once.
    """
    lines = spark.read.option("wholetext", False).text(path).withColumn("ordinal", F.monotonically_increasing_id())
    return lines.filter(strip(F.col("value")) != "")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are, for content keys."""
    return spark.read.text(path, lineSep="\n")


def _field(v: Column, name: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{a}", "variant") for a in FIELDS[name]])


def _text(v: Column, name: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{a}", "string") for a in FIELDS[name]])


def _strings(v: Column, name: str) -> Column:
    """A list or a single value as stripped non-empty strings, repetitions kept; null is no strings."""
    field = _field(v, name)
    many = F.coalesce(F.try_variant_get(field, "$", "array<string>"), F.array(F.try_variant_get(field, "$", "string")))
    kept = F.filter(F.transform(many, strip), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def records(lines: DataFrame, dataset: str, column: str = "value", order: str = "ordinal") -> DataFrame:
    """Question records of JSON lines: ``ordinal, qid, question, topics, golds, graph, dataset``.

    Of a field's names the first that is not null counts; a missing id or question is an error. The graph's rows that are not three
    non-empty strings are dropped, repetitions too, order is kept.
    """
    v = F.parse_json(F.col(column))
    need = lambda c, n: F.coalesce(c, F.raise_error(F.lit(f"a record has no {n}")).cast("string"))
    graph = F.coalesce(F.try_variant_get(_field(F.col("v"), "graph"), "$", "array<array<string>>"), F.array().cast("array<array<string>>"))
    clean = F.transform(graph, lambda r: F.transform(r, lambda x: strip(F.coalesce(x, F.lit("None")))))
    good = F.filter(clean, lambda r: (F.size(r) == 3) & F.forall(r, lambda x: x != ""))
    triple = lambda r: F.struct(F.get(r, F.lit(0)).alias("head"), F.get(r, F.lit(1)).alias("relation"), F.get(r, F.lit(2)).alias("tail"))
    return lines.select(F.col(order).alias("ordinal"), v.alias("v")).select(
        "ordinal", need(_text(F.col("v"), "id"), "id").alias("qid"), need(_text(F.col("v"), "question"), "question").alias("question"), _strings(F.col("v"), "topics").alias("topics"),
        _strings(F.col("v"), "golds").alias("golds"), F.array_distinct(F.transform(good, triple)).alias("graph"), F.lit(dataset).alias("dataset"),
    )


def load_records(spark: SparkSession, folder: str, split: str, dataset: str, limit: int | None = None) -> DataFrame:
    """A split's records; ``limit`` takes the first in the order of the file."""
    lines = json_lines(spark, split_path(folder, split, spark))
    return records(lines.orderBy("ordinal").limit(limit) if limit is not None else lines, dataset)


def load_questions(spark: SparkSession, folder: str, split: str, dataset: str, limit: int | None = None) -> DataFrame:
    """Without the graphs."""
    return load_records(spark, folder, split, dataset, limit).drop("graph", "ordinal")


def edges_of(recs: DataFrame) -> DataFrame:
    """The records' graphs as one edge table by question; of a repeated question the last record counts."""
    last = recs.groupBy("qid").agg(F.max_by("graph", "ordinal").alias("graph"))
    return adjacency(last.select("qid", F.posexplode("graph").alias("pos", "t")).select("qid", F.col("pos").cast("long").alias("pos"), "t.head", "t.relation", "t.tail"))


def load_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Exported triples with their typed reverses, and the entities with their types, sorted. An unknown relation is an error."""
    raw = spark.read.schema("head string, relation string, tail string").option("mode", "FAILFAST").json(path)
    relation = F.lower("relation")
    known = F.when(relation.isin(*REVERSE), relation).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), relation)).cast("string"))
    e = raw.select(F.monotonically_increasing_id().alias("pos"), "head", known.alias("relation"), "tail")
    closed = with_reverses(adjacency(e))
    return closed, entity_types(closed).orderBy("type", "entity")


def load_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All run summaries below a folder, by path."""
    s = "run_label string, dataset string, split string, n_questions long, lam double, metrics map<string,double>, mean_cost map<string,double>"
    r = spark.read.schema(s).option("recursiveFileLookup", True).option("pathGlobFilter", "*.summary.json").option("multiLine", True).json(folder)
    return r.select("*", F.col("_metadata.file_path").alias("path")).orderBy("path")


def load_losses(spark: SparkSession, path: str) -> DataFrame:
    """Loss rows of a training log: ``step, loss``."""
    log = spark.read.schema("log_history array<struct<step:bigint,loss:double>>").option("multiLine", True).json(path)
    return log.select(F.inline("log_history")).filter("loss is not null")


def load_export(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """An extraction export with the place of each row; columns a version lacks are null."""
    from ..schemas import EXPORT

    return spark.read.schema(EXPORT).option("mode", "FAILFAST").json(paths).withColumn("ordinal", F.monotonically_increasing_id())


def load_json_table(spark: SparkSession, path: str, schema: str, most: int | None = None, allow_empty: bool = False) -> DataFrame:
    """A JSON lines table of a known schema; ``most`` takes the first rows; an empty one is a ValueError unless allowed."""
    t = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if most is not None:
        t = t.withColumn("_o", F.monotonically_increasing_id()).orderBy("_o").limit(most).drop("_o")
    if not allow_empty and not t.limit(1).count():
        raise ValueError(f"{path} has no rows")
    return t


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("relations array<string>, targets array<string>").option("multiLine", True).json(path)


def export_contract(chunks: DataFrame, edges: DataFrame, filings: DataFrame, types: Sequence[str]) -> DataFrame:
    """An export from tables of the filing store: edges of the types with their chunks and filings, and, with null edge fields, chunks without any edge.

    ``chunks``: ``chunk_id, accession_number, chunk_text, item_key``; ``edges``: ``chunk_id, relationship_type, target, confidence, evidence_text``;
    ``filings``: ``accession_number, filer, company_id``.
    """
    whole = chunks.join(filings, "accession_number")
    positive = whole.join(edges.filter(F.col("relationship_type").isin(*types)), "chunk_id")
    return positive.unionByName(whole.join(edges.select("chunk_id"), "chunk_id", "left_anti"), allowMissingColumns=True)


def judge_contract(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """A judge export: scored edges as accepted, and rejected proposals from their JSON payload."""
    cols = ("filer", "relationship_type", "target", "evidence_text", "chunk_text", "accession_number")
    yes = accepted.filter("faithfulness is not null").select(*cols, "faithfulness", F.lit("accept").alias("verdict"))
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    no = rejected.filter("reason = 'critic_reject'").select("filer", get("relationship_type").alias("relationship_type"), get("target").alias("target"), get("evidence_text").alias("evidence_text"), "chunk_text", "accession_number", get("faithfulness").cast("double").alias("faithfulness"), F.lit("reject").alias("verdict"))
    return yes.unionByName(no)
