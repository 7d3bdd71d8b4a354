"""Queries that write tables in the formats of the sinks and read them back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import EdgeStore
from ..sources import kgqa, sinks
from .governance_queries import _AUDIT, _POLICIES, governance, proposals
from .graph_queries import _CLOSED, closed
from .files import remove
from .lineage import cut, ensure_checkpoint_dir
from .registry import query
from .traversal_queries import _GOLD, company_questions


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sources-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies' questions with the edges at their topic, written as question records and read again."""
    e = cut(closed(spark, sf_dir))
    own = e.groupBy(F.col("head").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "relation", "tail", "head"))), lambda x: F.struct(x["head"].alias("head"), x["relation"].alias("relation"), x["tail"].alias("tail"))).alias("graph"))
    q = company_questions(spark, sf_dir, e).join(own, "qid")
    path = f"{_folder(spark)}/questions"
    sinks.write_jsonl(sinks.question_record(q), path)
    return kgqa.records(kgqa.json_lines(spark, path), "companies")


@query(f"WITH {_CLOSED}, {_GOLD}, k AS (SELECT qid, count(*) AS golds FROM (SELECT DISTINCT qid, node FROM g) GROUP BY 1) SELECT c.head AS qid, 'of ' || c.head AS question, coalesce(any_value(golds), 0) AS golds, count(*) AS edges FROM closed c LEFT JOIN k ON k.qid = c.head GROUP BY c.head")
def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select("qid", "question", F.size("golds").cast("long").alias("golds"), F.size("graph").cast("long").alias("edges"))


_BARE = r"regexp_replace(tail, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')"


@query(f"WITH {_CLOSED}, o AS (SELECT head, relation, {_BARE} AS tail, row_number() OVER (PARTITION BY head ORDER BY pos, relation, tail) AS k FROM closed), d AS (SELECT head, relation, tail, min(k) AS k FROM o WHERE tail <> '' GROUP BY ALL) SELECT head AS qid, row_number() OVER (PARTITION BY head ORDER BY k) - 1 AS pos, relation, tail FROM d")
def question_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kgqa.edges_of(_records(spark, sf_dir)).select("qid", "pos", "relation", "tail")


@query(f"WITH {_CLOSED} SELECT head, relation, tail FROM closed")
def triples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported triples without their reverses, read again with them."""
    from .graph_queries import companies

    path = f"{_folder(spark)}/triples"
    sinks.write_jsonl(companies(spark, sf_dir).select("head", "relation", "tail"), path)
    return kgqa.load_triples(spark, path)[0].select("head", "relation", "tail")


@query(f"WITH {_AUDIT} SELECT filer AS head, relation, target AS tail, count(DISTINCT chunk) AS chunks FROM au WHERE a AND b GROUP BY 1, 2, 3")
def edge_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge store after the same proposals were committed twice."""
    audited = cut(governance.audit_edges(proposals(spark, sf_dir), _POLICIES()))
    store = EdgeStore(spark, f"{_folder(spark)}/edges")
    store.commit(audited)
    store.commit(audited)
    return store.edges().groupBy("head", "relation", "tail").agg(F.count_distinct("provenance.chunk").alias("chunks"))


@query("SELECT 'run ' || r_regionkey AS run_label, r_regionkey / 10.0 AS hit, r_regionkey * 2.0 AS llm_calls FROM region")
def summaries_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of as many runs as there are regions, written one a file and read again."""
    folder = _folder(spark)
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    s = r.select(
        F.concat(F.lit("run "), "r_regionkey").alias("run_label"), F.lit("regions").alias("dataset"), F.lit("dev").alias("split"), F.lit(1).cast("long").alias("n_questions"), F.lit(0.1).alias("lam"),
        F.create_map(F.lit("hit"), F.col("r_regionkey") / 10).alias("metrics"), F.create_map(F.lit("llm_calls"), F.col("r_regionkey") * 2.0).alias("mean_cost"),
    )
    sinks.write_summaries(s, folder)
    out = cut(kgqa.load_summaries(spark, folder).select("run_label", F.col("metrics")["hit"].alias("hit"), F.col("mean_cost")["llm_calls"].alias("llm_calls")))
    remove(spark, folder)
    return out
