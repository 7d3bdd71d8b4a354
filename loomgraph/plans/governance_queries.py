"""Queries of governance: hop audits, edge policies, certificates, provenance; and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import TYPES
from ..operators import governance
from ..streaming import commits
from .construct_queries import _EXPORT, decisions, export
from .graph_queries import table
from .files import remove
from .lineage import cut
from .outcome_queries import _ROWS
from .registry import query
from .text_queries import _PARTY_SQL, spans_sql

_TYPES = "(" + ", ".join(f"'{t}'" for t in TYPES) + ")"


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted edge as a proposal."""
    e = export(spark, sf_dir).filter("relationship_type is not null and target is not null")
    return e.select(
        F.coalesce("accession_number", F.lit("")).alias("filing"), "filer", F.col("relationship_type").alias("relation"), "target", F.col("chunk_id").alias("chunk"), F.col("chunk_text").alias("text"),
        F.lit("extract").alias("route"), "confidence", F.lit(None).cast("double").alias("judge_score"), F.lit("").alias("extractor"),
    )


_POLICIES = lambda: (governance.schema_allowlist(), governance.edge_confidence_floor(0.7))
_AUDIT = f"{_EXPORT}, au AS (SELECT filing, filer, rel AS relation, target, chunk_id AS chunk, rel IN {_TYPES} AS a, coalesce(confidence >= 0.7::DOUBLE, false) AS b FROM v WHERE rel IS NOT NULL AND target IS NOT NULL)"


@query(f"WITH {_AUDIT} SELECT filing, count(*) FILTER (a AND b) AS n_committed, count(*) FILTER (NOT (a AND b)) AS n_blocked, true AS verdict FROM au GROUP BY 1")
def edge_commit_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.write_certificates(governance.audit_edges(proposals(spark, sf_dir), _POLICIES()))


@query(f"WITH {_AUDIT} SELECT filer AS head, relation, target AS tail, count(*) AS provenances, count(DISTINCT chunk) AS chunks FROM au WHERE a AND b GROUP BY 1, 2, 3")
def edge_provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.provenance_counts(governance.audit_edges(proposals(spark, sf_dir), _POLICIES()))


@query(f"""WITH {_EXPORT}, x AS (SELECT * FROM v WHERE rel IS NOT NULL AND target IS NOT NULL), {spans_sql('x', 'o', 'target', 'chunk_text')},
p AS (SELECT filing, rel IN {_TYPES} AND coalesce(confidence >= 0.7::DOUBLE, false) AND s IS NOT NULL AND {_PARTY_SQL % 'chunk_text'} AS ok FROM x JOIN gs ON gs.key = x.o)
SELECT filing, count(*) FILTER (ok) AS n_committed, count(*) FILTER (NOT ok) AS n_blocked, true AS verdict FROM p GROUP BY 1""")
def evidence_gated_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates when the evidence gates run as well."""
    a = governance.audit_edges(proposals(spark, sf_dir), (*_POLICIES(), governance.evidence_gates()))
    return governance.write_certificates(a)


@query(f"""WITH {_ROWS}, q AS (SELECT o.key, o.confidence, l.gold, l.pred, CASE WHEN o.confidence < 0.4 THEN 'escalate' WHEN coalesce(len(l.pred), 0) = 0 THEN 'skip' ELSE 'extract' END AS route FROM o JOIN l ON l.outcome_id = o.key AND l.k = 1),
x AS (SELECT key, route, CASE WHEN route = 'escalate' THEN CASE WHEN confidence = 0 THEN 1.0 ELSE confidence END ELSE 1.0 END AS confidence, unnest(CASE route WHEN 'extract' THEN pred WHEN 'escalate' THEN gold ELSE [] END) AS e FROM q)
SELECT key, route, e.rel AS relation, e.target AS target, confidence FROM x""")
def proposals_of_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges the decisions propose; extractions decoded with certainty."""
    d = decisions(spark, sf_dir).select(F.col("key").cast("string").alias("filing"), F.lit("").alias("chunk"), F.lit("").alias("text"), F.lit("").alias("filer"), "gold", "confidence", "route", "triples", F.lit(0.0).alias("logprob"), F.lit(1).alias("n_choices"))
    return governance.proposals(d).select(F.col("filing").cast("long").alias("key"), "route", "relation", "target", "confidence")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.event_windows(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.sessions(table(spark, sf_dir, "events"))


@query(f"WITH {_AUDIT} SELECT relation, count(*) AS provenances FROM au WHERE a AND b GROUP BY 1")
def streamed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge store after a stream of proposals was committed under governance, counted by relation."""
    import uuid

    from .lineage import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    proposals(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    commits.commit_stream(stream, _POLICIES(), f"{base}/edges", f"{base}/audits", f"{base}/state").awaitTermination()
    out = cut(spark.read.parquet(f"{base}/edges").groupBy("relation").agg(F.count("*").alias("provenances")))
    remove(spark, base)
    return out
