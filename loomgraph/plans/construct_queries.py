"""Queries that build supervised pairs, judge rows, splits and rewards from the exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sets import by_core_name
from ..functions.taxonomy import TYPES
from ..operators import construct
from ..sources.kgqa import export_contract
from .graph_queries import table
from .lineage import cut
from .outcome_queries import _ROWS, outcomes
from .registry import query


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction export: the latest delivery of each row, types in plain form, filings by their digits."""
    cols = ["confidence", "evidence_text", "source_company_name", "relationship_type", "target_company_name", "accession_number", "chunk_id", "chunk_text", "item_key", "company_id", "split"]
    t = table(spark, sf_dir, "company_relationships").filter("row_id is not null").groupBy("row_id").agg(F.max(F.struct("loaded_at", *cols)).alias("l")).select("row_id", "l.*")
    return t.select(
        "evidence_text", F.col("source_company_name").alias("filer"), F.lower(F.trim("relationship_type")).alias("relationship_type"), F.col("target_company_name").alias("target"), "confidence",
        F.regexp_replace("accession_number", "[^0-9]", "").alias("accession_number"), "chunk_id", "chunk_text", "item_key", F.lower(F.trim("company_id")).alias("company_id"), F.col("row_id").alias("ordinal"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.group_export(export(spark, sf_dir), strict=False)


_TYPES = "(" + ", ".join(f"'{t}'" for t in TYPES) + ")"
_EXPORT = """v0 AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST, confidence DESC NULLS LAST) AS k FROM company_relationships WHERE row_id IS NOT NULL),
v AS (SELECT row_id AS o, evidence_text, source_company_name AS filer, lower(trim(relationship_type)) AS rel, target_company_name AS target, confidence, coalesce(regexp_replace(accession_number, '[^0-9]', '', 'g'), '') AS filing, chunk_id, chunk_text, item_key, lower(trim(company_id)) AS company FROM v0 WHERE k = 1)"""
_PAIRS = f"""{_EXPORT},
r AS (SELECT *, coalesce(nullif(chunk_id, ''), chunk_text, evidence_text, '') AS chunk, rel IN {_TYPES} AND target IS NOT NULL AS ok, coalesce(confidence >= 0.7::DOUBLE, true) AS sure, rel || '>' || target AS c FROM v),
g AS (SELECT filing, chunk, first(filer ORDER BY o) AS filer, first(company ORDER BY o) AS company, first(item_key ORDER BY o) AS item_key, first(coalesce(nullif(chunk_text, ''), evidence_text) ORDER BY o) AS text, min(confidence) FILTER (ok AND sure) AS confidence, count(DISTINCT filer) AS filers FROM r GROUP BY 1, 2),
t AS (SELECT filing, chunk, c, rel, target, min(o) AS o, bool_or(sure) AS gold FROM r WHERE ok GROUP BY 1, 2, 3, 4, 5),
ts AS (SELECT t.filing, t.chunk, t.c, t.rel, t.target, t.gold, (SELECT min(r.o) FROM r WHERE r.filing = t.filing AND r.chunk = t.chunk AND r.c = t.c AND r.ok AND r.sure = t.gold) AS o FROM t),
a AS (SELECT filing, chunk, string_agg(c, '|' ORDER BY o) FILTER (gold) AS triples, string_agg(c, '|' ORDER BY o) FILTER (NOT gold) AS uncertain, count(*) FILTER (gold) AS n FROM ts GROUP BY 1, 2),
pairs AS (SELECT filing, chunk, filer, company, item_key, text, confidence, coalesce(triples, '') AS triples, coalesce(uncertain, '') AS uncertain, coalesce(n, 0) AS n FROM g LEFT JOIN a USING (filing, chunk) WHERE filers <= 1)"""


def _said(c: str):
    return F.array_join(F.transform(c, lambda t: F.concat_ws(">", t["rel"], t["target"])), "|").alias(c)


@query(f"WITH {_PAIRS} SELECT filing, chunk, filer, company, item_key, length(text) AS text_length, confidence, triples, uncertain FROM pairs")
def pairs_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("filing", "chunk", "filer", "company", "item_key", F.length("text").cast("long").alias("text_length"), "confidence", _said("triples"), _said("uncertain"))


@query(f"WITH {_PAIRS} SELECT DISTINCT ts.target FROM ts JOIN pairs USING (filing, chunk) WHERE gold")
def target_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.vocabulary(pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (n > 0) AS positives, count(*) FILTER (n > 1) AS several, count(DISTINCT filing) AS filings, count(DISTINCT company) AS companies FROM pairs")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.counts(pairs(spark, sf_dir))


def _split_sql(unit: str, fractions: tuple[float, float], source: str = "pairs") -> str:
    return f"""u AS (SELECT DISTINCT {unit} AS u FROM {source}), k AS (SELECT u, row_number() OVER (ORDER BY sha256('42|' || u), u) AS r, count(*) OVER () AS n FROM u),
sp AS (SELECT u, CASE WHEN r <= floor(n * {fractions[0]}::DOUBLE) THEN 'train' WHEN r <= floor(n * {fractions[0]}::DOUBLE) + floor(n * {fractions[1]}::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM k)"""


@query(f"WITH {_PAIRS}, {_split_sql('filing', (0.8, 0.1))} SELECT filing, chunk, split FROM pairs JOIN sp ON filing = u")
def split_by_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.split_pairs(pairs(spark, sf_dir), "filing").select("filing", "chunk", "split")


_COMPANY = "coalesce(nullif(company, ''), filing)"


@query(f"WITH {_PAIRS}, {_split_sql(_COMPANY, (0.8, 0.1))} SELECT filing, chunk, split FROM pairs JOIN sp ON {_COMPANY} = u")
def split_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.split_pairs(cut(pairs(spark, sf_dir)), "auto").select("filing", "chunk", "split")


def judge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge export: the latest delivery of each example."""
    cols = ["faithfulness", "text", "filer", "relation", "target", "verdict", "filing"]
    t = table(spark, sf_dir, "judge_examples").filter("example_id is not null").groupBy("example_id").agg(F.max(F.struct("loaded_at", *cols)).alias("l")).select("example_id", "l.*")
    return t.select(F.col("example_id").alias("ordinal"), F.col("text").alias("chunk_text"), F.lit(None).cast("string").alias("evidence_text"), "filer", F.lower(F.trim("relation")).alias("relationship_type"), "target", "verdict", "faithfulness", F.col("filing").alias("accession_number"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.judge_rows(judge_export(spark, sf_dir))[0]


_JUDGE = f"""j0 AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC NULLS LAST, faithfulness DESC NULLS LAST) AS k FROM judge_examples WHERE example_id IS NOT NULL),
j1 AS (SELECT example_id AS ordinal, text, filer, lower(trim(relation)) AS relation, target, lower(trim(verdict)) AS verdict, faithfulness, filing,
  coalesce(trim(filer) <> '' AND trim(target) <> '' AND text <> '' AND lower(trim(relation)) IN {_TYPES} AND lower(trim(verdict)) IN ('accept', 'reject'), false) AS ok FROM j0 WHERE k = 1),
j AS (SELECT ordinal, text, filer, relation, target, verdict, greatest(0.0, least(1.0, coalesce(faithfulness, CASE WHEN verdict = 'accept' THEN 1.0 ELSE 0.0 END))) AS faithfulness, filing FROM j1 WHERE ok)"""


@query(f"WITH {_JUDGE} SELECT ordinal, filer, relation, target, verdict, faithfulness, filing, length(text) AS text_length FROM j")
def judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("ordinal", "filer", "relation", "target", "verdict", "faithfulness", "filing", F.length("text").cast("long").alias("text_length"))


@query(f"WITH {_JUDGE} SELECT count(*) FILTER (NOT ok) AS skipped FROM j1")
def judge_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.judge_rows(judge_export(spark, sf_dir))[1]


_FILING = "coalesce(filing, '')"


@query(f"WITH {_JUDGE}, {_split_sql(_FILING, (0.9, 0.05), 'j')} SELECT ordinal, split FROM j JOIN sp ON {_FILING} = u")
def judge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.unit_split(judged(spark, sf_dir), F.col("filing"), (0.9, 0.05, 0.05)).select("ordinal", "split")


_FLIP = "CASE relation WHEN 'supplier' THEN 'customer' WHEN 'customer' THEN 'supplier' WHEN 'acquirer' THEN 'subsidiary' WHEN 'subsidiary' THEN 'acquirer' END"


@query(rf"""WITH {_JUDGE}, b AS (SELECT *, lower(regexp_replace(filer, '^\s+|\s+$', '', 'g')) AS kf, lower(regexp_replace(target, '^\s+|\s+$', '', 'g')) AS kt FROM j),
x AS (SELECT *, {_FLIP} AS flip FROM b WHERE verdict = 'accept' AND faithfulness >= 0.5 AND {_FLIP} IS NOT NULL),
y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.verdict = 'accept' AND b.kf = x.kf AND b.relation = x.flip AND b.kt = x.kt) AND NOT EXISTS (SELECT 1 FROM b WHERE b.text = x.text AND b.kf = x.kf AND b.relation = x.flip AND b.kt = x.kt))
SELECT filer, flip AS relation, target, 'reject' AS verdict, 0.0 AS faithfulness, filing FROM y QUALIFY row_number() OVER (PARTITION BY text, kf, flip, kt ORDER BY ordinal) = 1""")
def direction_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.direction_negatives(cut(judged(spark, sf_dir))).drop("text")


def _agreement_sql(thresholds: str) -> str:
    return f"""t AS (SELECT unnest({thresholds}::DOUBLE[]) AS threshold), x AS (SELECT threshold, verdict = 'accept' AS yes, CASE WHEN (faithfulness >= threshold) = (verdict = 'accept') THEN 1 ELSE 0 END AS ok FROM j, t),
a AS (SELECT threshold, count(*) AS n, sum(ok)::DOUBLE / count(*) AS overall, CASE WHEN count(*) FILTER (yes) > 0 THEN sum(ok) FILTER (yes)::DOUBLE / count(*) FILTER (yes) ELSE 1.0 END AS accept, CASE WHEN count(*) FILTER (NOT yes) > 0 THEN sum(ok) FILTER (NOT yes)::DOUBLE / count(*) FILTER (NOT yes) ELSE 1.0 END AS reject FROM x GROUP BY 1)
SELECT *, (accept + reject) / 2 AS balanced FROM a"""


@query(f"WITH {_JUDGE}, {_agreement_sql('[0.5]')}")
def verdict_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.verdict_agreement(judged(spark, sf_dir), "faithfulness", "verdict")


_THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


@query(f"WITH {_JUDGE}, {_agreement_sql(str(_THRESHOLDS))}")
def verdict_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.verdict_agreement(judged(spark, sf_dir), "faithfulness", "verdict", _THRESHOLDS)


@query(f"WITH {_EXPORT} SELECT DISTINCT chunk_id FROM v WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v w WHERE w.chunk_id = v.chunk_id AND w.rel IS NOT NULL)")
def export_negatives_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without any edge, by the export's contract of tables."""
    e = cut(export(spark, sf_dir))
    chunks = e.filter("chunk_id is not null").groupBy("chunk_id").agg(F.coalesce(F.max("accession_number"), F.lit("")).alias("accession_number"), F.max("chunk_text").alias("chunk_text"), F.max("item_key").alias("item_key"))
    filings = chunks.select("accession_number").distinct().withColumns({"filer": F.lit(""), "company_id": F.lit("")})
    edges = e.filter("relationship_type is not null").select("chunk_id", "relationship_type", "target", "confidence", "evidence_text")
    return export_contract(chunks, edges, filings, TYPES).filter("relationship_type is null").select("chunk_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made of outcomes: low confidence escalates, no claim skips, the rest extracts."""
    route = F.when(F.col("confidence") < 0.4, "escalate").when(F.coalesce(F.size("pred"), F.lit(0)) == 0, "skip").otherwise("extract")
    return outcomes(spark, sf_dir).select(
        F.col("outcome_id").alias("key"), F.substring("chunk_id", 1, 9).alias("filing"), route.alias("route"), F.col("pred").alias("triples"), "gold", "uncertain", (10 * F.coalesce(F.size("pred"), F.lit(0)) + 2).alias("gen_tokens"), "confidence"
    )


_PARTS = """q AS (SELECT key, substr(chunk_id, 1, 9) AS filing, CASE WHEN confidence < 0.4 THEN 'escalate' WHEN coalesce(len(pr), 0) = 0 THEN 'skip' ELSE 'extract' END AS route, g, coalesce(pr, []) AS pr, u, 10 * coalesce(len(pr), 0) + 2 AS gen_tokens
  FROM (SELECT o.*, l.pred AS pr FROM o JOIN l ON l.outcome_id = o.key AND l.k = 1)),
cp AS (SELECT *, len(g) AS n_gold, CASE route WHEN 'escalate' THEN len(g) WHEN 'extract' THEN len([x FOR x IN list_distinct(pr) IF list_contains(g, x)]) ELSE 0 END AS recovered,
  CASE WHEN route = 'extract' THEN len([x FOR x IN pr IF NOT list_contains(u, x)]) ELSE 0 END AS emitted, CASE WHEN route = 'extract' THEN len([x FOR x IN pr IF NOT list_contains(u, x) AND list_contains(g, x)]) ELSE 0 END AS accepted FROM q)"""
_PR = "CASE WHEN emitted > 0 THEN accepted::DOUBLE / emitted ELSE 1.0 END AS precision, CASE WHEN n_gold > 0 THEN recovered::DOUBLE / n_gold ELSE 1.0 END AS recall"
_REWARD = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END - 0.1::DOUBLE * "


@query(f"""WITH {_ROWS}, {_PARTS}, f AS (SELECT filing, count(*) AS chunks, count(*) FILTER (route = 'escalate') AS escalated, sum(n_gold) AS n_gold, sum(recovered) AS recovered, sum(emitted)::BIGINT AS emitted, sum(accepted)::BIGINT AS accepted, sum(gen_tokens) AS t FROM cp GROUP BY 1),
h AS (SELECT filing, chunks, escalated, emitted, accepted, {_PR}, (t + 2000.0 * escalated)::DOUBLE AS cost_tokens FROM f), i AS (SELECT *, greatest(0.0, least(1.0, cost_tokens / (2000.0 * chunks)))::DOUBLE AS normalized_cost FROM h)
SELECT *, {_REWARD} normalized_cost AS reward FROM i""")
def filing_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.filing_rewards(construct.chunk_parts(decisions(spark, sf_dir), ["key", "filing"]))


@query(f"""WITH {_ROWS}, {_PARTS}, h AS (SELECT key, route, {_PR}, greatest(0.0, least(1.0, (gen_tokens + CASE WHEN route = 'escalate' THEN 2000.0 ELSE 0.0 END) / 2000.0))::DOUBLE AS cost FROM cp) SELECT *, {_REWARD} cost AS reward FROM h""")
def chunk_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.chunk_rewards(construct.chunk_parts(decisions(spark, sf_dir), ["key"]), ["key"])


_SUFFIX = "incorporated|corporation|company|holdings|limited|technologies|inc|corp|co|ltd|llc|plc|lp|sa|ag|nv|group"
CORE_SQL = f"regexp_replace(regexp_replace(trim(regexp_replace(lower(%s), '[^a-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'), '(?: (?:{_SUFFIX}))+$', '')"


@query(f"""WITH {_ROWS}, n AS (SELECT key, list_distinct([x.rel || '>' || {CORE_SQL % 'x.target'} FOR x IN g]) AS g, list_distinct([x.rel || '>' || {CORE_SQL % 'x.target'} FOR x IN r]) AS r FROM d)
SELECT key, len(g) AS n_gold, len(r) AS n_pred, CASE WHEN len(g) + len(r) = 0 THEN 1.0 ELSE 2.0 * len([x FOR x IN g IF list_contains(r, x)]) / (len(g) + len(r)) END AS target FROM n""")
def gate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cut(outcomes(spark, sf_dir).withColumnRenamed("outcome_id", "key"))
    texts = o.select("key", F.lit("").alias("text"), F.lit("").alias("filer"))
    g = construct.gate_rows(o.withColumns({"gold": by_core_name(F.col("gold")), "pred": by_core_name(F.col("pred"))}), texts, "key")
    return g.select("key", "n_gold", "n_pred", "target")


@query()
def hard_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to be labelled for escalation: hard ones and a twentieth of the others."""
    p = pairs(spark, sf_dir).filter("text is not null").withColumn("key", F.concat_ws("|", "filing", "chunk"))
    return construct.escalate_labels(p, "key")


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence, row_id) AS r FROM (SELECT DISTINCT chunk_id, row_id, max(confidence) AS confidence FROM company_relationships WHERE chunk_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL)) SELECT chunk_id, row_id FROM v WHERE r <= 2""")
def capped_chunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two least confident rows of each chunk (nulls last)."""
    t = table(spark, sf_dir, "company_relationships").filter("chunk_id is not null and row_id is not null").groupBy("chunk_id", "row_id").agg(F.max("confidence").alias("confidence"))
    t = t.withColumn("o", F.struct(F.col("confidence").isNull(), "confidence", "row_id"))
    return construct.capped_groups(t, "chunk_id", F.col("o"), None, 2).select("chunk_id", "row_id")
