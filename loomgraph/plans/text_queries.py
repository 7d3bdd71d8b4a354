"""Queries of the text rules: names, spans, grounding, prompts, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.digest import content_key
from ..functions.taxonomy import TYPES
from ..operators import construct, governance
from .construct_queries import CORE_SQL, _EXPORT, _JUDGE, _PAIRS, export, judged, pairs
from .graph_queries import table
from .registry import query


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "company_relationships").select(F.col("target_company_name").alias("name")).filter("name is not null").distinct()


_NAMES = "n AS (SELECT DISTINCT target_company_name AS name FROM company_relationships WHERE target_company_name IS NOT NULL)"


@query(f"WITH {_NAMES} SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g')) AS norm, {CORE_SQL % 'name'} AS core FROM n")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir)
    return n.select("name", text.normalize_name(F.col("name")).alias("norm"), text.core_name(F.col("name")).alias("core"))


@query(r"SELECT doc_id, coalesce(regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(we|our|us|the company|the corporation|the registrant)($|[^\p{L}\p{N}_])'), false) AS party FROM documents")
def party_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.filer_is_party(F.col("text")).alias("party"))


_GAP = r"[^\p{L}\p{N}]+"


def _place(name: str, text: str) -> str:
    """SQL: the pattern's groups are what stands before the first place of the words of ``name`` and what stands there."""
    pattern = rf"'(?is)^(|.*?[^\p{{L}}\p{{M}}\p{{N}}_])(' || replace({name}, ' ', '{_GAP}') || ')(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])'"
    return f"CASE WHEN {name} <> '' AND regexp_matches({text}, {pattern}) THEN [length(regexp_extract({text}, {pattern}, 1)), length(regexp_extract({text}, {pattern}, 1)) + length(regexp_extract({text}, {pattern}, 2))] END"


def spans_sql(source: str, key: str, target: str, text: str) -> str:
    """SQL: tables ``n0`` of the names and ``gs`` of ``key`` and span ``s`` (null: not in the text)."""
    norm = f"regexp_replace(trim(regexp_replace(lower({target}), '[^a-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g')"
    return f"""n0 AS (SELECT {key} AS key, {norm} AS norm, {CORE_SQL % target} AS core, {text} AS text FROM {source}),
gs AS (SELECT key, coalesce({_place("norm", "text")}, {_place("core", "text")}) AS s FROM n0)"""


_PARTY_SQL = r"coalesce(regexp_matches(%s, '(?i)(^|[^\p{L}\p{N}_])(we|our|us|the company|the corporation|the registrant)($|[^\p{L}\p{N}_])'), false)"


@query(f"WITH {_EXPORT}, {spans_sql('(SELECT * FROM v WHERE target IS NOT NULL AND chunk_text IS NOT NULL)', 'o', 'target', 'chunk_text')} SELECT key AS ordinal, s[1]::INT AS start, s[2]::INT AS \"end\" FROM gs")
def ground_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the target of each edge stands in its chunk."""
    e = export(spark, sf_dir).filter("target is not null and chunk_text is not null")
    return e.select("ordinal", text.ground_span(F.col("target"), F.col("chunk_text")).alias("s")).select("ordinal", "s.start", "s.end")


@query(f"WITH {_JUDGE}, {spans_sql('j', 'ordinal', 'target', 'text')}, p AS (SELECT ordinal, {_PARTY_SQL % 'text'} AS party FROM j) SELECT ordinal, s IS NOT NULL AS grounded, true AS is_company, party AS filer_party, s IS NOT NULL AND party AS passed FROM p JOIN gs ON gs.key = p.ordinal")
def rule_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existence gates of each judged claim."""
    j = judged(spark, sf_dir)
    return j.select("ordinal", governance.rule_gates(F.col("target"), F.col("text")).alias("g")).select("ordinal", "g.grounded", "g.is_company", "g.filer_party", "g.passed")


_JOINED = "|".join(text.CONNECTORS)
_QUOTED = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
_NORM = "trim(regexp_replace(lower(%s), '[^a-z0-9 ]+', ' ', 'g'))"


def _candidates(source: str, key: str, text_: str, filer: str) -> str:
    """SQL: tables ending in ``cs`` of ``key`` and its ``spans`` in order, 64 at most."""
    bare = f"trim(regexp_replace(regexp_replace(regexp_replace(x, '[.'',&-]+$', ''), '\\s+', ' ', 'g'), '(?i)(?:(?:^| )(?:{_JOINED}))+$', ''))"
    span = text._SPAN.replace("'", "''")
    several = f"len([w FOR w IN string_split(x, ' ') IF NOT list_contains({_QUOTED({*text.FURNITURE, *text.CONNECTORS})}, lower(w))]) > 0"
    single = f"NOT list_contains({_QUOTED(text.FURNITURE)}, lower(x)) AND (length(x) >= 4 OR (upper(x) = x AND lower(x) <> x AND length(x) >= 2))"
    keep = f"x <> '' AND CASE WHEN contains(x, ' ') THEN {several} ELSE {single} END AND {_NORM % 'x'} <> '' AND NOT starts_with({_NORM % f"coalesce({filer}, '')"}, {_NORM % 'x'})"
    return f"""c1 AS (SELECT {key} AS key, {filer}, [{bare} FOR x IN regexp_extract_all({text_}, '{span}')] AS l FROM {source}),
c2 AS (SELECT key, [x FOR x IN l IF {keep}] AS l FROM c1),
cs AS (SELECT key, [x FOR x, i IN l IF list_position(l, x) = i][1:{text.LISTED}] AS spans FROM c2)"""


def _match(target: str) -> str:
    """SQL: the last of the ``spans`` with the target's normal name, else with its core name."""
    return f"coalesce([x FOR x IN spans IF {_NORM % 'x'} = {_NORM % target}][-1], [x FOR x IN spans IF {CORE_SQL % 'x'} = {CORE_SQL % target}][-1])"


@query(f"WITH {_EXPORT}, e AS (SELECT o, chunk_text, filer, target FROM v WHERE chunk_text IS NOT NULL AND target IS NOT NULL), {_candidates('e', 'o', 'chunk_text', 'filer')} SELECT key AS ordinal, len(spans)::INT AS n_spans, {_match('target')} AS matched FROM cs JOIN e ON e.o = cs.key")
def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised spans of each chunk, without its filer, and which of them is each edge's target."""
    e = export(spark, sf_dir).filter("chunk_text is not null and target is not null")
    spans = e.withColumn("spans", text.candidate_spans(F.col("chunk_text"), F.col("filer")))
    return spans.select("ordinal", F.size("spans").alias("n_spans"), text.match_candidate(F.col("target"), F.col("spans")).alias("matched"))


@query(f"""WITH {_PAIRS}, e AS (SELECT filing || '|' || chunk AS k, text, filer, n FROM pairs WHERE text IS NOT NULL), {_candidates('e', 'k', 'text', 'filer')},
h AS (SELECT DISTINCT ts.filing || '|' || ts.chunk AS k FROM ts JOIN cs ON cs.key = ts.filing || '|' || ts.chunk WHERE ts.gold AND {_match('ts.target')} IS NULL)
SELECT k AS key, n > 0 AND (n >= 4 OR k IN (SELECT k FROM h)) AS hard FROM e""")
def hard_chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each chunk is hard: many claims, or a target that is none of its spans."""
    p = pairs(spark, sf_dir).filter("text is not null")
    return p.select(F.concat_ws("|", "filing", "chunk").alias("key"), construct.hard_chunk(F.col("triples"), F.col("text"), F.col("filer")).alias("hard"))


@query()
def marked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the filer is marked in each judged text."""
    j = judged(spark, sf_dir)
    return j.select("ordinal", text.mark_filer_mentions(F.col("text"), F.col("filer")).alias("m")).select("ordinal", F.regexp_count("m", F.lit(r"\[F\]")).alias("mentions"))


@query(f"WITH {_EXPORT} SELECT o AS ordinal, md5('extract the filer''s company relationships from this SEC filing text.' || chr(10) || 'filer: ' || filer || chr(10) || 'text: ' || chunk_text || chr(10) || 'relations: {' | '.join(TYPES)} (or NONE if the text states none)' || chr(10) || 'extraction:') AS prompt FROM v WHERE filer IS NOT NULL AND chunk_text IS NOT NULL")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = export(spark, sf_dir).filter("filer is not null and chunk_text is not null")
    return e.select("ordinal", F.md5(text.extraction_prompt(F.col("filer"), F.col("chunk_text"), TYPES)).alias("prompt"))


@query(f"WITH {_JUDGE} SELECT ordinal, md5('filer: ' || filer || chr(10) || 'claim: the filer is the ' || relation || ' of ' || target || chr(10) || 'evidence: ' || text) AS prompt FROM j")
def judge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    return j.select("ordinal", F.md5(text.judge_input(F.col("filer"), F.col("relation"), F.col("target"), F.col("text"))).alias("prompt"))


@query(f"WITH {_EXPORT} SELECT o AS ordinal, CASE WHEN confidence IS NULL THEN 'unknown' ELSE printf('%.1f', floor(greatest(0.0, least(1.0, confidence)) * 10) / 10) END AS bucket FROM v")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir).select("ordinal", text.confidence_bucket(F.col("confidence")).alias("bucket"))


@query(f"WITH {_EXPORT} SELECT o AS ordinal, sha256(evidence_text || chr(10)) AS content_key FROM v WHERE evidence_text IS NOT NULL")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir).filter("evidence_text is not null").select("ordinal", content_key(F.col("evidence_text")).alias("content_key"))
