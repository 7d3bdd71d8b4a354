"""Queries of the traversal over the companies' graph: fan-out, ties, dead ends, misses, policies, budgets and mining.

Each question asks, from a company, for the subsidiaries of its competitors; some have none. The SQL unrolls the loop's two hops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import governance, graph, traverse
from .graph_queries import _CLOSED, _TYPE_CASE, _TYPES, closed, companies, table
from .lineage import cut
from .registry import query

BEAM = 4
FEW = 2


def company_questions(spark: SparkSession, sf_dir: str, edges: DataFrame, answered: bool = True) -> DataFrame:
    """A question for each company; its golds only where they are ``answered`` for, else none."""
    e = edges.select("head", "relation", "tail")
    start = e.select(F.col("head").alias("source"), F.col("head").alias("node")).distinct()
    if not answered:
        return start.select(F.col("source").alias("qid"), F.concat(F.lit("of "), "source").alias("question"), F.array("source").alias("topics"), F.array().cast("array<string>").alias("golds"))
    golds = graph.follow(start, edges, ["competitor_of", "has_subsidiary"]).groupBy(F.col("source").alias("qid")).agg(F.array_sort(F.collect_set("node")).alias("golds"))
    return start.select(F.col("source").alias("qid")).join(golds, "qid", "left").select("qid", F.concat(F.lit("of "), "qid").alias("question"), F.array("qid").alias("topics"), F.coalesce("golds", F.array().cast("array<string>")).alias("golds"))


_GOLD = "g AS (SELECT DISTINCT a.head AS qid, b.tail AS node FROM closed a JOIN closed b ON a.relation = 'competitor_of' AND b.head = a.tail AND b.relation = 'has_subsidiary')"


def _options(k: int) -> str:
    return f"""o{k} AS (SELECT qid, relation, count(DISTINCT tail) AS d FROM (SELECT DISTINCT qid, node FROM f{k}) f JOIN closed ON closed.head = f.node GROUP BY 1, 2),
n{k} AS (SELECT qid, count(*) AS options FROM o{k} GROUP BY 1)"""


def _widest(k: int, where: str = "true") -> str:
    return f"c{k} AS (SELECT qid, relation, d FROM o{k} WHERE {where} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d DESC, relation) = 1)"


def _hop(k: int, beam: int, choice: str | None = None) -> str:
    return f"""f{k + 1} AS (SELECT * FROM (SELECT f.qid, row_number() OVER (PARTITION BY f.qid ORDER BY f.i, e.pos, e.tail) AS i, e.tail AS node, f.chain || ' -[' || e.relation || ']-> ' || e.tail AS chain
  FROM f{k} f JOIN {choice or f'c{k}'} c USING (qid) JOIN closed e ON e.head = f.node AND e.relation = c.relation) WHERE i <= {beam})"""


_START = "f0 AS (SELECT DISTINCT head AS qid, 1 AS i, head AS node, head AS chain FROM closed)"
_LAST = """last AS (SELECT qid, 2 AS hops, i, node FROM f2 UNION ALL SELECT qid, 1, i, node FROM f1 WHERE qid NOT IN (SELECT qid FROM f2)
  UNION ALL SELECT qid, 0, i, node FROM f0 WHERE qid NOT IN (SELECT qid FROM f1)),
a AS (SELECT qid, hops, node, min(i) AS i FROM last GROUP BY ALL),
s AS (SELECT a.qid, any_value(hops) AS hops, string_agg(a.node, '|' ORDER BY i) AS answers, count(*) AS na, count(g.node) AS tp, arg_min(g.node IS NOT NULL, i)::INT::DOUBLE AS first FROM a LEFT JOIN g ON g.qid = a.qid AND g.node = a.node GROUP BY 1),
m AS (SELECT s.*, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN tp > 0 THEN 2.0 * tp / (na + ng) ELSE 0.0 END AS f1 FROM s LEFT JOIN (SELECT qid, count(*) AS ng FROM g GROUP BY 1) USING (qid))"""
_WALK = f"{_CLOSED}, {_GOLD}, {_START}, {_options(0)}, {_widest(0)}, {_hop(0, BEAM)}, {_options(1)}, {_widest(1)}, {_hop(1, BEAM)}, {_options(2)}, {_LAST}, r AS (SELECT m.*, hops + CASE WHEN hops = 2 AND n2.qid IS NOT NULL THEN 1 ELSE 0 END AS llm_calls FROM m LEFT JOIN n2 USING (qid))"


def _run(spark: SparkSession, sf_dir: str, controller: traverse.Controller | None = None, budget: traverse.Budget | None = None, policies=(), answered: bool = True) -> DataFrame:
    e = cut(closed(spark, sf_dir))
    return traverse.traverse(company_questions(spark, sf_dir, e, answered), e, controller or traverse.DegreeController(2), budget or traverse.Budget(3, 50), BEAM, policies=policies)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree controller's results with counted golds."""
    e = cut(graph.with_reverses(cut(companies(spark, sf_dir))))
    r = traverse.traverse(company_questions(spark, sf_dir, e, False), e, traverse.DegreeController(2), traverse.Budget(3, 50), BEAM)
    return traverse.with_golds(r, *graph.reached_ids(e, "competitor_of", "has_subsidiary"))


@query(f"WITH {_WALK} SELECT qid, answers, hops, llm_calls, hit, f1 FROM r")
def traversal_degree_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's question by the degree controller, two hops and a stop."""
    r = _run(spark, sf_dir)
    return r.select("qid", F.array_join("answers", "|").alias("answers"), "hops", "llm_calls", "hit", metrics.answer_f1(F.col("answers"), F.col("golds")).alias("f1"))


_STATS = ", ".join(f"avg({x})::DOUBLE AS {x}_mean, quantile_cont({x}, 0.5)::DOUBLE AS {x}_median, quantile_cont({x}, 0.9)::DOUBLE AS {x}_p90, quantile_cont({x}, 0.99)::DOUBLE AS {x}_p99, max({x})::DOUBLE AS {x}_max" for x in ("hops", "llm_calls"))


@query(f"WITH {_WALK} SELECT count(*) AS n_questions, avg(hit) AS hit, avg(first) AS hits_at_1, avg(f1) AS f1, {_STATS}, 1.0 AS audit_pass_rate FROM r")
def harness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.summary(_scored(spark, sf_dir))


@query(f"WITH {_WALK} SELECT qid, 0 AS step, relation, d::DOUBLE AS score FROM c0 UNION ALL SELECT qid, 1, relation, d FROM c1 UNION ALL SELECT qid, 2, NULL, 1.0 FROM n2")
def trajectory_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of every trajectory, in order."""
    return traverse.trajectory_steps(_run(spark, sf_dir, answered=False)).select("qid", "step", "action.relation", "action.score")


_TOKENS = f"""{_WALK}, p AS (SELECT n0.qid, 10 * n0.options AS p0, 10 * n1.options AS p1, 10 * n2.options AS p2 FROM n0 LEFT JOIN n1 USING (qid) LEFT JOIN n2 USING (qid))
SELECT qid, CASE WHEN p0 >= 40 OR p1 IS NULL THEN 1 ELSE 2 END AS hops, CASE WHEN p0 >= 40 OR p1 IS NULL THEN 1 WHEN p0 + p1 >= 40 OR p2 IS NULL THEN 2 ELSE 3 END AS llm_calls,
  p0 + CASE WHEN p0 >= 40 OR p1 IS NULL THEN 0 WHEN p0 + p1 >= 40 OR p2 IS NULL THEN p1 ELSE p1 + p2 END AS prompt_tokens,
  3 * CASE WHEN p0 >= 40 OR p1 IS NULL THEN 1 WHEN p0 + p1 >= 40 OR p2 IS NULL THEN 2 ELSE 3 END AS gen_tokens FROM p"""


@query(f"WITH {_TOKENS}")
def traversal_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A controller that pays ten prompt tokens a candidate and three generated ones a decision, until forty prompt tokens are spent."""
    c = traverse.Metered(traverse.DegreeController(2), F.size("options") * 10, F.lit(3))
    r = _run(spark, sf_dir, c, traverse.Budget(None, None, max_prompt_tokens=40), answered=False)
    return r.select("qid", "hops", "llm_calls", "prompt_tokens", "gen_tokens")


@query(f"WITH {_WALK} SELECT n0.qid, 1 AS hops, 1 AS llm_calls, 3 AS gen_tokens FROM n0")
def traversal_generation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap on generated tokens that the first decision reaches."""
    r = _run(spark, sf_dir, traverse.Metered(traverse.DegreeController(2), F.lit(0), F.lit(3)), traverse.Budget(None, None, max_gen_tokens=3))
    return r.select("qid", "hops", "llm_calls", "gen_tokens")


def _policies(spark: SparkSession, sf_dir: str) -> tuple[governance.HopPolicy, ...]:
    relation = F.try_element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), F.lower(F.trim("relationship_type")))
    sources = table(spark, sf_dir, "company_relationships").filter("evidence_text is not null").select(F.col("source_company_name").alias("head"), relation.alias("relation"))
    return governance.relation_allowlist(("c*_of", "partner_of"), mandatory=False), governance.confidence_floor(2.0), governance.provenance_required(sources.distinct(), mandatory=False)


def _checked(k: int) -> str:
    return f"""p{k} AS (SELECT c.qid, {k} AS step, c.relation, coalesce(regexp_full_match(c.relation, 'c.*_of|partner_of'), false) AS allowed, c.d >= 2 AS floor,
  EXISTS (SELECT 1 FROM f{k} f JOIN src ON src.head = f.node AND src.relation = c.relation WHERE f.qid = c.qid) AS sourced, c.d::DOUBLE AS confidence FROM c{k} c)"""


_GOVERNED = f"""{_CLOSED}, {_GOLD}, src AS (SELECT DISTINCT source_company_name AS head, {_TYPE_CASE} AS relation FROM company_relationships WHERE evidence_text IS NOT NULL), {_START}, {_options(0)}, {_widest(0)}, {_checked(0)},
k0 AS (SELECT * FROM c0 WHERE d >= 2), {_hop(0, BEAM, 'k0')}, {_options(1)}, {_widest(1)}, {_checked(1)}, k1 AS (SELECT * FROM c1 WHERE d >= 2), {_hop(1, BEAM, 'k1')}, {_options(2)},
au AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT qid, 2, '', true, true, true, 1.0 FROM n2)"""


@query(f"WITH {_GOVERNED} SELECT qid, step, relation, allowed AS relation_allowlist, floor AS confidence_floor, sourced AS provenance_required, confidence FROM au")
def hop_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits under an allowlist and a provenance rule that only warn and a floor that blocks."""
    a = governance.hop_audits(_run(spark, sf_dir, policies=_policies(spark, sf_dir), answered=False))
    return a.select("qid", "step", "relation", *[F.col(f"checks_passed.{n}").alias(n) for n in ("relation_allowlist", "confidence_floor", "provenance_required")], "confidence")


@query(f"WITH {_GOVERNED} SELECT qid, count(*) AS hops, bool_and(allowed AND floor AND sourced) AS verdict FROM au GROUP BY 1")
def hop_audit_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.certificates(governance.hop_audits(_run(spark, sf_dir, policies=_policies(spark, sf_dir))))


@query(f"WITH {_GOVERNED}, {_LAST}, v AS (SELECT qid, count(*) AS llm_calls, bool_and(allowed AND floor AND sourced) AS verdict FROM au GROUP BY 1) SELECT qid, hops, llm_calls, answers, verdict FROM m JOIN v USING (qid)")
def blocked_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed mandatory policy ends a traversal where it is, at the cost of the call."""
    r = _run(spark, sf_dir, policies=_policies(spark, sf_dir))
    return r.select("qid", "hops", "llm_calls", F.array_join("answers", "|").alias("answers"), "verdict")


@query(f"WITH {_CLOSED} SELECT DISTINCT head AS qid, 0 AS hops, 1 AS llm_calls, head AS answers, false AS verdict FROM closed")
def unsourced_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any sources a mandatory provenance rule blocks every expansion."""
    r = _run(spark, sf_dir, policies=(governance.provenance_required(),))
    return r.select("qid", "hops", "llm_calls", F.array_join("answers", "|").alias("answers"), "verdict")


# mining: scripts of at most two relations, replayed with a beam of two
_SCRIPTS = f"""{_CLOSED}, {_GOLD}, q AS (SELECT DISTINCT head AS qid FROM closed),
z AS (SELECT qid, []::VARCHAR[] AS script FROM q JOIN g USING (qid) WHERE node = qid),
l1 AS (SELECT head AS qid, tail AS node, min(struct_pack(pos := pos, r := relation)) AS b FROM closed WHERE tail <> head GROUP BY 1, 2),
r1 AS (SELECT qid, node, b.r AS rel, row_number() OVER (PARTITION BY qid ORDER BY b.pos, node) AS o FROM l1),
d1 AS (SELECT qid, arg_min([rel], o) AS script FROM r1 JOIN g USING (qid, node) WHERE qid NOT IN (SELECT qid FROM z) GROUP BY 1),
l2 AS (SELECT r1.qid, c.tail AS node, min(struct_pack(o := r1.o, pos := c.pos, r1 := r1.rel, r2 := c.relation)) AS b FROM r1 JOIN closed c ON c.head = r1.node
  WHERE r1.qid NOT IN (SELECT qid FROM z) AND r1.qid NOT IN (SELECT qid FROM d1) AND c.tail <> r1.qid AND NOT EXISTS (SELECT 1 FROM r1 x WHERE x.qid = r1.qid AND x.node = c.tail) GROUP BY 1, 2),
r2 AS (SELECT qid, node, b, row_number() OVER (PARTITION BY qid ORDER BY b.o, b.pos, node) AS o FROM l2),
d2 AS (SELECT qid, arg_min([b.r1, b.r2], o) AS script FROM r2 JOIN g USING (qid, node) GROUP BY 1),
sc AS (SELECT * FROM z UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)"""


def _mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = cut(closed(spark, sf_dir))
    return traverse.mine(company_questions(spark, sf_dir, e), e, 2, FEW)


@query(f"WITH {_SCRIPTS} SELECT qid, array_to_string(script, ',') AS script FROM q LEFT JOIN sc USING (qid)")
def shortest_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the shortest way from each company to an answer: empty if it is one, null if there is none within two hops."""
    e = cut(closed(spark, sf_dir))
    return graph.shortest_scripts(company_questions(spark, sf_dir, e), e, 2).select("qid", F.array_join("script", ",").alias("script"))


_REPLAY = f"""{_SCRIPTS}, f0 AS (SELECT qid, 1 AS i, qid AS node, qid AS chain FROM sc), {_options(0)}, k0 AS (SELECT qid, script[1] AS relation FROM sc WHERE len(script) > 0), {_hop(0, FEW, 'k0')},
{_options(1)}, k1 AS (SELECT sc.qid, script[2] AS relation FROM sc JOIN o1 ON o1.qid = sc.qid AND o1.relation = script[2]), {_hop(1, FEW, 'k1')}, {_options(2)}, {_LAST}, h AS (SELECT * FROM m WHERE hit = 1.0)"""


def _text(k: int) -> str:
    return f"'Q: of ' || qid || ' || step={k} || frontier: ' || (SELECT string_agg(chain, ' | ' ORDER BY i) FROM f{k} WHERE f{k}.qid = h.qid)"


@query(f"""WITH {_REPLAY} SELECT qid, 0 AS step, {_text(0)} AS state, coalesce(relation, '[STOP]') AS target FROM h JOIN n0 USING (qid) LEFT JOIN k0 USING (qid)
UNION ALL SELECT qid, 1, {_text(1)}, coalesce(relation, '[STOP]') FROM h JOIN n1 USING (qid) LEFT JOIN k1 USING (qid)
UNION ALL SELECT qid, 2, {_text(2)}, '[STOP]' FROM h JOIN n2 USING (qid)""")
def mined_sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised rows of the mined trajectories that hit."""
    hits, _ = _mined(spark, sf_dir)
    return traverse.sft_rows(hits).select("qid", "step", "state", "target")


@query(f"""WITH {_REPLAY}, dp AS (SELECT hops AS d, count(*) AS n FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM q WHERE qid NOT IN (SELECT qid FROM sc)) AS unreachable, (SELECT count(*) FROM z) AS trivial,
  (SELECT count(*) FROM m WHERE hit = 0) AS replay_missed, (SELECT count(*) FROM h) AS mined, (SELECT string_agg(d || ':' || n, ',' ORDER BY d) FROM dp) AS depths""")
def mining_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = _mined(spark, sf_dir)
    joined = F.array_join(F.transform(F.map_entries("depths"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return stats.withColumn("depths", joined)


@query(f"""WITH {_SCRIPTS}, e0 AS (SELECT q.qid, c.head, c.relation, c.tail FROM q JOIN closed c ON c.head = q.qid WHERE EXISTS (SELECT 1 FROM closed x WHERE x.head = q.qid AND x.relation = 'has_subsidiary')),
e1 AS (SELECT qid, c.head, c.relation, c.tail FROM (SELECT DISTINCT qid, tail FROM e0 WHERE tail <> qid) o JOIN closed c ON c.head = o.tail)
SELECT * FROM e0 UNION SELECT * FROM e1""")
def question_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges within two hops of each company with a subsidiary, none left out."""
    e = cut(closed(spark, sf_dir).drop("qid"))
    topics = e.filter("relation = 'has_subsidiary'").select(F.col("head").alias("qid"), F.col("head").alias("node")).distinct()
    return graph.neighborhood(topics, e, 1, most=1 << 30).select("qid", "head", "relation", "tail")
