"""Graphs as edge tables ``[qid,] pos, head, relation, tail``: closure, hops, distances, neighbourhoods.

``pos`` is the stored order; it decides every tie. With a column ``qid`` each question has its own graph, without it all
share one. The hop loops run on the driver, one small job a hop, and each hop ends in a checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import REVERSE, TYPE_OF, lookup, reverse_map
from ..plans.lineage import cut
from ..plans.prefix import running


def _own(edges: DataFrame) -> list[str]:
    return ["qid"] if "qid" in edges.columns else []


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct edges with the position of their first appearance. Edges with a null part are dropped."""
    key = [*_own(edges), "head", "relation", "tail"]
    return edges.dropna(subset=key).groupBy(*key).agg(F.min("pos").alias("pos"))


def with_reverses(edges: DataFrame, reverses: dict[str, str] | None = None) -> DataFrame:
    """The edges and, where absent, the typed reverse of each; an edge without a known reverse has none.

    Reverses keep the position of their edge.
    """
    key = [*_own(edges), "head", "relation", "tail"]
    dim = F.broadcast(reverse_map(edges.sparkSession, reverses or REVERSE))
    turned = edges.join(dim, "relation").select(*_own(edges), "pos", F.col("tail").alias("head"), F.col("reverse").alias("relation"), F.col("head").alias("tail"))
    present = edges.select(*key).distinct()
    return edges.select(*_own(edges), "pos", *key[len(_own(edges)) :]).unionByName(adjacency(turned).join(present, key, "left_anti"))


def relations_of(edges: DataFrame) -> DataFrame:
    """Relations of each node, in the order of first appearance: ``node, relation, pos``."""
    return adjacency(edges).groupBy(*_own(edges), F.col("head").alias("node"), "relation").agg(F.min("pos").alias("pos"))


def neighbors(edges: DataFrame) -> DataFrame:
    """Distinct tails of each node and relation with their ``place`` (0 first) in stored order.

    The places come from one global order, so a node with any share of all edges is spread over the tasks like the others.
    """
    own = [*_own(edges), "node", "relation"]
    ordered = running(adjacency(edges).withColumnRenamed("head", "node"), [*map(F.col, own), F.col("pos"), F.col("tail")], {}, "_r")
    ordered = cut(ordered)
    first = ordered.groupBy(*own).agg(F.min("_r").alias("_f"))
    return ordered.join(first, own).select(*own, (F.col("_r") - F.col("_f")).alias("place"), "tail")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct tails of each node and relation, counted."""
    return edges.groupBy(*_own(edges), F.col("head").alias("node"), "relation").agg(F.count_distinct("tail").alias("degree"))


def top_relation(edges: DataFrame) -> DataFrame:
    """For each node the relation with most distinct tails, of several the least."""
    best = F.min(F.struct((-F.col("degree")).alias("d"), "relation")).alias("b")
    return degrees(edges).groupBy(*_own(edges), "node").agg(best).select(*_own(edges), "node", "b.relation", (-F.col("b.d")).alias("degree"))


def follow(start: DataFrame, edges: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Nodes reached from ``start`` (``source, node``) by exactly this sequence of relations: distinct ``source, node``."""
    at = start.select("source", "node").distinct()
    own = adjacency(edges)
    for r in sequence:
        hop = own.filter(F.col("relation") == r).select(F.col("head").alias("node"), F.col("tail").alias("next"))
        at = at.join(hop, "node").select("source", F.col("next").alias("node")).distinct()
    return at


def reached_ids(edges: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """What ``follow`` reaches from each head along two relations, as ``qid, reached`` (array of ids, each once), and the nodes' ids as ``node, id``.

    A node's tails along ``second`` are one list, which each source with an edge to the node takes whole, so no row of a source and a node is made. The lists
    of a source hold an edge of ``second`` once.
    """
    last = edges.filter(F.col("relation") == second).select(F.col("head").alias("middle"), F.col("tail").alias("node")).distinct()
    ids = cut(last.select("node").distinct().withColumn("id", F.monotonically_increasing_id()))
    lists = last.join(ids, "node").groupBy("middle").agg(F.collect_list("id").alias("list"))
    way = edges.filter(F.col("relation") == first).select(F.col("head").alias("qid"), F.col("tail").alias("middle")).distinct()
    return way.join(lists, "middle").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("reached")), ids


def entity_types(edges: DataFrame, person: Sequence[str] = ("officer_of", "director_of", "insider_bought")) -> DataFrame:
    """``entity, type`` inferred from relations: heads of ``person`` relations are people, tails of ``in_sector`` sectors, others companies."""
    e = edges.select("head", "relation", "tail")
    people = e.filter(F.col("relation").isin(*person)).select("head").union(e.filter(F.col("relation").isin(*[REVERSE[p] for p in person])).select("tail")).select(F.col("head").alias("entity"), F.lit(0).alias("k"))
    sectors = e.filter("relation = 'in_sector'").select("tail").union(e.filter("relation = 'sector_contains'").select("head")).select(F.col("tail").alias("entity"), F.lit(1).alias("k"))
    rest = e.select(F.col("head").alias("entity"), F.lit(2).alias("k")).union(e.select("tail", F.lit(2)))
    kinds = F.array(F.lit("person"), F.lit("sector"), F.lit("company"))
    return people.union(sectors).union(rest).groupBy("entity").agg(F.min("k").alias("k")).select("entity", F.get(kinds, F.col("k")).alias("type"))


def company_claims(edges: DataFrame) -> DataFrame:
    """Forward edges as filer-centred claims ``filer, type, target``; reverses are no claims."""
    return edges.select(F.col("head").alias("filer"), lookup(TYPE_OF, F.col("relation")).alias("type"), F.col("tail").alias("target")).filter("type is not null")


def expand(frontier: DataFrame, edges: DataFrame, beam: int) -> DataFrame:
    """One hop: ``qid, path_idx, node, relation`` and edges give ``qid, path_idx, pos, tail, rank`` of the first ``beam`` new paths.

    Paths in order, tails of a path in stored order; neither cycles nor equal paths are looked for. A beam below 1 is 1.
    """
    hop = frontier.join(edges.withColumnRenamed("head", "node"), [*_own(edges), "node", "relation"])
    order = Window.partitionBy("qid").orderBy("path_idx", "pos", "tail")
    return hop.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(beam, 1))


def distance_to(gold: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``node, dist``: hops to the nearest gold node (``[qid,] node``), by breadth-first search against the edges; farther ones are left out."""
    own = _own(edges)
    back = cut(edges.select(*own, F.col("tail").alias("at"), F.col("head").alias("node")).distinct())
    reached = cut(gold.select(*own, "node").distinct().withColumn("dist", F.lit(0)))
    last = reached
    for d in range(1, most + 1):
        fresh = last.select(*own, F.col("node").alias("at")).join(back, [*own, "at"]).select(*own, "node").distinct()
        last = cut(fresh.join(reached, [*own, "node"], "left_anti").withColumn("dist", F.lit(d)))
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    return reached


def frontier_distance(frontier: DataFrame, dist: DataFrame, cap: int) -> DataFrame:
    """``qid, dist``: least distance of a frontier's nodes (``qid, node``); the cap if none is known."""
    on = ["qid", "node"] if "qid" in dist.columns else ["node"]
    return frontier.join(dist, on, "left").groupBy("qid").agg(F.coalesce(F.min("dist"), F.lit(cap)).alias("dist"))


#: rows that one task of the neighbourhoods' join makes of one node
CELL = 1_000_000


def _within(topics: DataFrame, shared: DataFrame, depth: int) -> DataFrame:
    """``qid, node``: the nodes at most ``depth`` hops from each topic, each once."""
    ways = shared.select(F.col("head").alias("node"), F.col("tail").alias("next")).distinct()
    seen = cut(topics.select("qid", "node").distinct())
    last = seen
    for _ in range(depth):
        last = cut(last.join(ways, "node").select("qid", F.col("next").alias("node")).distinct().join(seen, ["qid", "node"], "left_anti"))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def neighborhood_sizes(topics: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``qid, edges``: how many edges are within ``depth + 1`` hops of each topic, from the nodes' degrees; topics without edges are left out."""
    shared = adjacency(edges.drop("qid"))
    return _within(topics, shared, depth).join(shared.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n")), "node").groupBy("qid").agg(F.sum("n").alias("edges"))


def _edges_from(at: DataFrame, shared: DataFrame) -> DataFrame:
    """``qid, head, relation, tail, pos``: the edges of the nodes of each ``qid``. A hub's many edges for many ``qid`` are a grid of cells, each joined on its own."""
    e = shared.withColumnRenamed("head", "node")
    both = at.groupBy("node").agg(F.count("*").alias("_n")).join(e.groupBy("node").agg(F.count("*").alias("_m")), "node").filter(F.col("_n") * F.col("_m") > CELL)
    side = F.broadcast(cut(both.select("node", F.ceil(F.sqrt(F.col("_n") * F.col("_m") / F.lit(float(CELL)))).cast("int").alias("_side"))))
    every = F.explode(F.sequence(F.lit(0), F.col("_side") - 1))
    dealt = lambda df, *ident: df.join(side, "node", "left").withColumn("_side", F.coalesce("_side", F.lit(1))).withColumn("_i", F.pmod(F.xxhash64(*ident), F.col("_side")).cast("int"))
    left = dealt(at, "qid").withColumn("_j", every).select("qid", "node", "_i", "_j")
    right = dealt(e, "relation", "tail").withColumnRenamed("_i", "_j").withColumn("_i", every).select("node", "relation", "tail", "pos", "_i", "_j")
    return left.join(right, ["node", "_i", "_j"]).select("qid", F.col("node").alias("head"), "relation", "tail", "pos")


def neighborhood(topics: DataFrame, edges: DataFrame, depth: int, most: int = 200, seed: int = 42, must: DataFrame | None = None) -> DataFrame:
    """Edges within ``depth + 1`` hops of each topic (``qid, node``); where more than ``most``, those of least hash, and always ``must``.

    A node is reached once, so its edges need no comparison with others: those of topics with ``most`` or fewer leave the join as they are.
    """
    shared = cut(adjacency(edges.drop("qid")))
    at = _within(topics, shared, depth)
    over = at.join(shared.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n")), "node").groupBy("qid").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("qid")
    over = cut(over)
    if over.isEmpty():
        kept = _edges_from(at, shared)
    else:
        pick = Window.partitionBy("qid").orderBy(F.xxhash64(F.lit(seed), "qid", "head", "relation", "tail"), "head", "relation", "tail")
        large = _edges_from(at.join(over, "qid", "left_semi"), shared).withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= most).drop("_r")
        kept = _edges_from(at.join(over, "qid", "left_anti"), shared).unionByName(large)
    return kept if must is None else kept.unionByName(must.select(*kept.columns)).distinct()


def _ways_to(at: DataFrame, step: DataFrame, gold: DataFrame, own: list[str]) -> DataFrame:
    """``at`` (``qid, node``, …) with the edges ``step`` that lead from a row's node to a gold (``qid, node``) of its question.

    Of a node's edges and a question's golds, the fewer are gone through and looked for among the others.
    """
    edges = step.groupBy(*own, "node").agg(F.count("*").alias("_edges"))
    golds = gold.groupBy("qid").agg(F.count("*").alias("_golds"))
    each = at.join(golds, "qid").join(edges, [*own, "node"])
    by_edge = each.filter("_edges <= _golds").join(step, [*own, "node"]).join(gold.withColumnRenamed("node", "next"), ["qid", "next"], "left_semi")
    by_gold = each.filter("_edges > _golds").join(gold.withColumnRenamed("node", "next"), "qid").join(step, [*own, "node", "next"])
    names = [*at.columns, "relation", "next", "pos"]
    return by_edge.select(*names).unionByName(by_gold.select(*names))


def shortest_scripts(questions: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``qid, script``: the relations of the shortest way from a topic to a gold, null if there is none within ``most`` hops.

    Breadth-first in stored order: of several shortest ways the one first found from the first topic, by the edges'
    positions. A topic that is gold has the empty script. The last hop goes to golds only; questions without golds take no part.
    """
    own = _own(edges)
    step = edges.select(*own, F.col("head").alias("node"), "relation", F.col("tail").alias("next"), "pos")
    asked = cut(questions.select("qid", "topics", F.array_distinct("golds").alias("golds")))
    gold = asked.select("qid", F.explode("golds").alias("node")).filter("node is not null")
    topics = asked.filter("size(golds) > 0").select("qid", F.posexplode("topics").alias("t", "node"))
    empty = F.array().cast("array<string>")
    level = cut(topics.groupBy("qid", "node").agg(F.min("t").alias("order")).withColumn("script", empty))
    seen, found = level.select("qid", "node"), None
    for d in range(most + 1):
        first = F.min(F.struct("order", "script")).alias("b")
        near = level if d and d == most else level.join(gold, ["qid", "node"], "left_semi")
        here = cut(near.groupBy("qid").agg(first).select("qid", "b.script"))
        found = here if found is None else found.unionByName(here)
        if d == most:
            break
        open_ = level.join(here, "qid", "left_anti")
        way = open_.join(step, [*own, "node"]) if d + 1 < most else _ways_to(open_, step, gold, own)
        best = F.min(F.struct("order", "pos", F.concat("script", F.array("relation")).alias("script"))).alias("b")
        nxt = way.groupBy("qid", F.col("next").alias("node")).agg(best).join(seen, ["qid", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("b.order", "b.pos", "node"))
        level = cut(nxt.withColumn("order", rank).select("qid", "node", "order", "b.script"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("qid", "node"))
    return asked.select("qid").join(found, "qid", "left")


def shaping_deltas(distances: Column, final: Column, scale: float) -> Column:
    """scale * (distance at a step - distance at the end), for an array of distances."""
    return F.transform(distances, lambda d: scale * (d - final))
