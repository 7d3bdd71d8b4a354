"""Budgeted beam traversal of all questions at once.

The state is one row a question: its frontier as an array of paths, and the spend. A hop is: candidate relations of the
distinct frontier nodes, the controller's choice, the policies, the expansion to ``beam`` paths. Questions that have ended take no
part in later hops; decisions leave the loop as rows and are put together once at the end, where the golds come back, too. Golds that are too many for
lists are counted instead: see ``with_golds``.

How many distinct tails the nodes of a frontier have together is not found by listing them for each question: see ``Fanout``.

Of a node's tails along a relation only the first ``beam`` can enter a frontier, so they are picked once, before the
loop, by a group limit that works before the shuffle; a hop then adds at most ``beam`` * ``beam`` paths to a question.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import STOP, controller_prompt, reader_answers, serialize_state, verbalize_paths
from ..plans.lineage import cut
from ..plans.ship import ship
from ..schemas import ACTION, PATH
from . import governance
from .graph import adjacency

_STEP = f"struct<step:int,state_repr:string,candidates:array<string>,action:{ACTION},frontier_nodes:array<string>,checks_passed:map<string,boolean>>"
AXES = ("hops", "llm_calls", "prompt_tokens", "gen_tokens")


class Controller:
    """Chooses an action from the state's columns ``step``, ``question``, ``frontier``, ``options`` (array of relation, degree, place) and
    what ``prepare`` added to the questions.

    ``select`` gives the action as a column and ``spend`` what a decision costs in prompt and generated tokens; a controller whose choice and cost come
    from one model call gives both by ``decide``.
    """

    def prepare(self, questions: DataFrame) -> DataFrame:
        return questions

    def counts(self, step: int) -> bool:
        """Whether the decision of this step looks at degrees; they are null where it does not."""
        return True

    def select(self) -> Column:
        raise TypeError("a controller gives select or decide")

    def spend(self) -> tuple[Column, Column]:
        return F.lit(0), F.lit(0)

    def decide(self, state: DataFrame) -> DataFrame:
        """The state with ``action``, ``_prompt`` and ``_gen``."""
        prompt, gen = self.spend()
        return state.withColumns({"action": self.select(), "_prompt": prompt, "_gen": gen})


class Synthesizer:
    """Turns the final frontier into answers: by default its nodes, each once, in order."""

    def answers(self) -> Column:
        """An array of names from the columns ``question`` and ``frontier``."""
        return frontier_nodes(F.col("frontier"))


def _act(kind: str, relation: Column, score: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), relation.cast("string").alias("relation"), score.cast("double").alias("score"))


STOP_ACTION = "STOP"


def _stop(score: float) -> Column:
    return _act(STOP_ACTION, F.lit(None), F.lit(score))


@dataclass(frozen=True)
class DegreeController(Controller):
    """The relation with most distinct tails, of several the least; stops after ``max_hops``."""

    max_hops: int = 2

    def counts(self, step: int) -> bool:
        return step < self.max_hops

    def select(self) -> Column:
        best = F.get(F.array_sort(F.transform("options", lambda o: F.struct((-o["degree"]).alias("d"), o["relation"].alias("relation")))), F.lit(0))
        return F.when((F.col("step") >= self.max_hops) | (best["d"] >= 0), _stop(1.0)).otherwise(_act("EXPAND", best["relation"], -best["d"]))


@dataclass(frozen=True)
class ScriptController(Controller):
    """Follows ``scripts`` (``qid, script``); stops with score 1 at the end, 0 where the script's relation is not at hand."""

    scripts: DataFrame = field(repr=False)

    def prepare(self, questions: DataFrame) -> DataFrame:
        return questions.join(self.scripts.select("qid", "script"), "qid", "left").withColumn("script", F.coalesce("script", F.array().cast("array<string>")))

    def select(self) -> Column:
        r = F.get(F.col("script"), F.col("step"))
        there = F.exists("options", lambda o: o["relation"] == r)
        return F.when(F.col("step") >= F.size("script"), _stop(1.0)).when(there, _act("EXPAND", r, F.lit(1.0))).otherwise(_stop(0.0))


@dataclass(frozen=True)
class Metered(Controller):
    """Another controller, with a cost in tokens for each decision (columns over the state)."""

    inner: Controller
    prompt_tokens: Column = field(repr=False)
    gen_tokens: Column = field(repr=False)

    def prepare(self, questions: DataFrame) -> DataFrame:
        return self.inner.prepare(questions)

    def select(self) -> Column:
        return self.inner.select()

    def spend(self) -> tuple[Column, Column]:
        return self.prompt_tokens, self.gen_tokens


@dataclass(frozen=True)
class ModelController(Controller):
    """A model chooses among the candidates and the stop token.

    ``load`` runs once a worker and gives a function of ``(prompt, candidates)`` to ``(chosen, logprob, tokens, prompt_tokens)``: a candidate or
    the stop token, the log-probability of all its tokens, forced ones included, and their number. The score is exp(logprob / tokens).
    A choice that is no candidate stops with score 0.
    """

    load: Callable[[], Callable[[str, list[str]], tuple[str, float, int, int]]] = field(repr=False)

    def decide(self, state: DataFrame) -> DataFrame:
        ship(state.sparkSession)
        load = self.load

        @F.pandas_udf("chosen string, score double, prompt_tokens long, gen_tokens long")
        def choose(prompts: pd.Series, candidates: pd.Series) -> pd.DataFrame:
            model = load()
            out = []
            for prompt, names in zip(prompts, candidates):
                chosen, logprob, tokens, prompt_tokens = model(prompt, [*names, STOP])
                out.append((chosen, math.exp(logprob / tokens) if tokens else 1.0, prompt_tokens, tokens))
            return pd.DataFrame(out, columns=["chosen", "score", "prompt_tokens", "gen_tokens"])

        names = F.transform("options", lambda o: o["relation"])
        made = state.withColumn("_m", choose(controller_prompt(serialize_state(F.col("question"), F.col("step"), F.col("frontier")), names), names))
        chosen, score = F.col("_m.chosen"), F.col("_m.score")
        action = F.when(chosen == STOP, _act(STOP_ACTION, F.lit(None), score)).when(F.array_contains(names, chosen), _act("EXPAND", chosen, score)).otherwise(_stop(0.0))
        return made.withColumns({"action": action, "_prompt": F.col("_m.prompt_tokens"), "_gen": F.col("_m.gen_tokens")}).drop("_m")


@dataclass(frozen=True)
class PathReader(Synthesizer):
    """A model reads the question and the paths and names the answers; names that stand on no path do not count, and without any the frontier's nodes are given."""

    generate: Callable[[Column], Column] = field(repr=False)

    def answers(self) -> Column:
        paths = F.col("frontier")
        nodes = F.flatten(F.transform(paths, lambda p: F.concat(F.array(p["root"]), F.flatten(F.transform(p["triples"], lambda t: F.array(t["head"], t["tail"]))))))
        said = self.generate(F.concat(F.lit("question: "), F.col("question"), F.lit("\npaths:\n"), verbalize_paths(paths), F.lit("\nanswers:")))
        return reader_answers(said, F.filter(nodes, lambda n: n.isNotNull()), frontier_nodes(paths))


@dataclass(frozen=True)
class Budget:
    """Caps; null is none. A question is exhausted when a spend reaches its cap.

    Time is measured over the whole loop and known only at its end, so ``max_wall_ms`` interrupts no traversal; a cap of 0 or less is reached
    at the start.
    """

    max_hops: int | None = 3
    max_llm_calls: int | None = 50
    max_prompt_tokens: int | None = None
    max_gen_tokens: int | None = None
    max_wall_ms: float | None = None

    def exhausted(self) -> Column:
        out = F.lit(self.max_wall_ms is not None and self.max_wall_ms <= 0)
        for axis in AXES:
            cap = getattr(self, f"max_{axis}")
            if cap is not None:
                out = out | (F.col(axis) >= cap)
        return out


def _node(p: Column) -> Column:
    return F.coalesce(F.try_element_at(p["triples"], F.lit(-1))["tail"], p["root"])


def frontier_nodes(frontier: Column) -> Column:
    return F.array_distinct(F.transform(frontier, _node))


class Fanout:
    """The candidate relations of frontiers, with the number of distinct tails that their nodes have together.

    The tails of a node and relation are a list with an id. The lists of a question's relation are put largest first, and each one's tails are looked
    for in those before it, once for every such row of lists however many questions have it. So of hubs, which stand in the frontiers
    of many questions, only few rows are listed, and a list that stands alone is not listed at all.
    """

    def __init__(self, graph: DataFrame, own: list[str]):
        self.own = own
        lists = graph.groupBy(*own, F.col("head").alias("node"), "relation").agg(F.count("*").alias("degree"), F.min("pos").alias("pos"))
        self.lists = cut(lists.withColumn("list", F.monotonically_increasing_id()))
        tails = cut(graph.select("tail").distinct().withColumn("t", F.monotonically_increasing_id()))
        ided = graph.withColumnRenamed("head", "node").join(self.lists.drop("pos"), [*own, "node", "relation"]).select("list", "tail")
        self.tails = cut(ided.join(tails, "tail").select("list", "t"))

    def listed(self, row: DataFrame) -> DataFrame:
        """``id, t, list``: the tails of the last list of each row of lists (``id, row``), with each list before it."""
        last = row.select("id", F.element_at("row", -1).alias("list"), F.slice("row", F.lit(1), F.size("row") - 1).alias("before"))
        return last.join(self.tails, "list").select("id", "t", F.explode("before").alias("list"))

    def options(self, nodes: DataFrame, counted: bool = True) -> DataFrame:
        """``qid, options`` (array of order, relation, degree) of the nodes of frontiers (``qid, place, node``; a node once a question); degrees only if ``counted``."""
        at = nodes.join(self.lists, [*self.own, "node"])
        order = F.min(F.struct("place", "pos")).alias("order")
        gathered = lambda each, degree: each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("order", "relation", degree.alias("degree")))).alias("options"))
        if not counted:
            return gathered(at.groupBy("qid", "relation").agg(order), F.lit(None).cast("long"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "list"))), lambda x: x["list"])
        each = cut(at.groupBy("qid", "relation").agg(order, F.sum("degree").alias("all"), ordered.alias("lists")))
        rows = F.transform(F.sequence(F.lit(2), F.size("lists")), lambda n: F.slice("lists", F.lit(1), n))
        several = each.filter(F.size("lists") > 1).select("qid", "relation", F.explode(rows).alias("row"))
        row = cut(several.select("row").distinct().withColumn("id", F.monotonically_increasing_id()))
        again = self.listed(row).join(self.tails, ["list", "t"]).select("id", "t").distinct().groupBy("id").agg(F.count("*").alias("again"))
        twice = several.join(row.join(again, "id").select("row", "again"), "row").groupBy("qid", "relation").agg(F.sum("again").alias("twice"))
        return gathered(each.join(twice, ["qid", "relation"], "left"), F.col("all") - F.coalesce("twice", F.lit(0)))


def traverse(
    questions: DataFrame,
    edges: DataFrame,
    controller: Controller,
    budget: Budget | None = None,
    beam: int = 16,
    max_steps: int = 32,
    policies: Sequence[governance.HopPolicy] = (),
    synthesizer: Synthesizer | None = None,
) -> DataFrame:
    """``qid, answers, frontier, hops, llm_calls, …, steps, hit, verdict``: a row for each question.

    Questions with several rows a ``qid`` count once (any of them). Null topics are none; a question without
    topics has no answers and spends nothing.
    """
    budget, beam = budget or Budget(), max(beam, 1)
    own = ["qid"] if "qid" in edges.columns else []
    graph = cut(adjacency(edges))
    first = Window.partitionBy(*own, "head", "relation").orderBy("pos", "tail")
    ways = cut(graph.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= beam).select(*own, F.col("head").alias("node"), "relation", "place", "tail"))
    fanout = Fanout(graph, own)
    sources = next((p.sources for p in policies if p.sources is not None), None)
    if sources is not None:
        on = [c for c in own if c in sources.columns]
        sources = cut(sources.select(*on, F.col("head").alias("node"), "relation").distinct())
    strings = lambda c: F.coalesce(F.filter(F.col(c), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    q = cut(questions.dropDuplicates(["qid"]).select("qid", F.coalesce("question", F.lit("")).alias("question"), strings("topics").alias("topics"), strings("golds").alias("golds")))
    root = F.transform("topics", lambda t: F.struct(t.alias("root"), F.array().cast("array<struct<head:string,relation:string,tail:string>>").alias("triples")).cast(PATH))
    zero = F.lit(0).cast("long")
    state = cut(controller.prepare(q.select("qid", "question", root.alias("frontier"), F.lit(0).alias("step"), *[zero.alias(a) for a in AXES], F.lit(True).alias("verdict"))))
    keep = state.columns
    ended: list[DataFrame] = []
    decided: list[DataFrame] = []
    for step in range(max_steps):
        going = ~budget.exhausted() & (F.size("frontier") > 0)
        ended.append(state.filter(~going))
        state = state.filter(going)
        nodes = state.select("qid", F.posexplode(frontier_nodes(F.col("frontier"))).alias("place", "node"))
        met = state.join(fanout.options(nodes, controller.counts(step)), "qid", "left")
        if sources is not None:
            known = nodes.join(sources, [*on, "node"]).groupBy("qid").agg(F.collect_set("relation").alias("sourced"))
            met = met.join(known, "qid", "left")
        chosen = controller.decide(met.filter("options is not null")).withColumn("nodes", frontier_nodes(F.col("frontier")))  # for the policies
        chosen = chosen.withColumns({"llm_calls": F.col("llm_calls") + 1, "prompt_tokens": F.col("prompt_tokens") + F.col("_prompt"), "gen_tokens": F.col("gen_tokens") + F.col("_gen")})
        checks = governance.hop_checks(policies)
        chosen = chosen.withColumn("checks", checks).withColumn("verdict", F.col("verdict") & F.forall(F.map_values("checks"), lambda v: v))
        chosen = cut(chosen.select(*keep, "action", F.transform("options", lambda o: o["relation"]).alias("candidates"), "checks", governance.hop_blocked(policies, checks).alias("blocked")))
        trace = F.struct(
            F.col("step"), serialize_state(F.col("question"), F.col("step"), F.col("frontier")).alias("state_repr"),
            F.col("candidates"), F.col("action"), frontier_nodes(F.col("frontier")).alias("frontier_nodes"), F.col("checks").alias("checks_passed"),
        ).cast(_STEP)
        decided.append(chosen.select("qid", trace.alias("trace")))
        ended.append(state.join(chosen.select("qid"), "qid", "left_anti"))
        stop = F.col("blocked") | (F.col("action.type") == STOP_ACTION)
        ended.append(chosen.filter(stop).select(*keep))
        go = chosen.filter(~stop)
        paths = go.select("qid", F.posexplode("frontier").alias("path_idx", "path"), F.col("action.relation").alias("relation")).withColumn("node", _node(F.col("path")))
        hop = paths.join(ways, [*own, "node", "relation"])
        grown = F.struct(F.col("path.root").alias("root"), F.concat("path.triples", F.array(F.struct(F.col("node").alias("head"), F.col("relation"), F.col("tail")))).alias("triples"))
        new = hop.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("path_idx", "place", grown.alias("p")))), 1, beam).alias("l"))
        went = go.select(*keep).join(new.select("qid", F.transform("l", lambda x: x["p"]).cast(f"array<{PATH}>").alias("next")), "qid", "left").withColumn("moved", F.col("next").isNotNull())
        went = cut(went.withColumn("frontier", F.coalesce("next", "frontier")).drop("next"))
        ended.append(went.filter("not moved").select(*keep))
        state = went.filter("moved").withColumns({"step": F.col("step") + 1, "hops": F.col("hops") + 1}).select(*keep)
        if state.isEmpty():
            break
    ended.append(state)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    out = union([e.select(*keep) for e in ended]).join(q.select("qid", "golds"), "qid").select("qid", "question", "golds", *keep[2:])
    if decided:
        steps = union(decided).groupBy("qid").agg(F.array_sort(F.collect_list("trace"), lambda x, y: x["step"] - y["step"]).alias("steps"))
        out = out.join(steps, "qid", "left").withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{_STEP}>")))
    else:
        out = out.withColumn("steps", F.array().cast(f"array<{_STEP}>"))
    return out.withColumn("answers", (synthesizer or Synthesizer()).answers()).withColumn("hit", metrics.hit(F.col("answers"), F.col("golds")))


def with_golds(results: DataFrame, reached: DataFrame, ids: DataFrame) -> DataFrame:
    """Results whose ``golds`` are those among the answers, with ``n_golds`` for all of a question's golds and ``hit``.

    The golds are ids (``qid, reached``) of nodes (``node, id``), each once a question; the answers are looked up among them by id.
    """
    said = results.select("qid", F.explode("answers").alias("node")).join(ids, "node").groupBy("qid").agg(F.collect_list(F.struct("id", "node")).alias("said"))
    right = F.transform(F.filter("said", lambda x: F.array_contains("reached", x["id"])), lambda x: x["node"])
    known = cut(reached.join(said, "qid", "left").select("qid", right.alias("golds"), F.size("reached").alias("n_golds")))
    none = F.array().cast("array<string>")
    out = results.drop("golds", "hit").join(known, "qid", "left").withColumns({"golds": F.coalesce("golds", none), "n_golds": F.coalesce("n_golds", F.lit(0))})
    return out.withColumn("hit", (F.size("golds") > 0).cast("double"))


def summary(results: DataFrame, axes: Sequence[str] = ("hops", "llm_calls")) -> DataFrame:
    """Mean hit, hits@1 and F1, mean, median, p90, p99 and maximum of the spends, share of good audits; zeros without rows."""
    a, g, total = F.col("answers"), F.col("golds"), F.col("n_golds") if "n_golds" in results.columns else None
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    cols = [F.count("*").alias("n_questions"), mean("hit").alias("hit"), mean(metrics.hits_at_1(a, g)).alias("hits_at_1"), mean(metrics.answer_f1(a, g, total)).alias("f1")]
    for axis in axes:
        cols += [c.alias(f"{axis}_{n}") for n, c in cost_statistics(F.col(axis)).items()]
    return results.agg(*cols, mean(F.col("verdict").cast("double")).alias("audit_pass_rate"))


def cost_statistics(x: Column) -> dict[str, Column]:
    """Mean, median, p90, p99 (interpolated) and maximum; zeros without rows."""
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {"mean": zero(F.avg(x)), "median": zero(F.get(p, F.lit(0))), "p90": zero(F.get(p, F.lit(1))), "p99": zero(F.get(p, F.lit(2))), "max": zero(F.max(x))}


def trajectory_steps(results: DataFrame) -> DataFrame:
    return results.select("qid", F.inline("steps"))


def sft_rows(results: DataFrame) -> DataFrame:
    """A supervised row for each decision of a trajectory: the state, the candidates, the relation or the stop token."""
    s = trajectory_steps(results)
    return s.select("qid", "step", F.col("state_repr").alias("state"), "candidates", F.coalesce("action.relation", F.lit("[STOP]")).alias("target"))


def rollout_rows(results: DataFrame, reward: Column, shaping: Column | None = None) -> DataFrame:
    """Decisions with the episode's reward and, given one delta a step, the shaped reward."""
    r = results.withColumn("reward", reward).withColumn("_d", shaping if shaping is not None else F.array().cast("array<double>"))
    return r.select("qid", "reward", F.posexplode("steps").alias("position", "s"), "_d").select("qid", "position", F.col("s.state_repr").alias("state"), "s.candidates", "s.action", "reward", (F.col("reward") + F.coalesce(F.get("_d", F.col("position")), F.lit(0.0))).alias("shaped"))


def mine(questions: DataFrame, edges: DataFrame, max_hops: int, beam: int = 16) -> tuple[DataFrame, DataFrame]:
    """Shortest scripts replayed by the engine: the trajectories that hit, and one row of counters with a histogram of depths."""
    from .graph import shortest_scripts

    scripts = cut(shortest_scripts(questions, edges, max_hops))
    ready = questions.join(scripts.filter("script is not null").select("qid"), "qid", "left_semi")
    runs = cut(traverse(ready, edges, ScriptController(scripts), Budget(max_hops + 1, None), beam, max_hops + 1))
    hits = runs.filter("hit = 1.0")
    depths = hits.groupBy(F.col("hops").cast("int").alias("d")).agg(F.count("*").alias("n"))
    stats = scripts.agg(F.count("*").alias("questions"), F.count_if(F.col("script").isNull()).alias("unreachable"), F.count_if(F.size("script") == 0).alias("trivial"))
    missed = runs.agg(F.count_if(F.col("hit") == 0).alias("replay_missed"), F.count_if(F.col("hit") == 1).alias("mined"))
    hist = depths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "n")))).alias("depths"))
    return hits, stats.crossJoin(missed).crossJoin(hist)  # three tables of one row
