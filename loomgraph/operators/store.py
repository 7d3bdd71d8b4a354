"""Stores as objects over edge tables, for callers that work question by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.files import exists
from ..plans.lineage import cut
from . import graph


class QuestionStore:
    """Edges by question (``qid, pos, head, relation, tail``). A question must be loaded before it is asked for; an unknown one is a KeyError."""

    def __init__(self, edges: DataFrame, questions: DataFrame | None = None):
        self.edges = cut(graph.adjacency(edges))
        self._known = (questions if questions is not None else edges).select("qid").filter("qid is not null").distinct()
        self._qid: str | None = None

    @classmethod
    def from_records(cls, records: DataFrame) -> QuestionStore:
        """A store of question records; a record without edges is a known question with an empty graph."""
        from ..sources.kgqa import edges_of

        return cls(edges_of(records), records)

    def add(self, edges: DataFrame) -> QuestionStore:
        """A store that holds these edges too; the edges of a question that it has already are replaced."""
        new = edges.select("qid").distinct()
        kept = self.edges.join(new, "qid", "left_anti")
        return QuestionStore(kept.unionByName(graph.adjacency(edges)), self._known.union(new))

    def qids(self) -> DataFrame:
        return self._known

    def load(self, qid: str) -> QuestionStore:
        if self._known.filter(F.col("qid") == qid).isEmpty():
            raise KeyError(qid)
        self._qid = qid
        return self

    def subgraph(self) -> DataFrame:
        if self._qid is None:
            raise RuntimeError("load a question first")
        return self.edges.filter(F.col("qid") == self._qid)

    def relations(self, node: str) -> list[str]:
        """A node's relations in stored order."""
        e = self.subgraph().filter(F.col("head") == node).groupBy("relation").agg(F.min("pos").alias("p"))
        return [r.relation for r in e.orderBy("p", "relation").collect()]

    def neighbors(self, node: str, relation: str) -> DataFrame:
        """The tails of a node along a relation: ``pos, tail``."""
        return self.subgraph().filter((F.col("head") == node) & (F.col("relation") == relation)).select("pos", "tail")


class EdgeStore:
    """Committed edges with their provenance, a Parquet folder. Appending the same records again adds nothing."""

    _KEY = ("head", "relation", "tail", "provenance")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self) -> bool:
        return exists(self.spark, self.path)

    def edges(self) -> DataFrame:
        if not self._there():
            record = "struct<chunk:string,span:struct<start:int,end:int>,route:string,confidence:double,extractor:string>"
            return self.spark.createDataFrame([], f"head string, relation string, tail string, provenance {record}")
        return self.spark.read.parquet(self.path)

    def commit(self, audited: DataFrame) -> int:
        """Write the committed proposals that are not there yet; how many."""
        record = F.struct("chunk", "span", "route", "confidence", "extractor").alias("provenance")
        new = audited.filter("committed").select(F.col("filer").alias("head"), "relation", F.col("target").alias("tail"), record).distinct()
        if self._there():
            old = self.edges().withColumn("_k", F.xxhash64(*self._KEY)).select("_k", *self._KEY)
            new = new.withColumn("_k", F.xxhash64(*self._KEY))
            same = [new["_k"] == old["_k"], *[new[c].eqNullSafe(old[c]) for c in self._KEY]]
            new = new.join(old, same, "left_anti").drop("_k")
        new = cut(new)
        new.write.mode("append").parquet(self.path)
        return new.count()

    def provenance(self, head: str, relation: str, tail: str) -> DataFrame:
        return self.edges().filter((F.col("head") == head) & (F.col("relation") == relation) & (F.col("tail") == tail)).select("provenance.*")

    def count(self) -> int:
        return self.edges().select("head", "relation", "tail").distinct().count()
