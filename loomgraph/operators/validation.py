"""Checks of an experiment against a frozen baseline."""

from __future__ import annotations

import os
import platform
import re
import sys
from collections.abc import Callable, Mapping, Sequence
from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import path_digest, rows_digest
from ..plans.ship import ship
from . import cascade

BUDGETS = (0.15, 0.20, 0.25)


def freeze(rows: DataFrame, tau: float, tokens: DataFrame | None = None) -> DataFrame:
    """One row: calls escalated at ``confidence < tau``, metrics, digests of the decisions and of what they rest on, escalated tokens.

    ``rows``: scored rows with ``ordinal`` (order of the digest). ``tokens``: ``key, input_tokens, output_tokens``.
    """
    esc = F.coalesce(F.col("confidence") < tau, F.lit(False))
    d = rows.withColumn("esc", esc)
    if tokens is not None:
        d = d.join(tokens, "key", "left")
    else:
        d = d.withColumns({"input_tokens": F.lit(0), "output_tokens": F.lit(0)})
    pick = lambda yes, no: F.sum(F.when(F.col("esc"), yes).otherwise(no))
    zero = F.lit(0).cast("long")
    a = d.agg(
        F.count("*").alias("n"), F.count_if("esc").alias("escalated_calls"), pick(F.col("n_gold"), F.col("tp")).alias("tp"), pick(zero, F.col("fp")).alias("fp"), pick(zero, F.col("fn")).alias("fn"),
        pick(zero + 1, F.col("exact")).alias("ex"), pick(F.col("input_tokens"), zero).alias("escalated_input_tokens"), pick(F.col("output_tokens"), zero).alias("escalated_output_tokens"),
    )
    out = a.select("n", "escalated_calls", (F.col("escalated_calls") / F.greatest(F.col("n"), F.lit(1))).alias("escalation_rate"), *cascade.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("ex"), F.col("n")), "escalated_input_tokens", "escalated_output_tokens")
    decision = rows_digest(d, "ordinal", F.to_json(F.struct("key", F.col("esc").alias("escalate"))), "decision_sha256")
    projection = rows_digest(d, "ordinal", F.to_json(F.struct("key", "tp", "fp", "fn")), "projection_sha256")
    return out.crossJoin(decision).crossJoin(projection)  # three tables of one row


def reproduction_failures(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row ``failures``: the names of the fields that differ by more than they may."""
    b, c = (t.select(F.struct("*").alias(n)) for t, n in ((baseline, "b"), (candidate, "c")))
    j = b.crossJoin(c)  # two tables of one row
    gap = lambda f: F.abs(F.col(f"c.{f}") - F.col(f"b.{f}"))
    tests: list[tuple[str, Column]] = [(f, ~F.col(f"c.{f}").eqNullSafe(F.col(f"b.{f}"))) for f in ("decision_sha256", "projection_sha256", "escalated_calls")]
    tests += [(f, gap(f) > 0.002) for f in ("f1", "recall", "escalation_rate")]
    tests += [(f, gap(f) > 0.005 * F.col(f"b.{f}") + 1e-12) for f in ("escalated_input_tokens", "escalated_output_tokens")]
    return j.select(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in tests])).alias("failures"))


def word_counts(df: DataFrame, key: str, text: str, output: Column | None = None) -> DataFrame:
    """``key, input_tokens, output_tokens`` by white space, where no tokenizer is at hand; null texts have none."""
    words = lambda c: F.coalesce(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")
    out = words(output) if output is not None else F.lit(0).cast("long")
    return df.select(F.col(key).alias("key"), words(F.col(text)).alias("input_tokens"), out.alias("output_tokens"))


def token_counts(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[str], Sequence[int]]], output: str | None = None) -> DataFrame:
    """``key, input_tokens, output_tokens`` by a tokenizer that ``load`` gives once a task; null texts have none."""
    from collections.abc import Iterator

    import pyarrow as pa

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            n = [pa.array([len(encode(t)) if t else 0 for t in b.column(i).to_pylist()], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *n], ["key", "input_tokens", "output_tokens"])

    out = F.col(output) if output is not None else F.lit(None).cast("string")
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("i"), out.alias("o")).mapInArrow(run, f"key {kind}, input_tokens long, output_tokens long")


def run_manifest(config: Mapping[str, str], paths: Mapping[str, str], facts: Mapping[str, object]) -> dict:
    """What a run was: its configuration, the digests of its files, the environment, the facts of its log."""
    return {"config": dict(config), "hashes": {k: path_digest(p) for k, p in paths.items()}, "environment": environment(), "facts": dict(facts)}


def identity_failures(baseline: Mapping, manifest: Mapping, paths: Mapping[str, str]) -> list[str]:
    """Names of what is not the same: files against the manifest's digests, the manifest's digests and configuration against the baseline's.

    ``paths``: the files at hand (``test``, ``outcomes``). What the baseline does not name is not compared.
    """
    actual = {k: path_digest(p) for k, p in paths.items()}
    told, known = manifest.get("hashes", {}), baseline.get("hashes", {})
    bad = [f"hashes.{k}" for k, v in actual.items() if told.get(k) != v]
    if known.get("pairs") is not None and known["pairs"] != actual.get("test"):
        bad.append("baseline.hashes.pairs")
    bad += [f"baseline.hashes.{k}" for k in ("adapter", "vocab") if known.get(k) is not None and told.get(k) != known[k]]
    bad += [f"baseline.{k}" for k in ("code_commit", "model_revision") if baseline.get(k) is not None and manifest.get("config", {}).get(k) != baseline[k]]
    return sorted(bad)


def compare_runs(baseline: Mapping, manifest: Mapping, paths: Mapping[str, str], metrics: DataFrame, failures: Sequence[str] = ()) -> dict:
    """``reproduction_failures`` and ``verdict`` of a run: failures of identity come to those of the numbers, and any of them decides."""
    bad = sorted({*failures, *identity_failures(baseline, manifest, paths)})
    return {"reproduction_failures": bad, "verdict": signal_verdict(metrics, bad).first().verdict}


def budget_metrics(rows: DataFrame, signals: Sequence[str], budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """Metrics of each signal when the floor(budget * n) rows of least (signal, key) are escalated."""
    out = None
    for s in signals:
        c = cascade.curve(rows, s, budgets).withColumnRenamed("fraction", "budget").withColumn("signal", F.lit(s))
        out = c if out is None else out.unionByName(c)
    return out


def signal_verdict(metrics: DataFrame, failures: Sequence[str] = (), base: str = "confidence") -> DataFrame:
    """One row ``verdict``: whether some signal is nowhere much worse than the base and somewhere clearly better."""
    b = metrics.filter(F.col("signal") == base).select("budget", *[F.col(c).alias(f"b_{c}") for c in ("recall", "f1", "exact")])
    j = metrics.filter(F.col("signal") != base).join(b, "budget")
    d = {c: F.col(c) - F.col(f"b_{c}") for c in ("recall", "f1", "exact")}
    fine = (d["recall"] >= -0.002) & (d["f1"] >= -0.002) & (d["exact"] >= -0.005)
    better = (d["recall"] >= 0.005) | (d["f1"] >= 0.005)
    each = j.groupBy("signal").agg((F.bool_and(fine) & F.bool_or(better)).alias("ready"))
    word = F.when(F.lit(bool(failures)), "REPRODUCIBILITY_FAIL").when(F.coalesce(F.bool_or("ready"), F.lit(False)), "ECONOMICS_READY").otherwise("SIGNAL_NO_GO")
    return each.agg(word.alias("verdict"))


def comparison(rows: DataFrame, signals: Sequence[str], dims: DataFrame, budgets: Sequence[float] = BUDGETS, tables: Sequence[str] = ("auroc", "budgets", "frontier", "buckets")) -> dict[str, DataFrame]:
    """AUROC, budgets, exact frontier and buckets at 20 % of each signal, as tables; only the asked ``tables`` are made."""

    def of(f):
        parts = [f(s).withColumn("signal", F.lit(s)) for s in signals]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    make = {
        "auroc": lambda: of(lambda s: cascade.auroc(rows, s)),
        "budgets": lambda: budget_metrics(rows, signals, budgets),
        "frontier": lambda: of(lambda s: cascade.exact_frontier(rows, s)),
        "buckets": lambda: of(lambda s: cascade.bucket_report(rows, dims, s, 0.2)),
    }
    return {t: make[t]() for t in tables}


def manifest_failures(manifest: DataFrame, exact: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """``path`` of each rule a manifest (one row, column ``json``) breaks: values that differ, values missing or empty."""
    spark = manifest.sparkSession
    rules = spark.createDataFrame([(p, v) for p, v in exact.items()] + [(p, None) for p in required], "path string, expected string")
    value = F.call_function("get_json_object", F.col("json"), F.concat(F.lit("$."), F.col("path")))
    j = manifest.select("json").crossJoin(F.broadcast(rules)).withColumn("found", value)  # one row, a list of rules
    return j.filter(F.when(F.col("expected").isNull(), F.coalesce("found", F.lit("")) == "").otherwise(~F.col("found").eqNullSafe(F.col("expected")))).select("path")


def run_facts(log: DataFrame) -> DataFrame:
    """Typed facts of an evaluator's log (rows ``value``): pairs, targets, prompt tokens. One row; error if the log lacks them."""
    sizes = r"cascade eval: (\d+) \w+ pairs, (\d+) targets"
    prompt = r"prompt tokens: mean=([\d.]+) max=(\d+) truncated=(\d+)/(\d+) \(mark_filer=(True|False)\)"
    get = lambda p, k: F.max(F.nullif(F.regexp_extract("value", p, k), F.lit("")))
    row = log.agg(get(sizes, 1).alias("p"), get(sizes, 2).alias("t"), *[get(prompt, k).alias(f"q{k}") for k in range(1, 6)])
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("the log lacks pair or prompt statistics")).cast("string"))
    return row.select(
        need("p").cast("long").alias("n_pairs"), need("t").cast("long").alias("n_targets"), F.bround(need("q1").cast("double")).cast("long").alias("mean_tokens"),
        need("q2").cast("long").alias("max_tokens"), need("q3").cast("long").alias("truncated"), need("q4").cast("long").alias("total"), (need("q5") == "True").alias("mark_filer"),
    )


def environment(packages: Sequence[str] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict[str, str | None]:
    """Versions of what runs here; None for a package that is absent."""
    def version(p: str) -> str | None:
        try:
            return metadata.version(p)
        except metadata.PackageNotFoundError:
            return None

    return {"python": sys.version.split()[0], "platform": platform.platform(), "cpus": str(os.cpu_count()), **{p: version(p) for p in packages}}


def report_markdown(spark: SparkSession, tables: Mapping[str, DataFrame]) -> str:
    """AUROC and budget tables of a comparison (a few rows each) as Markdown."""
    out = []
    for name in ("auroc", "budgets"):
        t = tables[name]
        cols = t.columns
        rows = t.orderBy(*[c for c in ("signal", "budget") if c in cols]).collect()
        out += [f"## {name}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
        out += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else re.sub(r"\|", "/", str(v)) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
