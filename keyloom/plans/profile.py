"""The digest's phases, timed on two generated relations: a profile of samples and its row for a CSV."""

from __future__ import annotations

import csv
import os
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.digest import join_digest, nested_loop_digest, shown
from keyloom.operators.partition import histogram
from keyloom.operators.stats import sample_stats
from keyloom.sources.generator import RelationSpec, generate

#: Runs of every phase and how many of the first don't count, as code is compiled in them.
RUNS, WARM = 12, 3
PHASES = ("hist_r", "hist_s", "join", "total")
#: Up to this many records a side the report holds the nested loop's digest too.
VERIFIED = 500


def relations(spark: SparkSession, spec: RelationSpec, ns: int) -> tuple[DataFrame, DataFrame]:
    """R by spec and S of ns records, made before anything is timed."""
    pair = tuple(generate(spark, s).persist() for s in (spec, replace(spec.other(), n=ns)))
    for side in pair:
        side.count()
    return pair


def _whole(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def samples(r: DataFrame, s: DataFrame, p: int, strategy: str, runs: int = RUNS, warm: int = WARM) -> list[tuple[int, str, float]]:
    """(run, phase, milliseconds) of the runs that count; total is the phases' sum."""
    phases: dict[str, Callable[[], DataFrame]] = {"hist_r": lambda: histogram(r, "key", p), "hist_s": lambda: histogram(s, "key", p), "join": lambda: join_digest(r, s, "key", "key", strategy, p)}
    out = []
    for run in range(runs):
        took = {}
        for name, df in phases.items():
            began = time.perf_counter()
            _whole(df())
            took[name] = 1000 * (time.perf_counter() - began)
        took["total"] = sum(took.values())
        if run >= warm:
            out += [(run, name, ms) for name, ms in took.items()]
    return out


def profile(spark: SparkSession, kept: list[tuple[int, str, float]]) -> DataFrame:
    """(phase, mean, median, std) in milliseconds."""
    return spark.createDataFrame(kept, "run int, phase string, ms double").groupBy("phase").agg(*sample_stats(F.col("ms")))


def report(r: DataFrame, s: DataFrame, spec: RelationSpec, ns: int, strategy: str) -> dict[str, dict[str, str]]:
    """The digest's three values as unsigned decimals, and those of the nested loop where both sides are small."""
    out = {strategy: shown(join_digest(r, s, "key", "key", strategy, spec.p)).first().asDict()}
    if max(spec.n, ns) <= VERIFIED:
        out["nested loop"] = shown(nested_loop_digest(r, s, "key", "key", VERIFIED)).first().asDict()
    return {name: {k: str(v) for k, v in digest.items()} for name, digest in out.items()}


def append_csv(path: str, spec: RelationSpec, ns: int, strategy: str, stats: dict[str, tuple[float, float]]) -> None:
    """Append a row of parameters, medians and standard deviations; a new file gets a header."""
    params = {"strategy": strategy, "nr": spec.n, "ns": ns, "max_key": spec.max_key, "p": spec.p, "sigma": spec.sigma}
    row = params | {k: f"{v:.3f}" for name in PHASES for k, v in ((name, stats[name][0]), (f"{name}_std", stats[name][1]))}
    fresh = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="") as f:
        out = csv.DictWriter(f, list(row))
        if fresh:
            out.writeheader()
        out.writerow(row)
