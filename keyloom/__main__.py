"""python -m keyloom: the join digest of two generated relations, with a profile of its phases."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from keyloom.operators.digest import STRATEGIES
from keyloom.plans import profile
from keyloom.sources.generator import RelationSpec


class _First(argparse.Action):
    """Of a flag that is given several times the first counts."""

    def __call__(self, parser, namespace, values, option_string=None):
        given = namespace.__dict__.setdefault("_given", set())
        if self.dest not in given:
            given.add(self.dest)
            setattr(namespace, self.dest, values)


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m keyloom", description=__doc__, allow_abbrev=False)
    for flag, kind, says in (
        ("-nr", int, "records of R"), ("-ns", int, "records of S"), ("-seed", int, "seed of R"), ("-max-key", int, "keys lie under it"), ("-p", int, "partitions, a power of two"),
        ("-sigma", float, "share of records with skewed keys"), ("-subset-size", int, "hot partitions"), ("-crest-shape", float, "shape of the power law among them"),
    ):
        parser.add_argument(flag, type=kind, required=True, action=_First, help=says)
    parser.add_argument("-strategy", choices=STRATEGIES, default="key", action=_First)
    parser.add_argument("-t", type=int, action=_First, help="threads of a local session; else the master that Spark is configured with")
    parser.add_argument("-runs", type=int, default=profile.RUNS, action=_First, help="runs, the first quarter not counted")
    parser.add_argument("-csv", action=_First, help="file on the driver that a row of the profile is appended to")
    args = parser.parse_args(argv)
    if args.t is not None and args.t < 1 or args.runs < 1 or args.ns < 0:
        parser.error("-t and -runs must be 1 at least, -ns must not be negative")
    try:
        args.spec = RelationSpec(args.nr, args.seed, args.max_key, args.p, args.sigma, args.subset_size, args.crest_shape)
    except ValueError as e:
        parser.error(str(e))
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    spec = args.spec
    r, s = profile.relations(spark, spec, args.ns)
    try:
        print(f"nr {spec.n} ns {args.ns} seed {spec.seed} max_key {spec.max_key} p {spec.p} sigma {spec.sigma} subset_size {spec.subset_size} crest_shape {spec.crest}")
        for name, digest in profile.report(r, s, spec, args.ns, args.strategy).items():
            print(name, *[f"{k} {v}" for k, v in digest.items()])
        kept = profile.samples(r, s, spec.p, args.strategy, args.runs, args.runs // 4)
        rows = {x["phase"]: x for x in profile.profile(spark, kept).collect()}
    finally:
        for side in (r, s):
            side.unpersist()
    for phase in profile.PHASES:
        x = rows[phase]
        print(f"{phase} median {x['median']:.3f} ms mean {x['mean']:.3f} ms std {x['std']:.3f} ms")
    if args.csv:
        profile.append_csv(args.csv, spec, args.ns, args.strategy, {k: (x["median"], x["std"]) for k, x in rows.items()})


def main(argv: list[str]) -> None:
    args = arguments(argv)
    builder = SparkSession.builder.appName("keyloom")
    spark = (builder.master(f"local[{args.t}]") if args.t else builder).getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
