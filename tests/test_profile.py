from __future__ import annotations

import csv

import pytest

from keyloom import __main__ as cli
from keyloom.plans import profile

FLAGS = "-nr 400 -ns 300 -seed 7 -max-key 50 -p 8 -sigma 0.5 -subset-size 2 -crest-shape 2".split()


def test_flags():
    args = cli.arguments([*FLAGS, "-p", "16", "-strategy", "pid", "-strategy", "key"])
    assert (args.spec.p, args.strategy, args.spec.sigma, args.ns) == (8, "pid", 0.5, 300)
    for wrong in (FLAGS[2:], [*FLAGS[:8], "-p", "12", *FLAGS[10:]], [*FLAGS, "-t", "0"], [*FLAGS, "-strategy", "none"], ["-nr", "x", *FLAGS]):
        with pytest.raises(SystemExit):
            cli.arguments(wrong)


def test_report_and_profile(spark, tmp_path, capsys):
    path = tmp_path / "profile.csv"
    for strategy in ("key", "pid"):
        cli.run(spark, cli.arguments([*FLAGS, "-strategy", strategy, "-runs", "2", "-csv", str(path)]))
    said = capsys.readouterr().out.splitlines()
    digests = {line.split("join_count")[0].strip(): line.split("join_count")[1] for line in said if "join_count" in line}
    assert set(digests) == {"key", "pid", "nested loop"} and len(set(digests.values())) == 1
    assert sum(line.startswith("total median") for line in said) == 2
    rows = list(csv.DictReader(path.open()))
    assert [x["strategy"] for x in rows] == ["key", "pid"] and {x["nr"] for x in rows} == {"400"}
    assert all(float(x[p]) > 0 and float(x[f"{p}_std"]) >= 0 for x in rows for p in profile.PHASES)


def test_samples_of_counted_runs(spark):
    kept = [(i, "join", ms) for i, ms in enumerate([1.0, 2.0, 6.0])]
    x = profile.profile(spark, kept).first()
    assert (x["phase"], x["mean"], x["median"]) == ("join", 3.0, 2.0)
