"""python -m kindred --stage ...: one stage of a linkage, or all."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kindred.config import DEFAULT
from kindred.operators import blocking
from kindred.operators.model import KINDS
from kindred.plans import runs
from kindred.sources import tables

STAGES = ("preprocess", "candidates", "train", "evaluate", "predict", "validate", "all")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kindred", description=__doc__)
    p.add_argument("--stage", choices=STAGES, default="all")
    p.add_argument("--train-dir", help="folder of train_source1..3.tsv and train_ground_truth.tsv")
    p.add_argument("--test-dir", help="folder of test_source1..3.tsv")
    p.add_argument("--out", required=True, help="folder for all that is made")
    p.add_argument("--matching", help="matches to check; default: those in --out")
    p.add_argument("--candidate", help="candidates to check; default: those in --out")
    p.add_argument("--sample", type=int, default=DEFAULT.sample)
    p.add_argument("--trees", type=int, default=DEFAULT.trees)
    p.add_argument("--pairs", choices=("blocked", "injected"), default="blocked")
    p.add_argument("--model", choices=KINDS, default="boosted")
    p.add_argument("--no-semantic", action="store_true")
    p.add_argument("--single-line", action="store_true", help="no field has a line break, so files can be split")
    p.add_argument("--single-file", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    settings, clean, semantic = runs.smaller(DEFAULT, sample=a.sample, trees=a.trees), f"{a.out}/clean", not a.no_semantic
    every = a.stage == "all"
    if every or a.stage == "preprocess":
        print(runs.preprocess(spark, a.train_dir, a.test_dir, clean, not a.single_line))
    if a.stage == "candidates":
        s1 = tables.load_clean(spark, clean, "test_source1")
        targets = blocking.union_targets(*(tables.load_clean(spark, clean, f"test_source{i}") for i in (2, 3)))
        tables.write_lists(tables.id_lists(s1, blocking.candidates(s1, targets, settings), "candidate_entity_ids"), f"{a.out}/candidate_pairs", a.single_file)
    truth = f"{a.train_dir}/train_ground_truth.tsv"
    if every or a.stage == "train":
        print(runs.train(spark, clean, truth, a.out, settings, a.pairs, semantic, kind=a.model))
    if a.stage == "evaluate":
        print(runs.evaluate(spark, clean, truth, a.out, settings, a.pairs, semantic))
    if every or a.stage == "predict":
        runs.predict(spark, clean, f"{a.out}/model", a.out, tables.logged_threshold(spark, f"{a.out}/log", DEFAULT.default_threshold), settings, semantic, a.single_file)
    if every or a.stage == "validate":
        found = runs.validate(spark, a.matching or f"{a.out}/matching_results", a.candidate or f"{a.out}/candidate_pairs", f"{a.test_dir}/test_source1.tsv")
        print(found)
        return int(any(found.values()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
