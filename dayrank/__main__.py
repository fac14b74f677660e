"""``python -m dayrank prepare|features|update|train|score|rank|evaluate``, or ``spark-submit run.py`` with the same."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from dayrank.config import FeatureConfig
from dayrank.plans import jobs
from dayrank.sources.behaviour import CSV, PARQUET

JOBS = {
    "prepare": (jobs.prepare_job, ("log", "items", "out")),
    "features": (jobs.features_job, ("prepared", "train_out", "score_out")),
    "train": (jobs.train_job, ("train", "model")),
    "score": (jobs.score_job, ("model", "score", "out")),
    "update": (jobs.update_job, ("prepared", "store")),
    "rank": (jobs.rank_job, ("train", "score", "out")),
    "evaluate": (jobs.evaluate_job, ("prepared", "submission", "out")),
}


def main(argv: list[str] | None = None) -> None:
    defaults = FeatureConfig()
    parser = argparse.ArgumentParser(prog="dayrank", description=__doc__)
    parser.add_argument("--last-label-day", type=date.fromisoformat, default=defaults.last_label_day)
    parser.add_argument(
        "--gap-day", type=date.fromisoformat, action="append",
        help="may be repeated; default " + ", ".join(map(str, defaults.gap_days)),
    )
    parser.add_argument("--rounds", type=int, default=defaults.boosting_rounds)
    parser.add_argument("--top-k", type=int, default=defaults.top_k)
    parser.add_argument("--seed", type=int, default=defaults.seed)
    parser.add_argument("--negatives", type=int, default=defaults.negatives_per_positive,
                        help="negatives kept for each positive")
    parser.add_argument("--label-days", type=int, default=defaults.n_label_days)
    parser.add_argument("--slot", type=int, default=defaults.slot)
    parser.add_argument("--sample-behaviour", type=int, action="append",
                        help="only touches of this behaviour make a sample; may be repeated")
    parser.add_argument("--extras", action="store_true",
                        help="append the extra feature families to the feature tables")
    parser.add_argument("--sampling", choices=("exact", "bernoulli"), default=defaults.sampling,
                        help="how negatives are chosen; bernoulli rows have weights")
    parser.add_argument("--approximate-users", action="store_true",
                        help="count an item's users by sketches")
    parser.add_argument("--log-day", type=date.fromisoformat, action="append",
                        help="of update: a log day that arrived or changed; may be repeated")
    parser.add_argument("--with-prob", action="store_true",
                        help="write the probability beside each ranked pair")
    parser.add_argument(
        "--format", choices=(PARQUET, CSV), default=PARQUET,
        help="of the prepared log and the feature tables",
    )
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, paths) in JOBS.items():
        command = commands.add_parser(name)
        for path in paths:
            command.add_argument(path)
    args = parser.parse_args(argv)
    cfg = FeatureConfig(
        last_label_day=args.last_label_day,
        gap_days=defaults.gap_days if args.gap_day is None else tuple(args.gap_day),
        boosting_rounds=args.rounds,
        top_k=args.top_k,
        seed=args.seed,
        negatives_per_positive=args.negatives,
        n_label_days=args.label_days,
        slot=args.slot,
        extras=args.extras,
        sampling=args.sampling,
        approximate_users=args.approximate_users,
        sample_behaviours=tuple(args.sample_behaviour) if args.sample_behaviour else None,
    )
    spark = SparkSession.builder.appName(f"dayrank-{args.command}").getOrCreate()
    job, paths = JOBS[args.command]
    where = [getattr(args, path) for path in paths]
    if args.command == "update":
        job(spark, *where, args.log_day or [], cfg)
        return
    more = {"with_prob": args.with_prob} if args.command in ("rank", "score") else {}
    job(spark, *where, cfg, args.format, **more)


if __name__ == "__main__":
    main()
