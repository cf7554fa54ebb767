"""Command line for the jobs: python -m lendwell <job> ...

Run it through spark-submit on a cluster; without a master it starts a local session.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark import SparkConf
from pyspark.sql import SparkSession

from lendwell.operators import quality
from lendwell.plans import jobs
from lendwell.session import local_session
from lendwell.sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lendwell")
    commands = top.add_subparsers(dest="job", required=True)
    etl = commands.add_parser("etl", help="rebuild the feature table")
    check = commands.add_parser("check", help="run the quality suite and stop on failure")
    for command in (etl, check):
        command.add_argument("--staging", required=True)
    etl.add_argument("--features", required=True)
    check.add_argument("--state", help="keep counts of this delivery here, and check all deliveries")
    check.add_argument("--at", type=dt.datetime.fromisoformat, default=None)
    train = commands.add_parser("train", help="fit, compare and save the models")
    train.add_argument("--features", required=True)
    train.add_argument("--models", required=True)
    score = commands.add_parser("score", help="score customers without a score today")
    for name in ("--features", "--models", "--scores"):
        score.add_argument(name, required=True)
    daily = commands.add_parser("daily", help="all jobs in order")
    daily.add_argument("--staging", required=True)
    daily.add_argument("--root", required=True)
    for command in (score, daily):
        command.add_argument("--at", type=dt.datetime.fromisoformat, default=None)
        command.add_argument("--version", default=jobs.scoring.MODEL_VERSION)
    deploy = commands.add_parser("deploy", help="check a saved model and record it")
    for name in ("--features", "--models", "--metadata", "--version"):
        deploy.add_argument(name, required=True)
    deploy.add_argument("--model-id", type=int, required=True)
    return top


def run(args: argparse.Namespace, spark: SparkSession):
    now = dt.datetime.now()
    if args.job == "etl":
        return jobs.build_features(spark, args.staging, args.features)
    if args.job == "check" and args.state:
        return jobs.check_delivery(spark, args.staging, args.state, (args.at or now).date())
    if args.job == "check":
        data = tables.read_staging(spark, args.staging)
        names = ("customers", "credit_history", "transactions", "loan_applications")
        return quality.gate(quality.suite(*[data[name] for name in names]))
    if args.job == "train":
        return jobs.train(spark, args.features, args.models)
    if args.job == "score":
        return jobs.score(
            spark, args.features, f"{args.models}/model", args.scores, args.at or now, args.version
        )
    if args.job == "deploy":
        sample = tables.read_features(spark, args.features).limit(1)
        return jobs.deploy(spark, args.models, args.metadata, sample, args.model_id, args.version, now)
    return jobs.daily_run(spark, args.staging, args.root, args.at or now, args.version)


def main() -> None:
    args = parser().parse_args()
    submitted = SparkConf().contains("spark.master")
    spark = SparkSession.builder.getOrCreate() if submitted else local_session()
    print(run(args, spark))


if __name__ == "__main__":
    main()
