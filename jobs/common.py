"""What the jobs share: their command line, config files and logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"tallyspark.jobs.{name}")


def config(spark: SparkSession, path: str) -> dict:
    """A JSON config, read through Spark: it may lie where the tables do."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def checked(given: dict, defaults: dict) -> dict:
    """The config over its defaults; a key that no default has is an error, and so is one without a value."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = defaults | given
    missing = sorted(k for k, v in out.items() if v is ...)
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out


def command(name: str, about: str, paths: dict[str, str], run: Callable, argv: list[str] | None = None) -> None:
    """Reads arguments, makes the session, runs the job with them and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for option, meaning in paths.items():
        parser.add_argument(f"--{option}", required=True, help=meaning)
    parser.add_argument("--config", required=True, help="a JSON file of settings")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[args[option.replace("-", "_")] for option in paths], config(spark, args["config"]))
    finally:
        spark.stop()
