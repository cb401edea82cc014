"""What the jobs share: configuration files, logs, the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def config_of(path: str, required: set[str]) -> dict:
    """The JSON object in a local file; keys that are missing or unknown are errors."""
    with open(path) as f:
        config = json.load(f)
    if not isinstance(config, dict) or set(config) != required:
        raise ValueError(f"{path} must have just the keys {sorted(required)}")
    return config


def main(name: str, paths: list[str], required: set[str], work: Callable[..., DataFrame]) -> None:
    """Command line of a job: --config and a path for each of paths; starts and stops the session."""
    parser = argparse.ArgumentParser(name)
    for p in ("config", *paths):
        parser.add_argument(f"--{p}", required=True)
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = config_of(args.pop("config"), required)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, **args, config=config)
    finally:
        spark.stop()
