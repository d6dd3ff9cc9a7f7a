"""The command line that the jobs share: a JSON file of settings, each of which an option of the same name replaces."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession


def main(job: Callable[..., Mapping[str, Any]], defaults: Mapping[str, Any], description: str) -> None:
    """Reads the settings, starts a session, runs ``job`` with them and stops the session."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="JSON file of settings")
    for name, value in defaults.items():
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, type=type(value) if value is not None else str)
    given = vars(parser.parse_args())
    settings = dict(defaults)
    if path := given.pop("config"):
        with open(path) as f:
            told = json.load(f)
        if unknown := told.keys() - defaults.keys():
            parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
        settings |= told
    settings |= {k: v for k, v in given.items() if v is not None}
    if missing := [k for k, v in settings.items() if v is None]:
        parser.error(f"missing settings: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        logging.getLogger("jobs").info("done: %s", json.dumps(job(spark, **settings)))
    finally:
        spark.stop()
