"""What both jobs share: config files, the log, and the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from corpusloom import importable

LOG = logging.getLogger("jobs")


def config(name: str, spark: SparkSession | None = None, path: str | None = None) -> dict:
    """The job's config: the file beside it, or one at ``path``, read by Spark (it may be remote)."""
    if path is None:
        return json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main(name: str, arguments: list[str], work: Callable[..., object]) -> None:
    """Parses ``arguments`` (paths) and ``--config``, starts a session, runs ``work(spark, *paths, config)`` and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for a in arguments:
        parser.add_argument(a)
    parser.add_argument("--config", help=f"a JSON file in place of jobs/{name}.json")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        importable(spark)
        work(spark, *(getattr(given, a) for a in arguments), config(name, spark, given.config))
    finally:
        spark.stop()
