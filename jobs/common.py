"""What the jobs share: settings from a JSON file, logging, the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def settings(spark: SparkSession, kind: type[T], path: str | None) -> T:
    """The settings of a JSON file, read through Spark as it may be anywhere; without a path the defaults. Unknown names fail."""
    if path is None:
        return kind()
    found = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    unknown = found.keys() - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**{name: tuple(value) if isinstance(value, list) else value for name, value in found.items()})


def main(name: str, kind: type[T], paths: dict[str, str], run: Callable[..., dict[str, int]]) -> None:
    """Parses --<path> for each of paths and --config, makes a session, runs, logs the counts, stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="JSON file with settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        chosen = settings(spark, kind, given.pop("config"))
        counts = run(spark, **given, settings=chosen)
        logging.getLogger(name).info("done: %s", ", ".join(f"{what} {n}" for what, n in counts.items()))
    finally:
        spark.stop()
