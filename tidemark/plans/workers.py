"""Python workers find this package where they share the driver's disk; elsewhere it is installed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def package_on_path(spark: SparkSession) -> None:
    """Add the package's folder to the workers' path, behind what is there."""
    env, own = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if own not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, own])
