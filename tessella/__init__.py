"""Vector quantization and similarity search on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark) -> None:
    """Let Python workers import this package where only the driver has it on its path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
