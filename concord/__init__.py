"""Concord: building and auditing grounded text datasets with PySpark."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it, wherever they are started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
