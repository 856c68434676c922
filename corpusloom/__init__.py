"""Document-library analytics on Spark."""

from __future__ import annotations

from pathlib import Path

_HOME = str(Path(__file__).resolve().parent.parent)


def importable(spark) -> None:
    """Let Python workers find this package where it isn't installed: its folder goes on the path of the workers that the session starts."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = ":".join([*paths, _HOME])
