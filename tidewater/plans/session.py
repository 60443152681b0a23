"""A Spark session with the settings that the engine counts on."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def connect(master: str | None = None, existing: SparkSession | None = None, attempts: int = 10, wait: float = 20.0) -> SparkSession:
    """The session, tried again while the cluster does not answer; settings of an existing one that it lacks are set."""
    for attempt in range(attempts):
        try:
            if existing is None:
                builder = SparkSession.builder
                existing = (builder if master is None else builder.master(master)).getOrCreate()
            for key, value in SETTINGS.items():
                if existing.conf.get(key, None) != value:
                    existing.conf.set(key, value)
            return existing
        except Exception:  # whatever the cluster manager raises
            if attempt + 1 == attempts:
                raise
            existing = None
            time.sleep(wait)
    raise ValueError("at least one attempt is needed")
