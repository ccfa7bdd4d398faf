"""A session with the settings that the plans expect."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
#: What a run that nobody submitted gets besides.
LOCAL = {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8"}


def submitted() -> set[str]:
    """Settings that spark-submit or a running session has given; they are left as they are."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return {k for k, _ in running.sparkContext.getConf().getAll()} | {"spark.master"}
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()
    SparkContext._ensure_initialized()
    return {k for k, _ in SparkConf().getAll()}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A local session by default; where a job was submitted its settings hold, its master too, and only unset ones are added. more: settings that hold in any case."""
    given, builder = submitted(), SparkSession.builder
    if master or "spark.master" not in given:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        given -= {"spark.master"}
    here = SETTINGS if "spark.master" in given else SETTINGS | LOCAL
    for k, v in ({k: v for k, v in here.items() if k not in given} | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
