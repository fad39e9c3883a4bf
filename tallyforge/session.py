"""SparkSession with the settings the engine relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "tallyforge", master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def warehouse_root(root: str | None = None) -> str:
    """The warehouse folder or URI: the argument, or the environment's WAREHOUSE_ROOT."""
    found = root or os.environ.get("WAREHOUSE_ROOT")
    if not found:
        raise RuntimeError("no warehouse root: pass one or set WAREHOUSE_ROOT")
    return found


def package_on_workers(spark: SparkSession) -> None:
    """Python workers on this machine import this package from where the driver did (a cluster gets it by --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def counted(seen: Observation, *names: str) -> dict[str, int]:
    """What an observation of counts has seen. A plan that is known to be empty has no observation: then all are 0."""
    if seen._jo.getRow().schema() is None:
        return dict.fromkeys(names, 0)
    got = seen.get
    return {n: got[n] for n in names}
