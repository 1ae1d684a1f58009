"""Run metadata, self-digested plans, stage status chained by digests, sentinels in scoring batches."""

from __future__ import annotations

import hashlib
import json
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.gates import GateError, require_empty
from cohortlens.sources.sinks import freeze_document, write_document


def digest(value) -> str:
    """SHA-256 of JSON with sorted keys; NaN is refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def run_metadata(spark: SparkSession, config: dict) -> dict:
    """What a run depends on: the configuration's digest, versions, and the settings that shape plans."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.ansi.enabled")
    return {"config_sha256": digest(config), "spark": spark.version, "python": platform.python_version(), "settings": {n: spark.conf.get(n) for n in names}}


def freeze_plan(plan: dict, path: str) -> dict:
    """Write a plan once, with an id that is its digest; a second time it must be the same."""
    frozen = plan | {"plan_id": digest(plan)}
    freeze_document(frozen, path)
    return frozen


def load_plan(path: str) -> dict:
    """A frozen plan; a changed one raises."""
    plan = json.loads(Path(path).read_text(encoding="utf-8"))
    if plan.get("plan_id") != digest({k: v for k, v in plan.items() if k != "plan_id"}):
        raise GateError(f"{path} was changed after it was frozen")
    return plan


def write_status(path: str, stage: str, tables: dict[str, str], ready: bool = True, upstream: str | None = None) -> dict:
    """A stage's status file: digests of its tables and of the status that it was built on."""
    before = None if upstream is None else digest(read_status(upstream))
    status = {"stage": stage, "ready": ready, "tables": tables, "upstream_sha256": before}
    write_document(status, path)
    return status


def read_status(path: str, upstream: str | None = None) -> dict:
    """A status that is ready and whose upstream hasn't changed since; anything else raises."""
    status = json.loads(Path(path).read_text(encoding="utf-8"))
    if not status["ready"]:
        raise GateError(f"stage {status['stage']} isn't ready")
    if upstream is not None and status["upstream_sha256"] != digest(read_status(upstream)):
        raise GateError(f"stage {status['stage']} was built on another upstream result")
    return status


def with_sentinels(rows: DataFrame, sentinels: DataFrame) -> DataFrame:
    """Add known cases to a scoring batch, marked by `is_sentinel`."""
    return rows.withColumn("is_sentinel", F.lit(False)).unionByName(sentinels.withColumn("is_sentinel", F.lit(True)), allowMissingColumns=True)


def without_sentinels(scored: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Check the known cases' scores and take them out again; a missing or wrong one raises."""
    found = scored.where("is_sentinel").select(key, F.col(value).alias("__got"))
    wrong = expected.select(key, F.col(value).alias("__want")).join(found, key, "left").where(~F.col("__got").eqNullSafe(F.col("__want")))
    require_empty(wrong, "sentinel cases scored differently")
    return scored.where(~F.col("is_sentinel")).drop("is_sentinel")


def require_reproduced(pairs: DataFrame, score: str, least: float = 0.99) -> None:
    """The smallest similarity of repeated encodings reaches `least`."""
    require_empty(pairs.where(F.col(score).isNull() | (F.col(score) < least)), "encodings aren't reproducible")
