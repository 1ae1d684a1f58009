"""The life of an experiment: a frozen plan, amendments, one worker at a time, runs that go on where they stopped.

Plans and amendments are small JSON documents that carry their own digests. Records are rows of Parquet tables; what is done
is what a table holds, so a run that is started again works on the rest only.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import draw
from cohortlens.operators.audits import generation_id
from cohortlens.operators.gates import GateError, require_empty, set_differences
from cohortlens.operators.provenance import digest, freeze_plan, load_plan
from cohortlens.sources import commits
from cohortlens.sources.readers import read_document
from cohortlens.sources.sinks import freeze_document


def project_dir(start: str, name: str, variable: str) -> str:
    """The folder of a configuration: from the environment, else the nearest folder at or above `start` that holds `name`."""
    candidates = [os.environ[variable]] if os.environ.get(variable) else []
    here = Path(start).resolve()
    for folder in [*map(Path, candidates), here, *here.parents]:
        if (folder / name).exists():
            return str(folder)
    raise FileNotFoundError(f"{name} isn't at or above {start}; set {variable}")


def load_config(folder: str, name: str, overrides: dict[str, str]) -> dict:
    """A JSON configuration; `overrides` maps environment variables to the fields that they replace."""
    config = read_document(str(Path(folder) / name))
    return config | {f: os.environ[v] for v, f in overrides.items() if os.environ.get(v)}


def source_hashes(files: list[str]) -> dict[str, str]:
    """SHA-256 of source files by their names."""
    import hashlib

    return {Path(f).name: hashlib.sha256(Path(f).read_bytes()).hexdigest() for f in files}


def require_identity(name: str, actual: str) -> None:
    """The model that was loaded is the one that was asked for: its name contains the expected part, case aside."""
    if name.strip().lower() not in actual.lower():
        raise GateError(f"{actual} isn't {name}")


def require_parameters(plan: dict, allowed: dict[str, set], required: dict[str, str]) -> None:
    """Every list of the plan holds different allowed values, at least one, and the required ones; a small trial says so in its
    name, and the name is plain."""
    if not re.fullmatch("[A-Za-z0-9_-]+", plan.get("run_name", "")):
        raise GateError("the run's name may hold letters, digits, - and _ only")
    for field, values in allowed.items():
        chosen = plan[field]
        if not chosen or len(set(chosen)) != len(chosen) or not set(chosen) <= values:
            raise GateError(f"{field} must be different values out of {sorted(values)}")
    for field, value in required.items():
        if value not in plan[field]:
            raise GateError(f"{field} must hold {value}")
    if plan.get("smoke_n") is not None and (plan["smoke_n"] < 1 or "smoke" not in plan["run_name"].lower()):
        raise GateError("a trial needs a positive size and 'smoke' in its name")


def freeze(plan: dict, path: str, queries: DataFrame, neighbors: DataFrame, sizes: dict[str, int], sources: list[str] = ()) -> dict:
    """Freeze a plan over prepared inputs: every query has neighbours and none else has, bundles have their sizes, and the plan
    holds digests of its inputs and sources. A plan that is frozen already must be the same."""
    require_empty(set_differences(queries, neighbors, ["bundle", "query_id"]), "queries and neighbours differ")
    counts = {r["bundle"]: r["n"] for r in queries.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts != sizes:
        raise GateError(f"bundles hold {counts} queries, not {sizes}")
    whole = plan | {"query_counts": counts, "inputs": {"queries": content_digest(queries), "neighbors": content_digest(neighbors)}, "code_sha256": source_hashes(list(sources))}
    return freeze_plan(whole, path)


def content_digest(df: DataFrame) -> str:
    """A digest of a table that doesn't depend on the order of its rows."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    r = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    return digest([r["n"], r["x"], r["s"]])


def load(path: str, queries: DataFrame, neighbors: DataFrame, sources: list[str] = (), amendment: str | None = None) -> dict:
    """A frozen plan whose inputs and sources are as they were; changed sources need an amendment that names both states."""
    plan = load_plan(path)
    if plan["inputs"] != {"queries": content_digest(queries), "neighbors": content_digest(neighbors)}:
        raise GateError("the frozen inputs changed")
    current = source_hashes(list(sources))
    if current != plan["code_sha256"]:
        if amendment is None or not Path(amendment).exists():
            raise GateError("the frozen sources changed")
        note = read_document(amendment)
        own = {k: v for k, v in note.items() if k != "amendment_sha256"}
        if note["amendment_sha256"] != digest(own) or (note["plan_id"], note["original_code_sha256"], note["amended_code_sha256"]) != (plan["plan_id"], plan["code_sha256"], current):
            raise GateError("the amendment is for another plan or other sources")
    return plan


def amend(path: str, target: str, sources: list[str], records: DataFrame, reason: str, reusable) -> dict:
    """Write down, once, that sources changed after freezing: the plan and all records stay as they are. Records that aren't
    `reusable` (a condition) stand in the way. The amendment holds the digest of the records that it keeps."""
    plan, current = load_plan(path), source_hashes(sources)
    if set(current) != set(plan["code_sha256"]):
        raise GateError("other source files than the plan's")
    require_empty(records.where(~F.coalesce(reusable, F.lit(False))), "records that can't be kept")
    note = {"plan_id": plan["plan_id"], "reason": reason, "original_code_sha256": plan["code_sha256"], "amended_code_sha256": current, "retained": content_digest(records)}
    note |= {"amendment_sha256": digest(note)}
    freeze_document(note, target)
    return note


@contextlib.contextmanager
def run_lock(folder: str, name: str) -> Iterator[None]:
    """One process at a time works under a name: the lock is a file that must not be there yet.

    A lock that a dead process left is to be removed by hand. Use a folder that all drivers share.
    """
    path = Path(folder) / f"{name}.lock"
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as error:
        raise GateError(f"{name} is locked by {path.read_text(encoding='utf-8')}") from error
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps({"pid": os.getpid(), "since": time.time()}))
        yield
    finally:
        path.unlink(missing_ok=True)


def work_list(queries: DataFrame, models: list[str], conditions: list[str], arms: list[str], seed: int) -> DataFrame:
    """(generation_record_id, model_key, bundle, query_record_id, condition, arm, pair_seed, turn): all that a plan asks for. The
    arms of a pair share a seed, and which of the two goes first is drawn from it."""
    lists = F.explode(F.array(*[F.struct(F.lit(m).alias("model_key"), F.lit(c).alias("condition"), F.lit(a).alias("arm"), F.lit(k).alias("k")) for m in models for c in conditions for k, a in enumerate(arms)]))
    rows = queries.select("bundle", "query_record_id", lists.alias("x")).select("x.model_key", "bundle", "query_record_id", "x.condition", "x.arm", "x.k")
    pair = draw(F.lit(seed), F.col("model_key"), F.col("bundle"), F.col("query_record_id"), F.col("condition"))
    turn = F.when(pair % 2 == 1, F.col("k")).otherwise(F.lit(len(arms) - 1) - F.col("k"))
    return rows.select(generation_id("model_key", "bundle", "query_record_id", "condition", "arm").alias("generation_record_id"), *[c for c in rows.columns if c != "k"], pair.alias("pair_seed"), turn.alias("turn"))


def run_pending(work: DataFrame, key: str, generate: Callable[[DataFrame], DataFrame], target: str, failures: str, error: str = "error") -> int:
    """Work on the rows whose key the target table lacks; the number of rows that failed.

    `generate` returns a row for each row with an `error` column. Complete rows are appended to the target with the digest of
    their content, failed ones to a table of their own, both in one commit: what is done stays, and the next run takes the
    failed ones again. A run that ends before its commit leaves nothing, one that ends behind it is finished by the next.
    """
    spark = work.sparkSession
    commits.recover(spark, target, [target, failures])
    if any(not x.startswith("_") for x in commits.names(spark, target)):
        work = work.join(spark.read.parquet(target).select(key), key, "left_anti")
    staging = f"{target.rstrip('/')}-staging-{uuid.uuid4().hex}"
    try:
        generate(work).write.parquet(staging)
        rows = spark.read.parquet(staging)
        done, bad = rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())
        count = bad.count()
        commits.append(target, {target: done.withColumn("payload_sha256", payload_digest(done)), failures: bad})
    finally:
        commits.delete(spark, staging)
    return count


def payload_digest(df: DataFrame):
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != "payload_sha256"))), 256)


def changed_records(records: DataFrame, key: str) -> DataFrame:
    """(key) of saved records whose content isn't that of their digest any more."""
    return records.where(~F.col("payload_sha256").eqNullSafe(payload_digest(records))).select(key)


def every(tasks: dict[str, Callable[[], object]]) -> dict[str, str]:
    """Run all tasks, whatever happens to one; the messages of those that failed, by name."""
    failed = {}
    for name, task in tasks.items():
        try:
            task()
        except Exception as error:  # noqa: BLE001  (the next task doesn't depend on this one)
            failed[name] = f"{type(error).__name__}: {error}"
    return failed


def require_all(failed: dict[str, str]) -> None:
    if failed:
        raise GateError("; ".join(f"{k}: {v}" for k, v in sorted(failed.items())))


def review_status(expected: int, forms: dict[str, int | None]) -> dict:
    """The state of a review by people: pending while a form is missing or not full, which is no error."""
    waiting = sorted(k for k, n in forms.items() if n is None or n < expected)
    return {"ready": not waiting, "status": "pending" if waiting else "complete", "waiting_for": waiting, "expected": expected}
