"""Runs as tables: creation without repeats, states, cancelling, and recovery."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import RunRequest

RUNS = "run_id string, status string, created_at string, started_at string, updated_at string, params string, progress string, metrics string, error string, idempotency_key string, payload_hash string, cancel_requested int"
KEYS = "idem_key string, payload_hash string, run_id string, created_at string"
ACTIVE = ("queued", "running")
STAGES = {"searching": 5, "scraping": 20, "saving": 95, "done": 100}


def payload_hash(request: RunRequest) -> str:
    return hashlib.sha256(json.dumps(asdict(request), sort_keys=True).encode()).hexdigest()


def create(runs: DataFrame, keys: DataFrame, request: RunRequest, now: str, idempotency_key: str | None = None) -> tuple[str, bool, DataFrame, DataFrame]:
    """The run's id, whether it is new, and both tables. An active run with the same payload is returned first, then one of the same key and payload."""
    spark, digest = runs.sparkSession, payload_hash(request)
    active = runs.filter((F.col("payload_hash") == digest) & F.col("status").isin(*ACTIVE)).orderBy(F.desc("created_at")).select("run_id").first()
    if active:
        return active[0], False, runs, keys
    if idempotency_key:
        known = keys.filter((F.col("idem_key") == idempotency_key) & (F.col("payload_hash") == digest)).select("run_id").first()
        if known:
            return known[0], False, runs, keys
    run_id = uuid.uuid4().hex
    row = (run_id, "queued", now, None, now, json.dumps(asdict(request), sort_keys=True), json.dumps({"stage": "queued", "percent": 0}), "{}", None, idempotency_key, digest, 0)
    runs = runs.unionByName(spark.createDataFrame([row], RUNS))
    if idempotency_key:
        fresh = spark.createDataFrame([(idempotency_key, digest, run_id, now)], KEYS)
        keys = keys.unionByName(fresh.join(keys, ["idem_key", "payload_hash"], "left_anti").select(keys.columns))
    return run_id, True, runs, keys


def update(runs: DataFrame, run_id: str, now: str, **values) -> DataFrame:
    """A run's row with some columns set anew; values that are None change nothing."""
    mine = F.col("run_id") == run_id
    sets = {k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in {**values, "updated_at": now}.items() if v is not None}
    return runs.withColumns(sets)


def cancel(runs: DataFrame, run_id: str, now: str) -> DataFrame:
    """A queued run is cancelled at once; a running one is asked to stop."""
    mine = F.col("run_id") == run_id
    asked = runs.withColumn("cancel_requested", F.when(mine & F.col("status").isin(*ACTIVE), 1).otherwise(F.col("cancel_requested")))
    stop = mine & (F.col("status") == "queued")
    return asked.withColumns({"updated_at": F.when(mine & F.col("status").isin(*ACTIVE), now).otherwise(F.col("updated_at")), "status": F.when(stop, "cancelled").otherwise(F.col("status"))})


def recover(runs: DataFrame, now: str) -> DataFrame:
    """After a crash: what was queued or running has failed."""
    lost = F.col("status").isin(*ACTIVE)
    return runs.withColumns({"error": F.when(lost, F.lit('{"message": "service restarted"}')).otherwise(F.col("error")), "updated_at": F.when(lost, now).otherwise(F.col("updated_at")), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def scraping_percent(done: int, total: int) -> int:
    return 20 + (70 * done) // total if total else 90
