"""Writers: tables with a union of columns, and files written once with a checksum."""

from __future__ import annotations

import hashlib
import json
import tempfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of spark.checkpoint.dir, or, within one machine, one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="glyphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def write_csv(frames: list[DataFrame], path: str) -> None:
    """One CSV table with the sorted union of the frames' columns."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole.select(*sorted(whole.columns)).write.mode("errorifexists").option("header", True).csv(path)


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(path: str, value, replace: bool = False) -> str:
    """Write a small value whole or not at all; returns its fingerprint."""
    at = Path(path)
    if at.exists() and not replace:
        raise FileExistsError(path)
    part = at.with_suffix(at.suffix + ".part")
    part.write_text(canonical_json(value))
    part.replace(at)
    return fingerprint(value)


def read_json(path: str, expected: str | None = None):
    value = json.loads(Path(path).read_text())
    if expected is not None and fingerprint(value) != expected:
        raise ValueError(f"{path} has changed")
    return value


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet by keys, each key's rows from one task, sorted, so that readers prune files and row groups."""
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def boundary_export(candidates: DataFrame, model: DataFrame, path: str) -> None:
    candidates.join(model, "stem", "left").select("stem", *[c for c in candidates.columns if c != "stem"], *[F.coalesce(c, F.lit(0)).alias(c) for c in model.columns if c != "stem"]).write.mode("overwrite").json(path)
