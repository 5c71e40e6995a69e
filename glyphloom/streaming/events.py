"""Event streams: windows with watermarks, first occurrences, a budgeted runner, and a run registry with idempotent batches."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import canonical_json, fingerprint


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The events in a file, or in files of that name below its folder, as a stream, ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rpartition("/")[::2]
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True)
    return files.option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, with state that the watermark bounds."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, folder: str, *keys: str) -> DataFrame:
    """All that an aggregated stream of what is there now gives: what changes is written batch by batch to Parquet files under the folder, and each key's last state is read back. State is kept as long as the watermark says, and nothing goes through the driver."""
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    out = stream.sparkSession.read.schema(schema).parquet(f"{at}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return out.select(*keys, "x.*")


class Registry:
    """Specifications, runs, their states and attempts as Parquet tables under a folder that all machines share.

    A specification is known by the hash of its canonical JSON. A batch of attempts is a folder named by its run and number, written beside and moved into place, so a batch is there whole or not at all and committing it again changes nothing. What reads and then writes holds a lock, a file that only one can create.
    """

    ATTEMPTS = "run_id string, batch long, sequence long, candidate_id string, loss double"

    def __init__(self, spark: SparkSession, folder: str, patience: float = 60.0):
        self.spark, self.folder, self.patience = spark, folder.rstrip("/"), patience

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextlib.contextmanager
    def _locked(self):
        at, fs = self._path("_lock")
        until = time.monotonic() + self.patience
        while not fs.createNewFile(at):
            if time.monotonic() > until:
                raise TimeoutError(f"{at} is held by another")
            time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(at, False)

    def _read(self, name: str, schema: str) -> DataFrame:
        at, fs = self._path(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if fs.exists(at) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    SPECIFICATIONS, RUNS, STATES = "spec_id string, family string, manifest string", "run_id string, spec_id string, reason string", "run_id string, at long, state string, stop_reason string, checkpoint string"

    def specifications(self) -> DataFrame:
        return self._read("specifications", self.SPECIFICATIONS)

    def runs(self) -> DataFrame:
        return self._read("runs", self.RUNS)

    def states(self) -> DataFrame:
        return self._read("states", self.STATES)

    def attempts(self) -> DataFrame:
        return self._read("attempts", self.ATTEMPTS)

    def register(self, family: str, manifest: dict, reason: str = "") -> str:
        """A new run; a specification that has run before needs a reason."""
        spec_id = fingerprint({"family": family, "manifest": manifest})
        with self._locked():
            before = self.runs().where(F.col("spec_id") == spec_id).count()
            if before and not reason:
                raise ValueError("this specification has run; give a reason to run it again")
            if not before:
                self._append("specifications", (spec_id, family, canonical_json(manifest)), self.SPECIFICATIONS)
            run_id = fingerprint([spec_id, before])
            self._append("runs", (run_id, spec_id, reason), self.RUNS)
        return run_id

    def commit(self, run_id: str, batch: int, attempts: DataFrame) -> bool:
        """attempts: sequence, candidate_id, loss; sequences go on without a gap from the last of the run's batch before. False if the batch is there already."""
        at, fs = self._path(f"attempts/run_id={run_id}/batch={batch}")
        with self._locked():
            if fs.exists(at):
                return False
            if self.runs().where(F.col("run_id") == run_id).isEmpty():
                raise ValueError("no such run")
            last = self.attempts().where(F.col("run_id") == run_id).agg(F.max("sequence"), F.max("batch")).first()
            low, high, n = attempts.agg(F.min("sequence"), F.max("sequence"), F.countDistinct("sequence")).first()
            first = 0 if last[0] is None else last[0] + 1
            if n and (low != first or high - low + 1 != n) or batch != (0 if last[1] is None else last[1] + 1):
                raise ValueError(f"batch {batch} does not follow: sequences {low} to {high}, {first} is next")
            beside, _ = self._path(f"_pending/{uuid.uuid4().hex}")
            attempts.select(F.col("sequence").cast("long"), "candidate_id", F.col("loss").cast("double")).write.parquet(beside.toString())
            fs.mkdirs(at.getParent())
            if not fs.rename(beside, at):
                raise OSError(f"{at} can't be written")
        return True

    def record(self, run_id: str, state: str, stop_reason: str = "", checkpoint: dict | None = None) -> None:
        with self._locked():
            n = self.states().where(F.col("run_id") == run_id).count()
            self._append("states", (run_id, n, state, stop_reason, canonical_json(checkpoint or {})), self.STATES)

    def latest(self, run_id: str) -> tuple[str, str, dict] | None:
        """State, stop reason and checkpoint, as last recorded."""
        r = self.states().where(F.col("run_id") == run_id).orderBy(F.desc("at")).first()
        return r and (r["state"], r["stop_reason"], json.loads(r["checkpoint"]))

    def list(self, family: str | None = None) -> DataFrame:
        rows = self.runs().join(self.specifications(), "spec_id")
        return (rows if family is None else rows.where(F.col("family") == family)).select("run_id", "spec_id", "family", "reason").orderBy("run_id")

    def get(self, spec_id: str) -> dict:
        r = self.specifications().where(F.col("spec_id") == spec_id).first()
        value = json.loads(r["manifest"])
        if fingerprint({"family": r["family"], "manifest": value}) != spec_id:
            raise ValueError("the specification has changed")
        return value

    def import_legacy(self, family: str, records: list[dict]) -> list[str]:
        """Runs from records of manifest and losses made elsewhere, a run and a batch each."""
        out = []
        for r in records:
            run_id = self.register(family, r["manifest"], "imported")
            rows = [(i, str(c), float(loss)) for i, (c, loss) in enumerate(r["losses"])]
            self.commit(run_id, 0, self.spark.createDataFrame(rows, "sequence long, candidate_id string, loss double"))
            self.record(run_id, "stopped", "imported")
            out.append(run_id)
        return out


class Strategy(Protocol):
    """What a search proposes and learns; its snapshot holds all it needs to go on, its random state included."""

    def propose(self, n: int) -> list[str]: ...

    def observe(self, losses: list[tuple[str, float]]) -> None: ...

    def snapshot(self) -> dict: ...

    def restore(self, snapshot: dict) -> None: ...


def run_search(registry: Registry, run_id: str, strategy: Strategy, evaluate: Callable[[DataFrame], DataFrame], evaluations: int, batch: int = 64, seconds: float = float("inf"), pause_after: int | None = None) -> str:
    """Propose, evaluate, observe, commit and checkpoint until the strategy has nothing more, or a budget of evaluations or seconds is used; returns why it stopped.

    evaluate: sequence, candidate_id -> with loss, as a plan, so a batch is evaluated on all executors; what reaches the driver is a batch's losses. A run goes on from its last checkpoint: a batch that was committed but not checkpointed is read back, not evaluated again. pause_after: batches after which to leave off, as if ended.
    """
    spark, began, done = registry.spark, time.monotonic(), 0
    last = registry.latest(run_id)
    if last and last[0] == "stopped":
        return last[1]
    number, used = (last[2]["batch"], last[2]["used"]) if last else (0, 0)
    if last:
        strategy.restore(last[2]["strategy"])
    while True:
        if pause_after is not None and done >= pause_after:
            return "paused"
        if used >= evaluations or time.monotonic() - began > seconds:
            reason = "evaluations" if used >= evaluations else "time"
            break
        proposed = strategy.propose(min(batch, evaluations - used))
        if not proposed:
            reason = "exhausted"
            break
        rows = spark.createDataFrame([(used + i, c) for i, c in enumerate(proposed)], "sequence long, candidate_id string")
        at, fs = registry._path(f"attempts/run_id={run_id}/batch={number}")
        if not fs.exists(at):
            registry.commit(run_id, number, evaluate(rows).select("sequence", "candidate_id", "loss"))
        own = registry.attempts().where((F.col("run_id") == run_id) & (F.col("batch") == number)).orderBy("sequence").collect()  # a batch
        strategy.observe([(r["candidate_id"], r["loss"]) for r in own])
        number, used, done = number + 1, used + len(proposed), done + 1
        registry.record(run_id, "running", "", {"batch": number, "used": used, "strategy": strategy.snapshot()})
    registry.record(run_id, "stopped", reason, {"batch": number, "used": used, "strategy": strategy.snapshot()})
    return reason


def retained(attempts: DataFrame, top: int, reservoir: int) -> DataFrame:
    """Of each run: its best candidates by loss and id, each candidate once with its least loss, and a reservoir of others, those with the least hash, whatever order they came in."""
    best = attempts.groupBy("run_id", "candidate_id").agg(F.min("loss").alias("loss"), F.count("*").alias("tries"))
    w = Window.partitionBy("run_id")
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy("loss", "candidate_id")))
    rest = ranked.where(F.col("rank") > top).withColumn("draw", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", "run_id", "candidate_id")), "candidate_id"))).where(F.col("draw") <= reservoir)
    kept = ranked.where(F.col("rank") <= top).select("run_id", "candidate_id", "loss", "tries", F.lit("top").alias("kept"))
    return kept.unionByName(rest.select("run_id", "candidate_id", "loss", "tries", F.lit("reservoir").alias("kept")))
