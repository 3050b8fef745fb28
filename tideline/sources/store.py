"""The store: immutable raw records, recomputed facts, snapshots."""

from __future__ import annotations

import contextlib
import datetime
import itertools
import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import redact
from ..operators.dedupe import first_write
from . import snapshots


def scratch_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; one is set only where the session names none and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_raw(found: DataFrame, existing: DataFrame) -> DataFrame:
    """found: stream, source_key, payload. Records not yet held: binary streams by payload hash alone, JSON streams by stream and key."""
    hashed = found.withColumn("payload_hash", F.sha2(F.col("payload").cast("binary"), 256))
    binary = F.col("stream").startswith("fit:")
    once = first_write(hashed.where(binary), ["payload_hash"], ["stream", "source_key"]).select(*hashed.columns)
    fresh = once.join(existing.select("payload_hash").distinct(), "payload_hash", "left_anti")
    records = first_write(hashed.where(~binary), ["stream", "source_key"], ["payload_hash"]).select(*hashed.columns)
    return fresh.unionByName(records.join(existing.select("stream", "source_key").distinct(), ["stream", "source_key"], "left_anti"))


def replay(kept: DataFrame, decoded: DataFrame, errors: DataFrame, force: bool = False) -> DataFrame:
    """Facts after a replay: decoded rows, with the kept rows of records that no longer decode. Refused if any fails, unless forced."""
    if not force and not errors.isEmpty():
        raise ValueError("some records do not decode")
    return decoded.unionByName(kept.join(errors.select("raw_id").distinct(), "raw_id", "left_semi"))


def dry_run(decoded: DataFrame) -> DataFrame:
    """What a replay would do, without doing it: records and failures of each stream, and the first error. decoded: stream, raw_id, error (null: it decodes)."""
    bad = F.col("error").isNotNull()
    return decoded.groupBy("stream").agg(
        F.countDistinct("raw_id").alias("records"), F.countDistinct(F.when(bad, F.col("raw_id"))).alias("failures"), F.min(F.when(bad, F.struct("raw_id", "error"))).getField("error").alias("first_error")
    )


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows that come from the given records (raw_id); tables that know no record stay."""
    return {n: delete_by_raw(df, gone) if "raw_id" in df.columns else df for n, df in tables.items()}


def replay_record(tables: dict[str, DataFrame], one: DataFrame, decoded: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables with the rows of some records (raw_id) replaced by what they decode to now."""
    left = delete_cascade(tables, one)
    return {n: df.unionByName(decoded[n], allowMissingColumns=True) if n in decoded else df for n, df in left.items()}


def keep_undecodable(found: DataFrame, decodable: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records (stream, source_key, payload, start_ts, end_ts) of streams without a decoder: (raw rows that keep their bytes, a failure row for each)."""
    mine = found.where(~F.col("stream").isin(*decodable)).withColumn("payload_hash", F.sha2(F.col("payload").cast("binary"), 256))
    failures = mine.select("stream", F.col("payload_hash").alias("raw_id"), "start_ts", "end_ts", F.lit("no decoder for this stream").alias("error"))
    return mine, failures


def linked(records: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the marks (keys and whatever else) that they were seen under."""
    return records.join(seen, keys)


def corrupt(raw: DataFrame) -> DataFrame:
    """Retained records whose bytes no longer have their hash: the round trip that every append is held to."""
    return raw.where(F.sha2(F.col("payload").cast("binary"), 256) != F.col("payload_hash"))


def delete_by_raw(facts: DataFrame, gone: DataFrame) -> DataFrame:
    return facts.join(gone.select("raw_id").distinct(), "raw_id", "left_anti")


def write_snapshot(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


RUNS, WORK = "runs", "work-"


def current(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the latest commit; none in a store without one."""
    from . import ingest

    return ingest.tables_of(spark, target)


@contextlib.contextmanager
def keeper(spark: SparkSession, target: str, run: str):
    """A function that writes a table beside the store's snapshots and reads it back, so that it is made once; all such tables go at the end."""
    name, count = f"{WORK}{run}", itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{target}/{name}/{next(count)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        snapshots.Files(spark, target).delete(name)


def heal(spark: SparkSession, target: str) -> None:
    """After a crash, by the next holder of the store's lease: runs that were begun and not ended are booked as interrupted, their work goes."""
    files = snapshots.Files(spark, target)
    booked = files.names(RUNS)
    begun, ended = ({n.split("-")[0] for n in booked if n.endswith("-running.json") == begins} for begins in (True, False))
    for run in sorted(begun - ended):
        finish_run(spark, target, run, "interrupted", None)
    for name in files.names(""):
        if name.startswith(WORK):
            files.delete(name)
    for name in files.names(snapshots.COMMITS):
        if name.endswith(".new"):
            files.delete(f"{snapshots.COMMITS}/{name}")


RUN_SCHEMA = "run string, at timestamp, transport string, status string, error string"


def begin_run(spark: SparkSession, target: str, transport: str) -> str:
    run = uuid.uuid1().hex
    _book(spark, target, run, transport, "running", None)
    return run


def finish_run(spark: SparkSession, target: str, run: str, status: str, error: str | None) -> None:
    _book(spark, target, run, None, status, error)


def _book(spark: SparkSession, target: str, run: str, transport: str | None, status: str, error: str | None) -> None:
    """An event of a run: a small file, written once."""
    if error is not None:
        error = spark.range(1).select(redact(F.lit(error))).first()[0]
    at = datetime.datetime.now(datetime.UTC).isoformat()
    snapshots.Files(spark, target).create(f"{RUNS}/{run}-{status}.json", json.dumps({"run": run, "at": at, "transport": transport, "status": status, "error": error}))


def runs(spark: SparkSession, target: str) -> DataFrame:
    """run, started_at, finished_at, transport, status, error: one row a run, from an append-only log of its events."""
    log = spark.read.schema(RUN_SCHEMA).json(f"{target}/{RUNS}")
    ended = F.col("status") != "running"
    return log.groupBy("run").agg(
        F.min("at").alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("finished_at"), F.max("transport").alias("transport"),
        F.coalesce(F.max_by(F.when(ended, F.col("status")), F.when(ended, F.col("at"))), F.lit("running")).alias("status"), F.max("error").alias("error"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, size and sha256 of every file below a folder: what a copied backup is held against."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_replace("path", r"^.*?/(?=(?:data|commits|runs)/|[^/]+/[^/]+$)", "").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows and an order-independent checksum of each table: what a backup is verified against."""
    parts = [df.select(F.lit(n).alias("table"), F.xxhash64(*[df[c] for c in df.columns]).alias("h")).groupBy("table").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h") % (1 << 31)).alias("checksum")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batches_by_size(records: DataFrame, limit: int, by: str, order: str, size: str) -> DataFrame:
    """Numbers records into batches of about ``limit`` bytes in their order, from the running total."""
    from pyspark.sql import Window

    before = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("batch", F.floor(F.coalesce(before, F.lit(0)) / limit))


def upgrade(old: DataFrame, schema: str) -> DataFrame:
    """Rows of an older layout under a newer schema: columns that it lacks are null. A newer layout than the schema's is refused."""
    target = old.sparkSession.createDataFrame([], schema)
    if extra := set(old.columns) - set(target.columns):
        raise ValueError(f"the snapshot is newer than this code: {', '.join(sorted(extra))}")
    return target.unionByName(old, allowMissingColumns=True)


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Tables of a snapshot whose manifest differs from the expected one: empty if the copy is good."""
    names = [r[0] for r in expected.select("table").collect()]  # a row a table
    found = manifest({n: read_snapshot(spark, path, n) for n in names})
    return expected.exceptAll(found)


def restore(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    write_snapshot({n: read_snapshot(spark, source, n) for n in names}, target)


def as_json(df: DataFrame, *drop: str) -> DataFrame:
    """Rows as JSON text; absent values have no key, identifiers are left out."""
    return df.drop(*drop).select(F.to_json(F.struct("*")).alias("json"))


def progress(spark: SparkSession, run: str) -> dict[str, int]:
    """What the jobs of a run have done so far: jobs, those running, tasks done and in all. Jobs of a run share its name as their group."""
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(run)
    infos = [i for i in map(tracker.getJobInfo, jobs) if i is not None]
    stages = [s for s in map(tracker.getStageInfo, {k for i in infos for k in i.stageIds}) if s is not None]
    return {"jobs": len(infos), "running": sum(i.status == "RUNNING" for i in infos), "tasks_done": sum(s.numCompletedTasks for s in stages), "tasks": sum(s.numTasks for s in stages)}


@contextlib.contextmanager
def job_group(spark: SparkSession, run: str, what: str, cancelled, every: float = 0.2):
    """Jobs started inside are one group. Once ``cancelled`` says so, those that run are interrupted, in the middle of a table too."""
    context, ended = spark.sparkContext, threading.Event()
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}

    def watch() -> None:
        while not ended.wait(every):
            if cancelled():
                context.cancelJobGroup(run)

    context.setJobGroup(run, what, interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        ended.set()
        watcher.join()
        for key, value in before.items():
            context.setLocalProperty(key, value)
