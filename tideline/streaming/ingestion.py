"""Files of a folder imported as they arrive, each once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import files, ingest, snapshots

FILES = "path string, modificationTime timestamp, length long, content binary"


def import_arriving(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int | None = None, trigger: dict | None = None, cancelled: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Starts a query that imports each new file of a folder into the store at ``target``.

    The file source remembers in the checkpoint which files it has seen. A batch is one import, and its number is part of the
    commit that it makes; a batch that comes again after a crash, or after its commit and before the checkpoint knew, is left out.
    The tables are those of one import of all files, as imports add up. By default the query ends when all that is there is in.
    """
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def run(batch: DataFrame, number: int) -> None:
        stream = json.loads(snapshots.Files(spark, checkpoint).read("metadata").strip().splitlines()[-1])["id"]  # the query's own, as long as its checkpoint lasts
        ingest.into_store(batch.sparkSession, target, "stream", lambda run, keep: ingest.import_found(keep(files.opened(batch)), run, keep), cancelled, (stream, number))

    return reader.load(folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
