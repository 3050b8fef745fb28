"""What the operators of this subpackage share: tables, durable intermediate tables, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is set only where the session names none and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``drop`` deletes tables whose readers are done; what the result itself reads stays until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tideline-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the actions inside; keys have __ for each dot."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def few_rows_of(spark: SparkSession):
    """For joins that need the texts of some documents: Spark's runtime Bloom filter (8 MB at most) leaves the others out before the shuffle.

    The filter's size is fixed; where there are too many keys for it, it lets more rows through and the join is as exact as before.
    """
    at = "spark__sql__optimizer__runtime__bloomFilter__"
    return settings(spark, **{f"{at}enabled": "true", f"{at}applicationSideScanSizeThreshold": "1m", f"{at}creationSideThreshold": "64g", f"{at}numBits": "67108864"})


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty), and the extra columns asked for; others with whatever names are left out."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def in_one(docs: DataFrame, **keys: Column) -> DataFrame:
    """``row``, which holds all columns, and the keys beside it: no column can clash with a key, whatever it is called."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(k.alias(name) for name, k in keys.items()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Remembered(dict):
    """Remembers what ``make`` gives for a key, in two generations: what is asked for again outlives what is not."""

    LIMIT = 800_000

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.LIMIT // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordHash(Remembered):
    """word (text or its bytes) -> 64-bit hash."""

    LIMIT = 250_000

    def make(self, word: str | bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))


def by_bytes(b: pa.RecordBatch, column: str, rows: int = 512, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many rows and, but for single rows, bytes of a text or binary column."""
    yield from by_size(b, pc.coalesce(pc.binary_length(b[column]), 0).to_numpy(), rows, limit)


def by_size(b: pa.RecordBatch, size: np.ndarray, rows: int = 512, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many rows and, but for single rows, bytes; size: the bytes of each row."""
    i = 0
    while i < b.num_rows:
        n = int(np.searchsorted(np.cumsum(size[i : i + rows], dtype=np.int64), limit, side="right"))
        yield b.slice(i, max(1, n))
        i += max(1, n)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: of so many rows, and of so many bytes of the column if there is one."""
    for b in batches:
        if column in b.schema.names:
            yield from by_bytes(b, column, rows)
        else:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)


_held: list[dict] = []


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hold(cache: dict | None) -> None:
    """Keeps one operator's cache in this Python worker between tasks, and empties another's."""
    if _held and _held[0] is not cache:
        _held.pop().clear()
        trim()
    if cache is not None and not _held:
        _held.append(cache)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives memory back after the last batch: Python workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
