"""What the operators share: tables, the shared folder, words, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than blanks and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of that very name, whatever blanks, dots or quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a run within one machine gets a folder of its own; a cluster has to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="glyphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives lost executors, and keeps what is computed once from being computed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release_files(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "settled_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """The same, and let Spark delete the shuffles behind them."""
    release_files(*tables)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


#: Bytes of an Arrow batch, about, where rows are long.
BATCH = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


#: Hashes that order a sample, and parts of their range that its cut is found among.
GRAIN, PARTS = 1 << 40, 1 << 12


def sample_of(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most so many rows, those with the least hash of the columns given. Rows are counted by parts of the hash's range; those behind the part that makes the sample full are sent nowhere. No row of the sample lies there, however many rows there are and however they repeat."""
    own = rows.withColumn("__h", F.pmod(F.xxhash64(*map(col, by)), F.lit(GRAIN)))
    part = F.floor(F.col("__h") / (GRAIN // PARTS))
    counts = sorted((r["p"], r["n"]) for r in own.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # PARTS rows at most
    full = (p for (p, _), n in zip(counts, itertools.accumulate(n for _, n in counts)) if n >= most)
    return own.where(part <= next(full, PARTS)).orderBy("__h", *map(col, by)).limit(most).drop("__h")


#: Called when an operator's partition ends, to empty its modules' caches.
FORGET: list[Callable[[], None]] = []
#: What a worker keeps from one partition to the next: one thing, by its maker and arguments.
HELD: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """make(*args), kept in the worker until another thing is, or an operator runs that needs none."""
    if (make, args) not in HELD:
        HELD.clear()
        HELD[make, args] = make(*args)
    return HELD[make, args]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, which keeps nothing in the worker: memory goes back to the machine when its partition ends, as workers serve many operators one after another."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        HELD.clear()
        yield from run(batches)
        for forget in FORGET:
            forget()
        give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by keys (whole numbers)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        other = False
        for k in keys:
            column = b.column(k).to_numpy()
            other = other | (column != column[-1])
        if other.any():
            end = int(other.nonzero()[0][-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, end)])
            held = [b.slice(end)]
        else:
            if held and any(held[-1].column(k)[-1] != b.column(k)[-1] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def schema_of(df: DataFrame, *columns: str, **more: T.DataType) -> T.StructType:
    """Columns of df, whatever their names, and more."""
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in columns), *(T.StructField(c, t) for c, t in more.items())])
