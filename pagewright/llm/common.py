"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Characters that end a word: space and U+0009 to U+000D, which are also what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns of df, found by position: other columns, also such as differ in case only, do no harm.

    A name that df has twice means the first of them.
    """
    at = {}
    for k, c in reversed(list(enumerate(df.columns))):
        at[c] = k
        at.setdefault(c.lower(), k)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 1 when divided by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def for_training(doc_id: Column) -> Column:
    """True where models may learn from the row: doc_id is known and isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package. On a cluster it is shipped with --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, ROOT])


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about `most` bytes; a longer value comes alone."""
    for batch in batches:
        values = batch.column(column)
        size, start = 0, 0
        lengths = pc.binary_length(values).to_pylist()
        for k, n in enumerate(lengths):
            size += n or 0
            if size >= most:
                yield batch.slice(start, k + 1 - start)
                start, size = k + 1, 0
        if start < len(lengths):
            yield batch.slice(start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, column: str | None, most: int = 4 << 20) -> DataFrame:
    """Applies make()'s result to bounded batches of df.

    make runs once a task; what it returns turns a batch into lists by column of schema. Memory of a worker is bounded by
    the batch, not by the partition. column is the one whose bytes bound a batch; None: batches as Spark deals them.
    """
    on_workers(df.sparkSession)
    kinds = {f.name: f for f in _arrow(df.sparkSession, schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in pieces(batches, column, most) if column else batches:
            got = each(batch)
            yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], f.type) for n, f in kinds.items()], names=list(kinds))

    return df.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


#: Deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where written() has put its tables.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says; only if it's unset, on one machine, to a folder here."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or "/tmp/checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tidy: bool = True) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again; the files go when the session ends.

    Columns are stored by position, so that names that differ in case only do no harm. Shuffle files of what made df are
    deleted as soon as it is written: nothing reads them any more. Those of jobs before go once the driver's JVM has collected
    their plans, which is asked for here; tidy=False, for many small tables: not here.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    stored = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        stored.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    if tidy:
        sc._jvm.System.gc()
    out = spark.read.schema(stored.schema).parquet(path).toDF(*df.columns)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() returned. For tables that nothing reads any more: all that was made of them
    has been written or checkpointed itself, so that a lost executor asks for none of them again."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(_places.pop(table))
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
