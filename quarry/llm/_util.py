"""What the operators share: tables, checkpoints and batches of text."""

from __future__ import annotations

import re
import sys
import tempfile
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder that the session names.

    Where the session names none, a folder of our own is set if all of Spark
    runs in this process, as in tests; on a cluster that is an error.  The
    shuffle files that led to the rows are deleted once these are written.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # planned anew, under the setting
    finally:
        spark.conf.set(CLEANUP, before)


def _held() -> dict:
    return sys.modules.setdefault("quarry_in_process", types.ModuleType("quarry_in_process")).__dict__


def in_process(key, make):
    """What `make` returned for `key` in this process, which keeps one such thing: the last that was asked for."""
    held = _held()
    if held.get("key") != key:
        held.pop("value", None)
        held["value"], held["key"] = make(), key
    return held["value"]


def lasting(key, make):
    """What `make` returned for `key` in this process; for small things that any operator may keep."""
    kept = _held().setdefault("lasting", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Shared:
    """A model that tasks read as `value()`: broadcast by value, so that executors need not have this package, and loaded once in a process."""

    def __init__(self, spark: SparkSession, model):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(model))
        self.key = ("shared", self.data._jbroadcast.id())

    def __getstate__(self):
        return {"data": self.data, "key": self.key}

    def value(self):
        return in_process(self.key, self.load)

    def load(self):
        model = cloudpickle.loads(self.data.value)
        vars(self.data).pop("_value", None)  # a worker would keep the bytes beside the model
        return model


def trimmed() -> None:
    """Give memory that nothing uses back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, keeps=None):
    """An iterator function for mapInArrow that leaves no memory behind in its worker process.

    At its start it drops what another operator kept there (`keeps` names its
    own), at its end it gives free memory back to the system.
    """

    def tidied(batches):
        held = _held()
        if "key" in held and held["key"] != keeps:
            del held["key"], held["value"]
            trimmed()
        try:
            yield from run(batches)
        finally:
            trimmed()

    return tidied


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str):
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_slices(batch: pa.RecordBatch, column: str, size: int):
    """(first row, texts) of runs of rows holding about `size` bytes each; null text is empty."""
    yield from slices(batch.column(batch.schema.get_field_index(column)), size)


def array_slices(texts: pa.Array, size: int):
    """(first row, array) of runs of rows holding about `size` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = min(len(texts), int(np.searchsorted(ends, before + size)) + 1)
        yield start, texts.slice(start, end - start)
        start = end


def slices(texts: pa.Array, size: int):
    """(first row, texts) of runs of about `size` bytes each; only one run is ever held as Python strings."""
    for start, some in array_slices(texts, size):
        yield start, [t or "" for t in some.to_pylist()]


def filter_rows(docs: DataFrame, text_column: str, decide, keeps=None) -> DataFrame:
    """The rows, with all their columns, whose text `decide` keeps; decide(texts) gives an array of booleans."""
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            keep = [np.asarray(decide(texts), bool) for _, texts in slices(batch.column(at), 500_000)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(tidy(run, keeps), docs.schema)
