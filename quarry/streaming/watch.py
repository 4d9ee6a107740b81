"""Audits as they come: each is compared with the last one of its target, and new faults are told."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.audits import difference

SNAPSHOT = "target string, audit_id string, key string, severity string, seq bigint"


class Watch:
    """For foreachBatch over findings of finished audits: target, audit_id, at, key, severity, seq.

    The last audit of every target is kept in a folder for each batch, so a
    batch that is run again compares with the same one before it.  `alert` gets
    the regressions of targets that were audited before, and is called only if
    there are some.  A target's newest audit in a batch counts.
    """

    def __init__(self, store: str, alert: Callable[[DataFrame], None]):
        self.store, self.alert = store, alert

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.store)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()) for s in files.listStatus(folder) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if files.exists(folder) else []
        last = max((i for i in done if i < batch_id), default=None)
        return spark.createDataFrame([], SNAPSHOT) if last is None else spark.read.schema(SNAPSHOT).parquet(f"{self.store}/{last}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        old = self.before(batch.sparkSession, batch_id)
        newest = batch.groupBy("target").agg(F.max_by("audit_id", "at").alias("audit_id"))
        new = batch.join(newest, ["target", "audit_id"]).select("target", "audit_id", "key", "severity", "seq")
        kept = old.join(newest.select("target"), "target", "left_anti").select("target", "audit_id", "key", "severity", "seq")
        new.unionByName(kept).write.mode("overwrite").parquet(f"{self.store}/{batch_id}")
        whole = lambda df: df.select(F.concat_ws("\0", "target", "key").alias("key"), "severity", "seq")
        again = new.join(old.select("target").distinct(), "target", "left_semi")
        told = difference(whole(old), whole(again)).where("regression")
        told = told.select(F.split("key", "\0")[0].alias("target"), F.split("key", "\0")[1].alias("key"), "severity")
        if not told.isEmpty():
            self.alert(told)


def in_turn(spark: SparkSession, jobs: Iterable[Callable[[], object]], at_once: int = 2) -> list:
    """What each job returns, in their order; they start in that order, `at_once` at a time, each in a pool of its own. A job's error is its result."""
    jobs = list(jobs)
    out: list = [None] * len(jobs)
    waiting = iter(range(len(jobs)))

    def work(pool: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"audit-{pool}")
        for i in waiting:
            try:
                out[i] = jobs[i]()
            except Exception as e:  # noqa: BLE001  the next audit goes on
                out[i] = e

    threads = [InheritableThread(target=work, args=(p,)) for p in range(min(at_once, len(jobs)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out
