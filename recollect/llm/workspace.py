"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset (tests on one machine), a folder of our own; on a
    cluster an unset folder is an error, as a machine's own disk is not seen by the others."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recollect-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recollect-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Most rows and bytes of an Arrow batch in the steps that are run here: the JVM, the worker and what is made of a batch
#: each hold one at a time and more, in every task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: The files of a plan's exchanges are removed once its rows are written or fetched: nothing reads them again.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_written: ContextVar[tuple[list[str], list[str] | None] | None] = ContextVar("written", default=None)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_batches(spark: SparkSession, **more: str) -> Iterator[None]:
    """The session's Arrow batches are small while a step runs, and its exchanges leave no files behind; with more, settings
    under spark.sql.execution.arrow. that go before."""
    with _settings(spark, BATCH | CLEAN | {f"spark.sql.execution.arrow.{k}": v for k, v in more.items()}):
        yield


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, and files of exchanges as soon as a step ends; nothing that is
    returned may read them. Those written with keep live as long as the scratch() around this one, or stay."""
    outer = _written.get()
    mark = _written.set(([], None if outer is None else outer[0]))
    try:
        with _settings(spark, CLEAN):
            yield
    finally:
        done, _ = _written.get()
        _written.reset(mark)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in done:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage is cut, a lost executor costs a reread,
    and the optimizer knows the table's real size when it decides on a broadcast. Inside scratch() the table lives as
    long as that, with keep as long as the one around it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    here, around = _written.get() or (None, None)
    if (lives := around if keep else here) is not None:
        lives.append(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """The executors give back what earlier steps left: a JVM's heap stays as large as it once was until a full collection,
    beside the workers of all steps that follow. Ends once a task for each core has asked for one."""
    cores = max(spark.sparkContext.defaultParallelism, 1)
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
