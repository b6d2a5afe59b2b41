"""Tables that cut lineage, written where every executor and the driver can read them.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that setting is missing and the
master is local (tests) a temporary folder is made and set; on a cluster a missing setting is an error, as each
executor would write to a disk of its own. Nothing is ever kept in one executor alone, so a lost executor costs at
most the tasks it was running.

Tables belong to the innermost open ``scratch`` and go when it closes; what an operator returns is written to the
``scratch`` around it (``Scratch.result``), so that of all its tables only the result is left.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes in one Arrow batch. Whole texts travel in these batches; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20

_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it."""
    scopes = getattr(_OPEN, "scopes", None)
    return _written(df, scopes[-1] if scopes else None)


def _written(df: DataFrame, scope: list[DataFrame] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(_nullable(df.schema)).parquet(path)
    table._scriptorium_path = path
    if scope is not None:
        scope.append(table)
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(table, "_scriptorium_path", None)
    if path:
        table._scriptorium_path = None
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


class Scratch:
    """The tables of one operator's run."""

    def __init__(self, tables: list[DataFrame], around: list[DataFrame] | None) -> None:
        self.tables, self.around = tables, around

    def result(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a table that outlives this scratch."""
        return _written(df, self.around)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables that ``materialise`` writes inside are deleted at the end."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    mine: list[DataFrame] = []
    around = scopes[-1] if scopes else None
    scopes.append(mine)
    try:
        yield Scratch(mine, around)
    finally:
        scopes.pop()
        for table in mine:
            discard(table)


def bounded_batches(spark: SparkSession) -> None:
    """See to it that Arrow batches are bounded by bytes. Always the same value, so that the order of calls doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
