"""Tables in the folder that all executors share: lineage is cut there, and results are reused."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: what ``spark.checkpoint.dir`` names.

    A session without that setting gets a local folder if its executors are threads of the driver, as
    in tests. On a cluster each executor would write its own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/spindrift-shared"


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def new_place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/spindrift-{name}-{uuid.uuid4().hex}"
    made, system = _at(spark, path)
    system.mkdirs(made)
    system.deleteOnExit(made)
    return path


def cut(df: DataFrame, name: str, outer: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not a recomputation. The table
    goes with the ``scope`` that it is made in, or with the one so many around that as ``outer``
    says, and in any case when the driver ends.
    """
    spark = df.sparkSession
    path = new_place(spark, name)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    scopes = getattr(_OPEN, "scopes", [])
    if len(scopes) > outer:
        scopes[-1 - outer].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        path, system = _at(t.sparkSession, t.shared_path)
        system.delete(path, True)
        system.cancelDeleteOnExit(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that ``cut`` makes within are deleted at the end, but for those made for an ``outer`` one."""
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    made: list[DataFrame] = []
    _OPEN.scopes.append(made)
    try:
        yield
    finally:
        _OPEN.scopes.pop()
        discard(*made)
