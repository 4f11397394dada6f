"""Tables in the folder that all machines share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[Workspace]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder that goes with the process; a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Workspace:
    """Tables written to the shared folder during one call of an operator.

    drop() removes tables that nothing reads any more; temporary_tables() removes all that were written within.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/gridweave/{name}-{uuid.uuid4().hex}"
        self.written: set[str] = set()
        if _open:
            _open[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.written.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove the named tables, all if none is named."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        self.written = self.written.difference(names) if names else set()
        for at in [self.path(n) for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(conf).delete(p, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but the named."""
        self.drop(*sorted(self.written.difference(names)) or ["none"])


_kept: dict[tuple[str, str], tuple[tuple, Workspace, object]] = {}


def files_of(*frames: DataFrame) -> tuple:
    """(path, bytes, time of change) of all files that frames read."""
    out = []
    for f in frames:
        jvm, conf = f.sparkSession._jvm, f.sparkSession._jsc.hadoopConfiguration()
        for name in sorted(f.inputFiles()):
            p = jvm.org.apache.hadoop.fs.Path(name)
            status = p.getFileSystem(conf).getFileStatus(p)
            out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def shared_result(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[Workspace], object]) -> object:
    """What build writes for these input files, once for an application; when a file changes, the old tables go and it's built anew."""
    key, now = (spark.sparkContext.applicationId, name), files_of(*inputs)
    if key in _kept and _kept[key][0] == now:
        return _kept[key][2]
    if key in _kept:
        _kept.pop(key)[1].drop()
    work = Workspace(spark, name.rsplit("/", 1)[-1])
    _kept[key] = (now, work, build(work))
    return _kept[key][2]


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Removes, at its end, the tables of workspaces that were opened within: results must be written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for w in _open.pop():
            w.drop()
