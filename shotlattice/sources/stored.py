"""Tables in the folder that driver and executors share: intermediate ones that cut lineage, and memos that are refreshed by versions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Without it a temporary folder stands in, in local mode only: on a cluster a folder of one machine would lose rows, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = getattr(spark, "_stored_folder", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="stored-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark._stored_folder = at
    return at


#: Tables that go when the driver ends; results read them when they are evaluated, so they stay until then.
_LIVE: set[str] = set()


def _swept(spark: SparkSession) -> None:
    try:
        for path in sorted(_LIVE):
            _Files(spark, path).remove()
    except Exception:  # the session has ended first; then whoever owns the shared folder empties it
        pass


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps start from files, so a lost executor repeats none of what led here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _LIVE:
        atexit.register(_swept, spark)
    _LIVE.add(path)
    return spark.read.schema(df.schema).parquet(path)


class _Files:
    """The few file operations of a memo, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, base: str):
        self.path = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join((base, *x)))
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = spark._jvm

    def names(self, *under: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(*under))) if self.fs.exists(self.path(*under)) else []

    def has(self, *at: str) -> bool:
        return self.fs.exists(self.path(*at))

    def remove(self, *at: str) -> None:
        self.fs.delete(self.path(*at), True)


class Memo:
    """A table of computed rows by key that is refreshed, not rebuilt.

    A refresh computes only keys that are wanted and missing, lot by lot; a lot that is finished stays, so a run that is killed goes on where it was. When all lots are there, a new version is written
    beside the old one: what is still wanted of that, and the new rows. A version counts once Spark has put its success marker into it, which it does last, so readers see the old version or the whole new one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.base, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.files = _Files(spark, self.base)

    def version(self) -> int:
        """The latest whole version; 0 if there is none."""
        return max([int(n[1:]) for n in self.files.names() if n[0] == "v" and n[1:].isdigit() and self.files.has(n, "_SUCCESS")], default=0)

    def read(self) -> DataFrame:
        """The rows of the latest version."""
        at = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/v{at}") if at else self.spark.createDataFrame([], self.schema)

    def _lots(self) -> list[str]:
        return [f"{self.base}/lots/{n}" for n in self.files.names("lots") if self.files.has("lots", n, "_SUCCESS")]

    def refresh(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], lots: int = 16, keep: int = 2) -> DataFrame:
        """The rows of the new version. ``compute`` gives the rows of a table of keys; ``lots`` are parts of the missing keys by hash; ``keep`` versions stay, for readers that began before the switch.

        Null keys are keys like others, repeated ones are computed once, and a key may have no rows or several. A key that ``compute`` gave no rows is asked again by the next refresh.
        """
        wanted = wanted.select(*self.keys).distinct()
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.keys]
        have = self.read()
        done = {n.rsplit("/", 1)[1] for n in self._lots()}
        for lot in range(lots):
            name = f"{lots}-{lot}"
            if name in done:
                continue
            part = wanted.where(F.pmod(F.xxhash64(*self.keys), F.lit(lots)) == lot)
            known = have.select(*self.keys).distinct()
            part = part.join(known, same(part, known), "left_anti")
            compute(part).select(*self.read().columns).write.mode("overwrite").parquet(f"{self.base}/lots/{name}")
        fresh = self.spark.read.schema(self.schema).parquet(*self._lots())
        at = self.version() + 1
        known = have.select(*self.keys).distinct()
        fresh = fresh.join(known, same(fresh, known), "left_anti")  # lots that an earlier run had finished may hold what has become a version since
        whole = have.unionByName(fresh)
        whole.join(wanted, same(whole, wanted), "left_semi").write.mode("overwrite").parquet(f"{self.base}/v{at}")
        self.files.remove("lots")
        for n in self.files.names():
            if n[0] == "v" and n[1:].isdigit() and int(n[1:]) <= at - keep:
                self.files.remove(n)
        return self.read()
