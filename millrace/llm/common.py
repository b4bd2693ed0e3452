"""What the corpus operators share: scratch tables, safe joins and word expressions."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
#: A side of this many rows at most may be broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 200_000


class Scratch:
    """Written tables in the shared folder, so that a lost executor costs no lineage.

    The folder is ``spark.checkpoint.dir``; a temporary one is set only where that is
    unset and the master is local, as in tests. Tables are Parquet: a later stage reads only
    the columns it needs. What no plan reads any more is dropped, the rest when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"
        folder, fs = self._at(self.root)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as table ``name`` and return its reader."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that no later plan reads; all of them without a name."""
        at, fs = self._at(self.path(name) if name else self.root)
        fs.delete(at, True)

    def keep(self, *names: str) -> None:
        """Delete all other tables."""
        folder, fs = self._at(self.root)
        for x in fs.listStatus(folder):
            if x.getPath().getName() not in names:
                fs.delete(x.getPath(), True)

    def _at(self, path: str):
        """The path and its file system, of Hadoop."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that ended: it does so when the driver collects garbage."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def lookup(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a written table: broadcast if its counted rows are few, else by shuffle.

    ``right`` must be a written table, so that counting it is a footer read. The shuffled
    form joins two plain exchanges, which adaptive execution splits where a key is hot.
    """
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: bodies of array functions have no shared subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    """The text; null is empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than white space, in order."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
