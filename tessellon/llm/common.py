"""What the operators share: the folder all machines see, tables that cut lineage, and a size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII control spaces.
WORD_JAVA = r"[^\x20\x09-\x0D]+"
WORD_PY = r"[^\t-\r ]+"
#: A side is broadcast only when its measured rows stay under this many bytes.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch of documents; Spark's default is five times as many, and a task holds several batches outside the heap.
ARROW_ROWS = 2000
#: The lists that materialise() notes its paths in, innermost last; see tables().
_noted: ContextVar[tuple] = ContextVar("noted", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset and the master is local, as in tests, a temporary one is set; on a cluster it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tessellon-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the JVM deletes it when the application ends."""
    path = f"{shared_dir(spark)}/tessellon/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: How rows of several MB are written: by default the first look at a row group's size comes after 100 rows, which its writer and each of its readers would hold at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    for paths in _noted.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have ARROW_ROWS rows at most, where the session still has Spark's default; only memory depends on it."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == default:
        spark.conf.set(name, ARROW_ROWS)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _paths(df: DataFrame) -> set[str]:
    """Names of the tables made by materialise() that df reads."""
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles() if "/tessellon/" in f}


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() that nothing reads any more."""
    spark = df.sparkSession
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessellon/" in d:
            remove_path(spark, d)


@contextmanager
def tables(spark: SparkSession):
    """Notes what materialise() writes inside the block. The value is called with the tables that are still read, and deletes the others."""
    paths: list[str] = []

    def drop(*still: DataFrame) -> None:
        names = set().union(*map(_paths, still)) if still else set()
        for p in [p for p in paths if p.rsplit("/", 1)[-1] not in names]:
            remove_path(spark, p)
            paths.remove(p)

    mark = _noted.set((*_noted.get(), paths))
    try:
        yield drop
    finally:
        _noted.reset(mark)


def small_or_whole(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its count times width (bytes a row, at most) stays under the limit, else unhinted."""
    return F.broadcast(df) if df.count() * width <= limit else df


def own_names(taken: list[str], *names: str) -> list[str]:
    """Names for working columns that clash with none of the taken ones, whatever their case."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out
