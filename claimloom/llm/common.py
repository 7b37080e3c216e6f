"""What the operators of this subpackage share: table access, word rules, materialised steps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are neither a space nor one of the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows whose texts are Python objects at a time; an Arrow batch may hold many more.
TEXT_ROWS = 512
ROWS_PER_FILE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='claimloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Step:
    """A written intermediate table: survives the loss of executors and cuts lineage."""

    def __init__(self, df: DataFrame, name: str, rows: int | None = None):
        """``rows``, if known, bounds the number of files: a small table is not written as many tiny ones."""
        self.spark = df.sparkSession
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE))
        self.path = f"{shared_dir(self.spark)}/claimloom/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _written.append((self.spark, self.path))

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again."""
    return Step(df, name).df


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the JVM may be gone by now; the folder is a scratch one
            return


def sliced(batches, rows: int = TEXT_ROWS):
    """Arrow batches in slices of at most so many rows."""
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver happens to collect garbage."""
    for _ in range(2):  # what the first round of collection lets go of, the second finds unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Gives back to the system what Java and Python on the driver have freed: the C library keeps it, in a pool for
    every few of Spark's hundreds of threads.  False where Java can't be asked for it (before 17.0.9, no glibc)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    text, any_ = jvm.java.lang.String, jvm.java.lang.Object
    names, args, server = array(jvm.java.lang.Class, 4), array(any_, 4), jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:  # by its interface, since the server's own class is not open to callers
        for i, name in enumerate(["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]):
            names[i] = jvm.java.lang.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(any_, 1), array(text, 1)
        args[2][0] = array(text, 0)
        args[3][0] = "[Ljava.lang.String;"
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", names).invoke(server, args)
    except Py4JError:
        return False
    return True


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value, body):
    """``body`` of a column that is evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text):
    """Words of a text as a column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_rows(rows: DataFrame, id_col: str = "id", name: str = "row") -> DataFrame:
    """``rows`` with a number of their own: the id where ids are unique integers, else one given to a written copy."""
    if rows.schema[id_col].dataType.simpleString() in ("bigint", "int"):
        null = rows.where(F.col(id_col).isNull()).limit(1).count()
        repeated = rows.groupBy(id_col).count().where("count > 1").limit(1).count()
        if not null and not repeated:
            return rows.withColumn(name, F.col(id_col).cast("long"))
    return materialize(rows.withColumn(name, F.monotonically_increasing_id()), "rows")
