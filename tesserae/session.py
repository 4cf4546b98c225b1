"""Session helpers: local sessions, the shared folder, lineage cuts, checked broadcasts and joins on hot keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if more than one in HOT_SHARE rows has it, so fewer than HOT_SHARE keys are.
HOT_SHARE = 1000


def local_session(cpus: int = 8, partitions: int = 8, app: str = "tesserae") -> SparkSession:
    """A local session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster set it.

    Where the setting is absent, a local session (tests, a laptop) gets a temporary folder; on a cluster that is an error, as
    executors elsewhere couldn't read the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 256) -> SparkSession:
    """Lower the rows of an Arrow batch to `rows`, where the session leaves them at Spark's 10,000: texts are long rows.

    The setting stays: Spark reads it when a result is computed, which is after the operator has returned.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


#: Folders made since a `finished` began, innermost last.
_made: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    path = f"{shared_root(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Lineage ends there, so an executor lost later costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut() of make()'s rows; everything else that was written on the way is deleted then."""
    _made.append([])
    try:
        out = make()
        made = _made.pop()
        done = cut(out, name)
    except BaseException:
        _made.clear()
        raise
    for path in made:
        remove(spark, path)
    return done


def small_side(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """`df` with a broadcast hint if its counted size is within `limit_bytes`, else as it is.

    Beyond the limit Spark plans a shuffled join, with AQE splitting skewed keys. row_bytes: of a row in memory, with its entry
    in the hash table.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys of counts(key, n), a row a key, that more than one in HOT_SHARE of all rows has; nulls aside."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return [r[0] for r in counts.where((F.col(n) * HOT_SHARE > total) & F.col(key).isNotNull()).select(key).collect()]


def join_hot(rows: DataFrame, unique: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with `unique`, which has a row a key at most.

    Rows with one of the keys `hot` stay where they are, as their partners are broadcast (fewer than HOT_SHARE rows). Rows without a
    key have no partner; they don't go to one task for that. All others are joined as Spark sees fit.
    """
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    out = rows.where(F.col(key).isNotNull() & ~is_hot).join(unique.where(~is_hot), key, how)
    if hot:
        out = out.unionByName(rows.where(is_hot).join(F.broadcast(unique.where(is_hot)), key, how))
    if how == "left":
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in unique.schema if f.name != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *more))
    return out


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, if it would be read by fewer tasks than there are cores (a table in one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
