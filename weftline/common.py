"""Shared helpers: table access, lineage cuts, size-checked joins."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest measured size of a join side that may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and workers share one machine."""
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one (tests) gets a folder of its own.

    On a cluster without that setting it raises: what lies on one machine is lost with it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="weftline-")
    return _local[app]


_local: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder for checkpoints; files of a checkpoint go once nothing refers to it any more."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    jsc.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in here are removed as soon as it has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stamp(spark: SparkSession, path: str) -> str:
    """Bytes and time of the last change of a file or folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{fs.getContentSummary(where).getLength()}-{fs.getFileStatus(where).getModificationTime()}"


_kept: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` derives from ``source``, written once per application and state of the source.

    Later queries scan it with their own columns and filters pushed down instead of deriving it again.
    """
    key = (spark.sparkContext.applicationId, hashlib.md5(f"{name} {source} {stamp(spark, source)}".encode()).hexdigest())
    if key not in _kept:
        folder = f"{shared_folder(spark)}/stores/{key[0]}/{key[1]}"
        with shuffles_end(spark):
            build().write.mode("overwrite").parquet(folder)
        _kept[key] = folder
    return spark.read.parquet(_kept[key])


def one_per_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row per non-null ``key``; repeated deliveries of a key agree in ``cols``.

    Each value is the minimum over the repeats, so that the result does not depend on row order.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in cols])


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` take at most ``limit`` bytes, measured by one aggregate over them."""
    width: Column = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        nested = c.cast("string") if kind.startswith(("array", "struct", "map")) else c
        width = width + (F.coalesce(F.octet_length(nested), F.lit(0)).cast("long") + 16 if kind in ("string", "binary") or nested is not c else F.lit(16))
    size = df.agg(F.sum(width)).first()[0] or 0
    return size <= limit


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_BYTES, salts: int = 16) -> DataFrame:
    """Join ``big`` with a table of unique ``key``.

    A side of at most ``limit`` measured bytes is broadcast. Beyond it, ``big`` is salted and ``small``
    repeated per salt, so that a key with a large share of the rows is spread over ``salts`` tasks.
    """
    if fits_broadcast(small, limit):
        return big.join(F.broadcast(small), key, how)
    salted = big.withColumn("__salt", (F.rand(7) * salts).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
