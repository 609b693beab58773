"""Shared storage for intermediate tables, and small helpers the operators have in common.

Executors can be lost at any time, so nothing here keeps the only copy of an intermediate result on one executor:
intermediate tables are written to the folder that the cluster names in `spark.checkpoint.dir`.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_BYTES = 8 << 20
#: Tables below this size, as Spark estimates it, are dealt anew before costly steps.
SMALL_BYTES = 16 << 20
#: Bytes of tables, as they are stored, that one task of an exchange gets at most, about.
TASK_BYTES = 64 << 20
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where the setting is absent and all runs in one process."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        folder = tempfile.mkdtemp(prefix="obsframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir[app] = f"file://{folder}"
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    ship(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(df: DataFrame) -> DataFrame:
    """df; its session, from now on, sends Python no more than BATCH_BYTES of rows at a time, unless a limit has been set,
    so that a worker's memory does not follow the length of texts. Plans read the limit when they run, so it stays set."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    ship(df.sparkSession)
    if df.sparkSession.sparkContext.getConf().get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is so small that it may be a single row group, which one task would have to work through."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads; sources of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 62)


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Tasks for an exchange of so many bytes: the session's number, or more where that would give each too much."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // TASK_BYTES))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def held_out(id_col: Column) -> Column:
    """Whether a row belongs to the fold that never lends its labels to training; a null id does not (nor is it trained on)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def by_bytes(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `most` characters, so that scratch arrays stay small beside long texts."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
