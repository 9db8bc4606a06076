"""Where intermediate results are kept so that a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``; a private one only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of a plan, written once to the shared checkpoint folder; the plan ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share, for tables that are written and read again."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows of a plan, written once as a table to the shared folder and read again; the plan ends there."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_file(path: str):
    """A file opened for writing by address or path, on whatever file system all executors share; its folder is made."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(name.rpartition("/")[0] or ".", recursive=True)
    return system.open_output_stream(name)


def require_shared(spark: SparkSession, folder: str) -> None:
    """Refuse a bare path on a cluster, where every executor would write to a disk of its own."""
    if "://" not in folder and not folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"on a cluster name a shared folder by its address: {folder}")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core.

    Only an input with fewer splits than the session has cores is shuffled, so the
    cost is bounded by that many splits; larger inputs stay as they were read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
